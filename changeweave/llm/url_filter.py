"""URL filter: a weighted vocabulary counted by one Aho-Corasick automaton, and host/path rules above it.

The automaton finds every strict and soft term in the lower-cased url (scheme included); a hit counts if the
characters at both its ends are no letters or digits. One strict hit rejects the url, and so do soft terms of
``SOFT_KINDS`` distinct kinds or more whose weights add up to ``SOFT_LIMIT``. The vocabulary is a parameter: term ->
weight, strict terms having none. ``vocabulary_of`` reads one from a table (term, class, weight); it is broadcast as
one automaton, of at most ``MOST_TERMS`` terms, beyond which it is refused.

Rules (host, path) name a host with all its subdomains and a path prefix. The longest fitting rule decides.
Rules are looked up by expression: each is a constant comparison, evaluated in the JVM.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule and is judged by its
terms (null: allow); a url may be empty or very long; repeated rows are judged each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeweave.llm.common import quoted, table

#: Terms that reject alone.
STRICT = (
    "adult", "bestiality", "bukkake", "camgirl", "camgirls", "casino", "clickjack", "counterfeit", "cumshot", "darknet", "deepthroat",
    "escort", "escorts", "fakepass", "gangbang", "hardcore", "hentai", "incest", "keygen", "keygens", "keylogger", "malware", "milf", "milfs",
    "onlyfans", "orgasm", "phishing", "porn", "porno", "pornhub", "ransomware", "sexcam", "sexcams", "spam", "spyware", "trojan", "upskirt",
    "viagra", "warez", "webcamsex", "xhamster", "xnxx", "xvideos", "xxx",
)
#: Terms that reject together, with their weights: 3 for terms rarely innocent, 2 for doubtful ones, 1 for common words of such sites.
SOFT = {
    "bet": 3, "bets": 3, "betting": 3, "blackjack": 3, "bookmaker": 3, "cialis": 3, "crack": 2, "cracked": 3, "fetish": 3, "gambling": 3, "jackpot": 3, "lottery": 3, "lotto": 3,
    "nude": 3, "nudes": 3, "payday": 3, "pill": 3, "pills": 3, "poker": 3, "roulette": 3, "serial": 2, "sex": 3, "sexy": 3, "slots": 3, "steroids": 3, "torrent": 3,
    "ads": 2, "affiliate": 2, "banner": 2, "bitcoin": 2, "bonus": 2, "cam": 2, "cams": 2, "clickbait": 3, "coupon": 2, "coupons": 2, "crypto": 2, "dating": 2, "diet": 2, "doubleclick": 3,
    "earn": 2, "farm": 2, "forex": 2, "hookup": 3, "hookups": 3, "loan": 2, "loans": 2, "lucky": 2, "pharma": 2, "pharmacy": 2, "popunder": 3, "popup": 2, "promo": 2, "prize": 2, "prizes": 2,
    "redirect": 2, "replica": 2, "seo": 2, "singles": 2, "spin": 2, "spins": 2, "sponsored": 2, "telemetry": 2, "teen": 2, "teens": 2, "track": 2, "tracker": 2, "tracking": 2, "vegas": 2, "wager": 3,
    "win": 2, "winner": 2, "winners": 2, "winning": 2,
    "big": 1, "buy": 1, "cash": 1, "cheap": 1, "click": 1, "credit": 1, "deal": 1, "deals": 1, "discount": 1, "download": 1, "fast": 1, "free": 1, "girls": 1, "hot": 1, "instant": 1, "live": 1,
    "money": 1, "now": 1, "offer": 1, "offers": 1, "online": 1, "profit": 1, "quick": 1, "rich": 1, "sale": 1, "super": 1,
}
#: Distinct soft terms, and the sum of their weights, that reject.
SOFT_KINDS, SOFT_LIMIT = 2, 4
MOST_TERMS = 1_000_000


def vocabulary_of(terms: DataFrame) -> tuple[tuple[str, ...], dict[str, int]]:
    """Strict terms and soft weights from a table (term, class, weight); class is strict or soft. Repeated terms take the largest weight."""
    rows = terms.where("term IS NOT NULL AND term <> ''").groupBy(F.lower("term").alias("term")).agg(F.bool_or(F.col("class") == "strict").alias("strict"), F.max("weight").alias("weight"))
    found = rows.limit(MOST_TERMS + 1).collect()
    if len(found) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    return tuple(sorted(r.term for r in found if r.strict)), {r.term: int(r.weight or 0) for r in sorted(found) if not r.strict}


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def _automaton(strict: tuple[str, ...], soft: dict[str, int]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for t in strict:
        a.add_word(t, (t, None))
    for t, w in soft.items():
        if t not in strict:
            a.add_word(t, (t, w))
    if len(a):
        a.make_automaton()
    return a


def term_counts(url: str, automaton) -> tuple[int, int, int, int]:
    """Strict hits, soft hits, the number of distinct soft terms and the sum of their weights."""
    strict, soft, kinds = 0, 0, {}
    for end, (t, w) in automaton.iter(url) if len(automaton) else ():
        start = end - len(t)
        if (start >= 0 and url[start].isalnum()) or (end + 1 < len(url) and url[end + 1].isalnum()):
            continue
        if w is None:
            strict += 1
        else:
            soft += 1
            kinds[t] = w
    return strict, soft, len(kinds), sum(kinds.values())


def judge_terms(df: DataFrame, keep: list[str], url_col: str, strict: tuple[str, ...] = STRICT, soft: dict[str, int] | None = None, limit: int = SOFT_LIMIT, kinds: int = SOFT_KINDS) -> DataFrame:
    """keep + __cw_strict, __cw_soft (hits) and __cw_terms, the verdict of the terms."""
    src = df.select(*[quoted(c) for c in keep], quoted(url_col).alias("__cw_url"))
    schema = src.drop("__cw_url").schema.add("__cw_strict", "integer").add("__cw_soft", "integer").add("__cw_terms", "string")
    words = df.sparkSession.sparkContext.broadcast((strict, SOFT if soft is None else soft))  # at most MOST_TERMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(*words.value)
        for b in batches:
            got = [term_counts((u or "").lower(), automaton) for u in b.column(b.num_columns - 1).to_pylist()]
            said = ["block" if g[0] or (g[2] >= kinds and g[3] >= limit) else "allow" for g in got]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.int32()), pa.array(said, pa.string())], names=[f.name for f in schema])

    return src.mapInArrow(run, schema)


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, **vocabulary: object) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict, n_soft. vocabulary: strict, soft, limit and kinds of ``judge_terms``."""
    named = pages.select(quoted(id_col).alias("page_id"), quoted(url_col).alias("url"))
    named = named.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "url")
    name, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = judge_terms(named.withColumn("rule", name).withColumn("said", verdict), ["page_id", "host", "path", "rule", "said"], "url", **vocabulary)
    return judged.select("page_id", "host", "path", "rule", F.coalesce("said", "__cw_terms").alias("verdict"), F.col("__cw_strict").alias("n_strict"), F.col("__cw_soft").alias("n_soft"))


def filter_urls(pages: DataFrame, url_col: str = "url", rules: tuple[Rule, ...] = RULES, **vocabulary: object) -> DataFrame:
    """The rows whose url is allowed, with all their columns, whatever their names."""
    names = [f"__cw_{i}" for i in range(len(pages.columns))]
    own = pages.toDF(*names)
    url = F.col(names[pages.columns.index(url_col)])
    marked = own.withColumn("__cw_said", fitting_rule(host_of(url), path_of(url), rules)[1])
    judged = judge_terms(marked, marked.columns, names[pages.columns.index(url_col)], **vocabulary)
    return judged.where(F.coalesce("__cw_said", "__cw_terms") == "allow").select(*[F.col(n).alias(c) for n, c in zip(names, pages.columns, strict=True)])


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def _oracle() -> str:
    # a bounded hit is one whose neighbours are no letters or digits; look-arounds are absent, so each hit is judged in place
    def count(t: str) -> str:
        n = len(t)
        return f"len(list_filter(range(1, length(u) - {n - 1} + 1), lambda i: substr(u, i, {n}) = '{t}' AND NOT regexp_matches(substr(u, i - 1, CASE WHEN i > 1 THEN 1 ELSE 0 END), '[\\p{{L}}\\p{{N}}]') AND NOT regexp_matches(substr(u, i + {n}, 1), '[\\p{{L}}\\p{{N}}]')))"

    strict = " + ".join(count(t) for t in STRICT)
    soft = ", ".join(f"{count(t)} AS s{i}" for i, t in enumerate(SOFT))
    n_soft = " + ".join(f"s{i}" for i in range(len(SOFT)))
    kinds = " + ".join(f"(s{i} > 0)::INTEGER" for i in range(len(SOFT)))
    weight = " + ".join(f"(s{i} > 0)::INTEGER * {w}" for i, w in enumerate(SOFT.values()))
    order = sorted(RULES, key=lambda r: -len(r.name))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    return f"""
WITH p AS (
  SELECT page_id, lower(coalesce(url, '')) AS u,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages
), c AS (SELECT *, {strict} AS n_strict, {soft} FROM p),
v AS (
  SELECT *, {n_soft} AS n_soft, CASE WHEN n_strict > 0 OR ({kinds} >= {SOFT_KINDS} AND {weight} >= {SOFT_LIMIT}) THEN 'block' ELSE 'allow' END AS said,
         CASE {' '.join(f"WHEN {fits(r)} THEN '{r.name}'" for r in order)} END AS rule,
         CASE {' '.join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in order)} END AS ruled FROM c
)
SELECT page_id, host, path, rule, coalesce(ruled, said) AS verdict, CAST(n_strict AS INTEGER) AS n_strict, CAST(n_soft AS INTEGER) AS n_soft FROM v
"""


ORACLE = _oracle()
