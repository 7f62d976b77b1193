"""Personal data by bootstrapped contextual extraction.

1. Seeds: exact patterns find emails, IP addresses, card and phone numbers in every whole text (the base spans), and
   secrets: values of 16 characters or more, letters and digits, that are assigned to a name such as token or password.
2. The same pass lists every identifier-like token (it has 5 digits or more, an @, or the form of a secret), runs of digit
   groups, and cards within longer runs, with their lexical patterns: the shape, the word before, or after, with the
   shape, and the two words before, or the words around, whatever the shape. Seeds are listed too, and phone numbers
   that run into other digits. No identifier, shape or context has a longest length.
3. Spark scores the graph of patterns and instances in rounds: a pattern's reliability is the mean confidence of its
   distinct instances, damped by ``PRIOR`` imaginary bad ones; an instance's confidence is 1 for a seed and else that
   of its best pattern. From round to round no reliability falls, and the rounds end when their sum grows by less than
   ``STEADY``. Patterns and instances meet by shuffled joins of written tables, whose hot keys Spark splits, and by
   aggregation with partial sums first; no pattern list is broadcast or collected.
4. Tokens whose pattern is reliable, that no base span touches and that pass the check of the kind which the pattern's
   seeds mostly have, are added as spans of that kind.

The base spans are what the patterns of the contract give, scanned in linear time: possessive runs tried at their
starts only, which finds the same leftmost matches.

Defined cases: null texts are empty and have no spans; the spans of one kind never overlap; where patterns of several
kinds extract one token, the first kind by name counts; repeated rows are documents of their own; null ids are kept; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeweave.llm.common import forget, quoted, table, written

KINDS = ("email", "ip", "card", "phone")
#: Kinds of all spans, in their order.
ALL_KINDS = (*KINDS, "secret")
#: The rounds of scoring end when the sum of reliabilities grows by a smaller share.
STEADY = 0.001
#: Imaginary bad instances of every pattern, and the reliability at which a pattern extracts.
PRIOR, RELIABLE = 2.0, 0.7
#: Distinct seeds that a pattern must have met, at least.
SEEDS = 3

_LOCAL = r"[A-Za-z0-9._%+-]"
_DOMAIN = r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_EMAIL_AT_START = re.compile(rf"(?<!{_LOCAL}){_LOCAL}++{_DOMAIN}")
_EMAIL_HERE = re.compile(rf"{_LOCAL}++{_DOMAIN}")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\s]*[0-9@][^\s]*")
_EDGES = "\"'“”‘’«»()[]{}<>,;:!?.*#$%&|="
#: On the reversed text before a mention: the last word and the one before it.
_WORDS_BEFORE = re.compile(r"[^\w]*+(?:([^\W\d_]++)(?:[^\w]++([^\W\d_]++)?)?)?")
_WORD_AFTER = re.compile(r"[^\w]*+([^\W\d_]++)?")
_SECRET = re.compile(r"(?i)(?<![a-z0-9])(?:token|secret|passw(?:or)?d|passphrase|api[_-]?key|access[_-]?key|private[_-]?key|auth)[\x20\t]{0,3}[=:][\x20\t]{0,3}[\"']?([A-Za-z0-9_+/-]{16,}+)")
_FORM_OF_SECRET = re.compile(r"[A-Za-z0-9_+/-]{16,}={0,2}")
#: Two groups of digits or more, with at most three blanks, dots, hyphens or brackets between them.
_RUN = re.compile(r"(?<![\w.])\(?[0-9]++(?:[\x20().-]{1,3}[0-9]++)+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    if "@" not in text:
        return out
    # a match may start right where the last one ended, in the middle of a run
    while m := (at and _EMAIL_HERE.match(text, at)) or _EMAIL_AT_START.search(text, at):
        out.append(m.span())
        at = m.end()
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    out["email"] = emails(text)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out["phone"].append(m.span())
    return out


def kinds_fitted(token: str) -> str:
    """The kinds whose check the token passes, joined by commas: what a pattern finds must pass the check of its kind."""
    digits = re.sub("[^0-9]", "", token)
    out = []
    if re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@]+", token):
        out.append("email")
    if (m := _IP.fullmatch(token)) and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
        out.append("ip")
    if 16 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9 .-]", token):
        out.append("card")
    if 8 <= len(digits) <= 15 and not re.search(r"[^0-9 +().-]", token):
        out.append("phone")
    if is_secret(token):
        out.append("secret")
    return ",".join(out)


def is_secret(token: str) -> bool:
    """Whether it has the form of one: 16 characters or more of an encoding's alphabet, letters and digits among them."""
    return _FORM_OF_SECRET.fullmatch(token) is not None and any(c.isdigit() for c in token) and any(c.isalpha() for c in token)


def digit_runs(text: str) -> list[tuple[int, int]]:
    """Cards within runs of digit groups, the longest first from the left; else a run of 8 to 15 digits as a whole."""
    out = []
    for m in _RUN.finditer(text):
        groups = [g.span() for g in re.finditer(r"[0-9]+", m.group())]
        digits = re.sub("[^0-9]", "", m.group())
        ends = [0]
        for a, b in groups:
            ends.append(ends[-1] + b - a)
        i, cards = 0, []
        while i < len(groups):
            fits = None
            for j in range(i, len(groups)):
                n = ends[j + 1] - ends[i]
                if n > 19:
                    break
                if n >= 16 and luhn(digits[ends[i] : ends[j + 1]]) and not re.search(r"[^0-9 .-]", m.group()[groups[i][0] : groups[j][1]]):
                    fits = j
            if fits is not None:
                cards.append((m.start() + groups[i][0], m.start() + groups[fits][1]))
            i = i + 1 if fits is None else fits + 1
        if cards:
            out += cards
        elif 8 <= len(digits) <= 15:
            out.append(m.span())
    return out


def run_on_phones(text: str) -> list[tuple[int, int]]:
    """Where a phone number runs into other digits, its words up to the last that keeps it a phone number."""
    out = []
    for m in _PHONE.finditer(text) if "+" in text else ():
        end, digits = 0, 0
        if sum("0" <= c <= "9" for c in m.group()) <= 15:
            continue
        for w in re.finditer(r"[^\x20]+", m.group()):
            digits += sum("0" <= c <= "9" for c in w.group())
            if digits > 15:
                break
            end = w.end() if digits >= 8 else end
        if end:
            out.append((m.start(), m.start() + end))
    return out


def brief(text: str, most: int = 64) -> str:
    """The text itself, or if it is longer, a digest of all of it: equal for equal texts only."""
    return text if len(text) <= most else "#" + hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def shape(token: str) -> str:
    """The token's pattern of digits (9), letters (a) and other characters, digit runs with their length.

    L marks a valid check digit. Secrets have their length and whether they are hexadecimal (H) or not (X).
    """
    if is_secret(token):
        return f"{'H' if re.fullmatch('[0-9a-fA-F]+', token) else 'X'}{len(token)}"
    out = ["L"] if "card" in kinds_fitted(token) else []
    for m in re.finditer(r"[0-9]+|[^\W\d_]+|.", token, re.S):
        run = m.group()
        out.append(f"9{len(run)}" if run[0].isdigit() else "a" if run[0].isalpha() else run)
    return brief("".join(out))


def _context(text: str, start: int, end: int) -> tuple[str, str, str]:
    """The two words before, the word before and the word after, however long; empty where there is none."""
    size = 64
    while True:  # a match that reaches the end of what was looked at may go on
        before = _WORDS_BEFORE.match(text[max(0, start - size) : start][::-1])
        if before.end() < size or size >= start:
            break
        size *= 4
    size = 64
    while True:
        after = _WORD_AFTER.match(text, end, end + size)
        if after.end() < end + size or end + size >= len(text):
            break
        size *= 4
    last, first = (brief((before.group(i) or "")[::-1].lower()) for i in (1, 2))
    return f"{first} {last}" if first else "", last, brief((after.group(1) or "").lower())


def mentions(text: str, hide: int = 0) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[int, int, str, str, str, str, str | None]]]:
    """Base spans, and (start, end, before2, before, after, shape, kind or None) of seeds and identifier-like tokens.

    With ``hide``, seeds whose crc32 it divides are listed without their kind, to measure how many come back.
    """
    spans = base_spans(text)
    taken = sorted((s, e, k) for k in KINDS for s, e in spans[k])
    starts = [t[0] for t in taken]
    widest = max((e - s for s, e, _ in taken), default=0)

    def free(s: int, e: int) -> bool:
        i = bisect.bisect_left(starts, e) - 1  # the last that starts before e
        while i >= 0 and starts[i] > s - widest:
            if taken[i][1] > s:
                return False
            i -= 1
        return True

    def take(more: list[tuple[int, int, str | None]]) -> None:
        nonlocal taken, starts, widest
        taken = sorted([*taken, *((s, e, k or "") for s, e, k in more)])
        starts = [t[0] for t in taken]
        widest = max((e - s for s, e, _ in taken), default=0)

    more: list[tuple[int, int, str | None]] = [(*m.span(1), "secret") for m in _SECRET.finditer(text) if is_secret(m.group(1)) and free(*m.span(1))]
    take(more)
    seeds = list(taken)
    for find in (run_on_phones, digit_runs):
        new = [(s, e, None) for s, e in find(text) if free(s, e)]
        take(new)
        more += new
    found = [(s, e, *_context(text, s, e), shape(text[s:e]), None if hide and zlib.crc32(text[s:e].encode()) % hide == 0 else k) for s, e, k in seeds]
    found += [(s, e, *_context(text, s, e), shape(text[s:e]), None) for s, e, k in more if k is None]
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        while start < end and text[start] in _EDGES:
            start += 1
        while start < end and text[end - 1] in _EDGES:
            end -= 1
        token = text[start:end]
        if (sum(c.isdigit() for c in token) >= 5 or "@" in token or is_secret(token)) and free(start, end):
            found.append((start, end, *_context(text, start, end), shape(token), None))
    return spans, found


def scanned(docs: DataFrame, id_col: str, text_col: str, hide: int = 0) -> DataFrame:
    """doc_id, uid, n_<kind>, base (kind:start:end joined), found (array of mentions). uid tells repeated rows apart."""
    src = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    mention = "array<struct<start:int,end:int,before2:string,before:string,after:string,shape:string,kind:string,instance:string,fits:string>>"
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base string, found {mention}"
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), *((k, pa.string()) for k in ("before2", "before", "after", "shape", "kind", "instance", "fits"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            base, found = [], []
            for t in b.column(1):
                text = t.as_py() or ""
                spans, seen = mentions(text, hide) if any(c in text for c in "0123456789@") else ({k: [] for k in KINDS}, [])
                for n, k in zip(counts, KINDS, strict=True):
                    n.append(len(spans[k]))
                base.append(",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in spans[k]))
                found.append([dict(zip(("start", "end", "before2", "before", "after", "shape", "kind", "instance", "fits"), (*m, brief(text[m[0] : m[1]]), kinds_fitted(text[m[0] : m[1]])), strict=True)) for m in seen])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(n, pa.int64()) for n in counts), pa.array(base, pa.string()), pa.array(found, arrow)], names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "found"])

    return src.mapInArrow(run, schema)


def patterns(edges: DataFrame) -> DataFrame:
    """Written table (pattern, kind) of the reliable patterns. edges: distinct (pattern, instance, kind or null)."""
    seeds = edges.groupBy("pattern").agg(F.count("kind").alias("seeds"), F.mode("kind", True).alias("kind"))
    confidence, total = None, 0.0
    while True:
        if confidence is None:
            rated = edges.withColumn("confidence", F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0))
        else:
            rated = edges.join(confidence, "instance")
        pattern = written(rated.groupBy("pattern").agg((F.sum("confidence") / (F.count(F.lit(1)) + PRIOR)).alias("reliability")))
        grown = pattern.agg(F.sum("reliability")).first()[0] or 0.0
        if confidence is not None:
            forget(confidence)
            forget(last)
        last = pattern
        if grown - total <= STEADY * grown:
            break
        total = grown
        confidence = written(edges.join(pattern, "pattern").groupBy("instance").agg(F.when(F.count("kind") > 0, 1.0).otherwise(F.max("reliability")).alias("confidence")))
    out = written(last.where(F.col("reliability") >= RELIABLE).join(seeds.where(F.col("seeds") >= SEEDS), "pattern").select("pattern", F.col("kind").alias("like")))
    forget(last)
    return out


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hide: int = 0) -> DataFrame:
    """One row per document: doc_id, counts and hash of the base spans, all spans and their number. ``hide``: see ``mentions``."""
    seen = written(scanned(docs, id_col, text_col, hide).withColumn("uid", F.monotonically_increasing_id()))
    one = seen.select("uid", F.explode("found").alias("m")).select("uid", "m.*")
    # a word on either side with the shape; two words before, or the words around, whatever the shape
    made = F.array(
        F.concat(F.lit("=|"), "shape"),
        F.when(F.col("before") != "", F.concat(F.lit("<"), "before", F.lit("|"), "shape")),
        F.when(F.col("after") != "", F.concat(F.lit(">"), "after", F.lit("|"), "shape")),
        F.when(F.col("before2") != "", F.concat(F.lit("<<"), "before2")),
        F.when((F.col("before") != "") & (F.col("after") != ""), F.concat(F.lit("<>"), "before", F.lit("|"), "after")),
    )
    with_pattern = one.withColumn("pattern", F.explode(F.array_compact(made)))
    edges = written(with_pattern.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")))
    good = patterns(edges)
    forget(edges)
    added = with_pattern.where("kind IS NULL").join(good, "pattern").where(F.array_contains(F.split("fits", ","), F.col("like"))).groupBy("uid", "start", "end").agg(F.min("like").alias("like"))
    added = added.groupBy("uid").agg(F.collect_list(F.struct(F.col("like").alias("kind"), "start", "end")).alias("added"))  # of one document
    base = F.transform(F.filter("found", lambda m: m["kind"].isNotNull()), lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    rank = lambda m: F.struct(F.array_position(F.array(*map(F.lit, ALL_KINDS)), m["kind"]).alias("k"), m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind"))
    every = F.array_sort(F.transform(F.concat(base, F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>"))), rank))
    out = seen.select("uid", "doc_id", *[f"n_{k}" for k in KINDS], "base", F.filter("found", lambda m: m["kind"].isNotNull()).alias("found")).join(added, "uid", "left")
    return out.select(
        "doc_id",
        *[f"n_{k}" for k in KINDS],
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform(every, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",").alias("spans"),
        F.size(every).cast("long").alias("n_spans"),
    )


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
