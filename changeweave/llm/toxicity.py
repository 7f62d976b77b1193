"""Toxicity by a lexicon that tolerates misspellings, with context windows that tell quotation from abuse.

The lexicon is learned from at most ``PER_LABEL`` labelled documents of each label: whole words, and word stems,
that occur in toxic documents clearly more often (lower confidence bound of the log odds). Its words sit in a
trie; a token is matched by intersecting the trie with the Levenshtein automaton of its length class: the product
automaton is built lazily, state by state, and states once built are table look-ups. Tokens that match no word are
tried against the stems, longest first. The lexicon takes every term of the sample that passes the bounds below, so
its size is bounded by the sample's: a term needs ``LEAST_DOCS`` toxic documents of it, and ``LEAST_SHARE`` of them.

Every hit is weighed by the tokens around it: quotation marks on both sides, or words of reporting, without an
address in the second person make it a quotation, which counts in features of its own. A logistic model over the
features, fitted on the same bounded sample, gives the score. Scoring reads every whole text in one scan.

Defined cases: null and empty texts have no hits and get the model's score for none; without labelled documents of
both labels a fixed model over the built-in words is used; null ids are scored, not held out and not learned from;
null labels are not learned from; a document labelled twice takes the larger label; of rows that repeat an id the
largest text is learned from; equal id hashes in the sample are ordered by id; repeated rows are scored each;
empty tables give empty results; other columns are ignored, or kept in ``drop_toxic``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeweave.llm.common import TOKENS, crc_bucket, quoted, table

#: Labelled documents per label that lexicon and model are fitted on, at most.
PER_LABEL = 4000
#: Lower bound of a term's log odds, and the share of the toxic sample that has it (4 documents at least).
LEAST_ODDS, LEAST_SHARE, LEAST_DOCS = 1.4, 0.008, 4
STEM_LENGTHS = range(3, 9)
#: Lexicon words that a stem has to begin, at least.
STEM_WORDS = 3
#: Words that are in every lexicon, with the log odds assumed for them.
BUILT_IN = ("asshole", "bastard", "bitch", "cretin", "dumbass", "idiot", "imbecile", "moron", "scumbag", "worthless")
BUILT_IN_ODDS = 4.0
REPORTING = frozenset("said says wrote writes quote quoted quotes called calls word term phrase insult slur sagte schrieb zitat wort nannte dit écrit mot cite terme dijo escribió palabra cita término".split())
ADDRESS = frozenset("you your yours yourself u ur youre du dich dir dein deine ihr euch tu toi te ton ta vous votre tú eres usted ustedes tus".split())
MARKS = "\"“”„«»‘’'"
WINDOW_TOKENS, WINDOW_CHARS = 6, 60
CACHE = 400_000
N_FEATURES = 7


def tolerance(word: str) -> int:
    """Edits allowed for a lexicon word."""
    return 0 if len(word) < 5 else 1 if len(word) < 9 else 2


class Matcher:
    """Trie of the words intersected with Levenshtein automata, determinised as it is used."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.stems, self.longest = stems, max(map(len, stems), default=0)
        self.shortest = min(map(len, stems), default=1)
        self.next: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.slack = [0]  # edits that some word below the node allows
        for w in sorted(words):
            n = 0
            self.slack[0] = max(self.slack[0], tolerance(w))
            for c in w:
                if c not in self.next[n]:
                    self.next[n][c] = len(self.next)
                    self.next.append({})
                    self.word.append(None)
                    self.slack.append(0)
                n = self.next[n][c]
                self.slack[n] = max(self.slack[n], tolerance(w))
            self.word[n] = w
        self.weights = words
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.steps: list[dict[str, int]] = []
        self.dead = self.state({})
        self.start = self.state(self.closure({0: 0}))

    def closure(self, s: dict[int, int]) -> dict[int, int]:
        """With the characters that the token may lack."""
        todo = list(s.items())
        while todo:
            n, e = todo.pop()
            for child in self.next[n].values():
                if e + 1 <= self.slack[child] and s.get(child, 99) > e + 1:
                    s[child] = e + 1
                    todo.append((child, e + 1))
        return s

    def state(self, s: dict[int, int]) -> int:
        key = tuple(sorted(s.items()))
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            ends = [(e, self.word[n]) for n, e in key if self.word[n] is not None and e <= tolerance(self.word[n])]
            best = min(ends) if ends else None
            self.accepts.append((best[1], best[0]) if best else None)
        return self.states[key]

    def step(self, at: int, c: str) -> int:
        s: dict[int, int] = {}
        for n, e in self.sets[at]:
            for k, child in self.next[n].items():
                cost = e + (k != c)
                if cost <= self.slack[child] and s.get(child, 99) > cost:
                    s[child] = cost
            if e + 1 <= self.slack[n] and s.get(n, 99) > e + 1:
                s[n] = e + 1
        to = self.steps[at][c] = self.state(self.closure(s))
        return to

    def find(self, token: str) -> tuple[str, str, float] | None:
        """(kind, term, weight): kind is exact, fuzzy or stem."""
        at, steps = self.start, self.steps
        for c in token:
            to = steps[at].get(c)
            at = self.step(at, c) if to is None else to
            if at == self.dead:
                break
        hit = self.accepts[at]
        if len(self.sets) > 200_000:
            self.reset()
        if hit:
            return ("fuzzy" if hit[1] else "exact", hit[0], self.weights[hit[0]])
        for k in range(min(self.longest, len(token)), self.shortest - 1, -1):
            if token[:k] in self.stems:
                return ("stem", token[:k], self.stems[token[:k]])
        return None


class Found(dict):
    """token -> find(token), computed once."""

    def __init__(self, matcher: Matcher):
        super().__init__()
        self.matcher = matcher

    def __missing__(self, token: str):
        if len(self) >= CACHE:
            self.clear()
        hit = self[token] = self.matcher.find(token)
        return hit


def is_quotation(text: str, tokens: list[str], k: int, start: int, end: int) -> tuple[bool, bool]:
    """(quotation, addressed) of the hit at token k, from the window around it."""
    around = tokens[max(0, k - WINDOW_TOKENS) : k] + tokens[k + 1 : k + 1 + WINDOW_TOKENS]
    addressed = any(t in ADDRESS for t in around)
    marked = any(c in MARKS for c in text[max(0, start - WINDOW_CHARS) : start]) and any(c in MARKS for c in text[end : end + WINDOW_CHARS])
    return (marked or any(t in REPORTING for t in around)) and not addressed, addressed


def features(text: str | None, found: Found) -> list[float]:
    low = (text or "").lower()
    tokens = TOKENS.findall(low)
    hits = [(k, h) for k, t in enumerate(tokens) if (h := found[t]) is not None]
    if not hits:
        return [0.0] * N_FEATURES
    wanted = {k for k, _ in hits}
    spans = {k: m.span() for k, m in enumerate(TOKENS.finditer(low)) if k in wanted}
    best: dict[str, dict[str, float]] = {"exact": {}, "fuzzy": {}, "stem": {}, "quoted": {}}
    direct = quoted_hits = addressed_hits = 0
    for k, (kind, term, weight) in hits:
        quotation, addressed = is_quotation(low, tokens, k, *spans[k])
        if quotation:
            quoted_hits += 1
            kind = "quoted"
        else:
            direct += 1
            addressed_hits += addressed
        best[kind][term] = weight
    sums = {k: sum(v.values()) for k, v in best.items()}
    return [sums["exact"], sums["fuzzy"], sums["stem"], sums["quoted"], math.log1p(direct), math.log1p(addressed_hits), direct / math.sqrt(len(tokens))]


def odds_bound(n1: int, n0: int, all1: int, all0: int) -> tuple[float, float]:
    """Log odds of a term, smoothed, and their lower bound."""
    odds = math.log((n1 + 0.5) / (all1 + 1)) - math.log((n0 + 0.5) / (all0 + 1))
    return odds, odds - 1.96 * math.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))


def _terms(sample: DataFrame, units, all1: int, all0: int) -> list[tuple[str, int, int]]:
    """(term, toxic documents, other documents) of the terms that enough toxic documents have; units: text -> set of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                counts[y].update(units(text.as_py()))
            names = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][t] for t in names], pa.int64()), pa.array([counts[0][t] for t in names], pa.int64())], names=["term", "n1", "n0"])

    least = max(LEAST_DOCS, math.ceil(LEAST_SHARE * all1))
    counted = sample.select("text", "toxic").mapInArrow(run, "term string, n1 long, n0 long").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).where(F.col("n1") >= least)
    # the bound of the log odds is below the odds themselves: what they exclude here, it would exclude
    odds = F.log((F.col("n1") + 0.5) / (all1 + 1)) - F.log((F.col("n0") + 0.5) / (all0 + 1))
    return sorted((r[0], r[1], r[2]) for r in counted.where(odds >= LEAST_ODDS).collect())


def learn_lexicon(sample: DataFrame, all1: int, all0: int) -> tuple[dict[str, float], dict[str, float]]:
    """(words, stems) with their log odds. sample: text, toxic."""
    words = {w: BUILT_IN_ODDS for w in BUILT_IN}
    if not all1 or not all0:
        return words, {}

    def kept(units) -> list[tuple[float, float, str]]:
        rows = [(*odds_bound(n1, n0, all1, all0)[::-1], t) for t, n1, n0 in _terms(sample, units, all1, all0)]
        return sorted((r for r in rows if r[0] >= LEAST_ODDS), key=lambda r: (-r[0], r[2]))

    words |= {t: odds for _, odds, t in kept(lambda text: {t for t in TOKENS.findall((text or "").lower()) if len(t) >= 4})}

    def stems_of(text: str | None) -> set[str]:
        return {t[:k] for t in set(TOKENS.findall((text or "").lower())) for k in STEM_LENGTHS if len(t) >= k}

    stems: dict[str, tuple[float, float]] = {}
    families = Counter(w[:k] for w in words for k in STEM_LENGTHS if len(w) > k)
    for bound, odds, t in sorted(kept(stems_of), key=lambda r: (len(r[2]), r[2])):  # a longer stem only if it says clearly more
        if families[t] < STEM_WORDS:  # one word isn't a stem
            continue
        above = [stems[t[:k]][0] for k in STEM_LENGTHS if k < len(t) and t[:k] in stems]
        if not above or bound > max(above) + 0.7:
            stems[t] = (bound, odds)
    return words, {t: odds for t, (_, odds) in stems.items()}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and bias by Newton steps with a ridge on the weights."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


#: Used where there is nothing to fit: hits raise the score, quotations hardly.
DEFAULT_WEIGHTS = np.array([0.9, 0.6, 0.6, 0.05, 0.5, 0.5, 0.1, -3.0])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = PER_LABEL) -> dict:
    """Lexicon and model of a bounded sample of the labelled rows: words, stems, weights."""
    marks = labels.select(quoted(id_col).alias("doc_id"), quoted(label_col).cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = marks.join(docs.select(quoted(id_col).alias("doc_id")).distinct(), "doc_id")
    chosen: dict[int, int] = {}
    for y in (0, 1):
        chosen |= {r[0]: y for r in known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label).collect()}
    if not chosen:
        return {"words": {w: BUILT_IN_ODDS for w in BUILT_IN}, "stems": {}, "weights": DEFAULT_WEIGHTS}
    toxic_ids, ids = [i for i, y in chosen.items() if y], list(chosen)
    sample = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text")).where(F.col("doc_id").isin(ids)).withColumn("toxic", F.col("doc_id").isin(toxic_ids).cast("int"))
    sample = sample.groupBy("doc_id", "toxic").agg(F.max(F.coalesce("text", F.lit(""))).alias("text")).select("doc_id", "text", "toxic").persist()
    try:
        n = dict(sample.groupBy("toxic").count().collect())
        words, stems = learn_lexicon(sample, n.get(1, 0), n.get(0, 0))
        if not n.get(1) or not n.get(0):
            return {"words": words, "stems": stems, "weights": DEFAULT_WEIGHTS}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = Found(Matcher(words, stems))
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t.as_py(), found) for t in b.column(2)], pa.list_(pa.float64()))], names=["id", "toxic", "x"])

        rows = sorted(sample.select(F.col("doc_id").cast("string").alias("id"), "toxic", "text").mapInArrow(run, "id string, toxic int, x array<double>").collect())
    finally:
        sample.unpersist()
    return {"words": words, "stems": stems, "weights": logistic(np.array([r[2] for r in rows]), np.array([r[1] for r in rows], float))}


def score(docs: DataFrame, model: dict, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep + score, predicted."""
    src = docs.select(*[quoted(c) for c in keep], quoted(text_col).alias("__cw_text"))
    schema = src.drop("__cw_text").schema.add("score", "double").add("predicted", "integer")
    state = docs.sparkSession.sparkContext.broadcast(model)  # the terms of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = state.value
        found = Found(Matcher(m["words"], m["stems"]))
        w = m["weights"]
        for b in batches:
            p = [1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(features(t.as_py(), found), w[:-1]) + w[-1]))))) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32())], names=[f.name for f in schema])

    return src.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    names = [f"__cw_{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*names)
    judged = score(renamed, model, names, names[docs.columns.index(text_col)])
    return judged.where("predicted = 0").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_bucket(F.col("doc_id"), 5) == 0, F.lit(False))
    model = fit(docs.where(~held), table(spark, sf_dir, "labels").where(crc_bucket(F.col("doc_id"), 5) != 0))
    return score(docs.select("doc_id", "text", held.alias("held_out")), model, ["doc_id", "held_out"])
