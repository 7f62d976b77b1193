"""Language identification by hierarchical discrimination.

A text is first given to a language family by one-versus-rest linear support vector machines, then, inside the
family, to a language by one-versus-one linear SVMs that vote. Features are hashed character 1- to 3-grams of the
lower-cased letters, square-rooted and scaled to length 1.

Training takes at most ``PER_LANGUAGE`` labelled documents of each language (the smallest id hashes), so what
comes to the driver is bounded by that many sparse vectors; prediction reads every whole text in one scan, long
texts ``CHUNK`` characters at a time.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without any labelled document every
text is ``und``; a null id is not held out and not learned from; null langs are not learned from; repeated rows are
predicted each; one language alone is predicted with score 1; ties of votes go to the larger product of chances, then to the larger
name; rows of one id count as labelled rows each; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changeweave.llm.common import crc_bucket, letter_runs, quoted, table

#: Labelled documents per language that a model is fitted on, at most.
PER_LANGUAGE = 400
DIMENSIONS = 1 << 15
CHUNK = 1 << 20
EPOCHS = 12
#: Highest bits of the id hashes by which a language's rows are counted before the smallest are ranked.
RANGE_BITS = 12
#: Language -> family, by ISO 639-1 code; a language not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "uralic": ("et", "fi", "hu"),
    "celtic": ("br", "cy", "ga", "gd"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "semitic": ("am", "ar", "he", "mt"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "austronesian": ("id", "jv", "ms", "tl"),
}


def family_of(lang: str) -> str:
    return next((f for f, ls in FAMILIES.items() if lang in ls), f"={lang}")


def letters(text: str) -> str:
    """The lower-cased runs of letters, with one space between and around them."""
    return "".join(pieces(text, len(text) or 1))


def pieces(text: str, chunk: int) -> Iterator[str]:
    """``letters`` in pieces, from ``chunk`` characters at a time: joined they are the same whatever the chunk."""
    inside, any_run = False, False  # whether the last piece ended within a run
    for i in range(0, len(text), chunk):
        part = text[i : i + chunk]
        runs = letter_runs(part)
        if runs:
            joined = " ".join(runs).lower()
            yield joined if inside and part.startswith(runs[0]) else " " + joined
            any_run = True
            inside = part.endswith(runs[-1])
        else:
            inside = False
    if any_run:
        yield " "


def gram_counts(text: str, chunk: int = CHUNK) -> np.ndarray | None:
    """Hashed counts of character 1- to 3-grams; None without a letter. Two characters are carried from chunk to chunk."""
    total, held = None, np.zeros(0, np.uint64)
    for part in pieces(text, chunk):
        new = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        c = np.concatenate([held, new])
        if total is None:
            total = np.zeros(DIMENSIONS)
        h = np.zeros(len(c), np.uint64)
        for n in range(1, 4):
            h = h[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :] + np.uint64(n)
            fresh = h[max(0, len(held) - n + 1) :]  # grams that end in the new characters
            slot = (fresh * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)
            total += np.bincount(slot.astype(np.int64), minlength=DIMENSIONS)
        held = c[-2:]
    return total


def features(text: str | None) -> np.ndarray | None:
    counts = gram_counts(text or "")
    if counts is None:
        return None
    x = np.sqrt(counts)
    return (x / np.linalg.norm(x)).astype(np.float32)


class Rows:
    """Sparse feature vectors: memory follows what they hold, not the dimensions."""

    def __init__(self, at: list[np.ndarray], values: list[np.ndarray]):
        self.at, self.values = at, values
        self.norms = [float(v @ v) + 1.0 for v in values]  # with the bias


def svm(x: Rows, own: np.ndarray, y: np.ndarray, c: float = 10.0) -> np.ndarray:
    """Linear SVM by dual coordinate descent (hinge loss) on the rows ``own`` with labels y of -1 or 1. The last weight is the bias."""
    w, a = np.zeros(DIMENSIONS + 1, np.float32), np.zeros(len(own))
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(own)):
            at, v = x.at[own[i]], x.values[own[i]]
            g = y[i] * (float(v @ w[at]) + float(w[-1])) - 1
            new = min(max(a[i] - g / x.norms[own[i]], 0.0), c)
            if new != a[i]:
                step = np.float32((new - a[i]) * y[i])
                w[at] += step * v
                w[-1] += step
                a[i] = new
    return w


class Model:
    """Weights of all machines, stacked: families one-versus-rest, then each family's pairs of languages."""

    def __init__(self, x: Rows, langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family_of(g) for g in self.langs})
        own = np.array([family_of(g) for g in langs])
        langs, every = np.array(langs), np.arange(len(langs))
        rows = [svm(x, every, np.where(own == f, 1.0, -1.0)) for f in self.families] if len(self.families) > 1 else []
        self.pairs = []
        for f in self.families:
            for a, b in combinations([g for g in self.langs if family_of(g) == f], 2):
                at = np.flatnonzero((langs == a) | (langs == b))
                self.pairs.append((a, b, len(rows)))
                rows.append(svm(x, at, np.where(langs[at] == a, 1.0, -1.0)))
        self.weights = np.array(rows, np.float32).reshape(len(rows), DIMENSIONS + 1)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        margins = self.weights[:, :-1] @ x + self.weights[:, -1]
        family, sure = self.families[0], 1.0
        if len(self.families) > 1:
            m = margins[: len(self.families)]
            e = np.exp(2 * (m - m.max()))
            family, sure = self.families[int(m.argmax())], float(e.max() / e.sum())
        inside = [g for g in self.langs if family_of(g) == family]
        if len(inside) == 1:
            return inside[0], sure
        votes, chance = dict.fromkeys(inside, 0), dict.fromkeys(inside, 1.0)
        for a, b, k in self.pairs:
            if a in votes:
                p = 1 / (1 + np.exp(-2 * float(margins[k])))
                votes[a if p >= 0.5 else b] += 1
                chance[a] *= p
                chance[b] *= 1 - p
        best = max(inside, key=lambda g: (votes[g], chance[g], g))
        return best, sure * chance[best] / sum(chance.values())


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """The model of a bounded sample of the labelled rows."""
    labelled = docs.select(quoted(id_col).alias("doc_id"), quoted(lang_col).alias("lang")).where("lang IS NOT NULL AND doc_id IS NOT NULL")
    # rows are counted by the highest bits of their hashes; only the ranges that hold the smallest ones are ranked
    hashed = labelled.distinct().withColumn("h", F.xxhash64("doc_id")).withColumn("part", F.shiftright("h", 64 - RANGE_BITS))
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # 2 ** RANGE_BITS rows at most
    parts = hashed.groupBy("lang", "part").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).where(F.col("before") < per_language)
    first = Window.partitionBy("lang").orderBy("h", "doc_id")
    few = hashed.join(parts.select("lang", "part"), ["lang", "part"], "left_semi")
    chosen = few.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= per_language).select("doc_id").distinct()
    ids = [r[0] for r in chosen.collect()]  # per_language ids for each language
    if not ids:
        return None
    sample = docs.select(quoted(id_col).alias("doc_id"), quoted(lang_col).alias("lang"), quoted(text_col).alias("text")).where(F.col("doc_id").isin(ids) & F.col("lang").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(i, g, x) for i, g, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True) if (x := features(t)) is not None]
            at = [np.flatnonzero(x) for _, _, x in got]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g for _, g, _ in got], pa.string()), pa.array([str(i) for i, _, _ in got], pa.string()), pa.array([a.astype(np.int32).tobytes() for a in at], pa.binary()), pa.array([x[a].tobytes() for a, (_, _, x) in zip(at, got, strict=True)], pa.binary())],
                names=["lang", "id", "at", "x"],
            )

    rows = sorted(sample.mapInArrow(run, "lang string, id string, at binary, x binary").collect(), key=lambda r: (r[0], r[1], bytes(r[2])))
    if not rows:
        return None
    x = Rows([np.frombuffer(r[2], np.int32) for r in rows], [np.frombuffer(r[3], np.float32) for r in rows])
    return Model(x, [r[0] for r in rows])


def predict(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep + lang_pred, score."""
    state = docs.sparkSession.sparkContext.broadcast(vars(model)) if model else None
    src = docs.select(*[quoted(c) for c in keep], quoted(text_col).alias("__cw_text"))
    schema = src.drop("__cw_text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = None
        if state is not None:
            m = Model.__new__(Model)
            m.__dict__.update(state.value)
        for b in batches:
            names, scores = [], []
            for t in b.column(b.num_columns - 1):
                x = features(t.as_py()) if m else None
                lang, score = m.predict(x) if x is not None else ("und", 0.0)
                names.append(lang)
                scores.append(float(score))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[f.name for f in schema])

    return src.mapInArrow(run, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_bucket(F.col("doc_id"), 3) == 1, F.lit(False))
    model = fit(docs.where(~held))
    return predict(docs.select("doc_id", "text", held.alias("held_out")), model, ["doc_id", "held_out"])
