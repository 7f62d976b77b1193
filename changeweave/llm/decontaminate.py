"""Benchmark decontamination with a distributed positional inverted index.

1. Index: every task writes, for one shard of documents of about ``SHARD_BYTES`` of text at a time, the postings of all
   its terms, one row (shard, term, number, positions) each, sorted by term, and where its documents start. It is a
   table in the shared folder: phrases and proximity queries are asked of it, as often as one likes. The shard is the
   document part of the key, so a term that every text has is many rows, none longer than a shard. Files keep the
   order of the documents; a layout by term would put a hot term's postings into one task.
2. Document frequencies of the terms of the test set come from the index by aggregation; a phrase one of whose terms
   the index doesn't have is done. Each other phrase meets the postings of its rarest term: these shards may have it.
3. Shard by shard, the lists of those phrases' terms are intersected: the list of the term that is rarest in the shard
   is shifted by the term's offset and looked up in the shifted lists of the others, rarest first. Of the postings,
   only terms of the test set and shards that may have a phrase are moved. Neither phrases nor postings come to the
   driver, and nothing is broadcast but what Spark finds small when it runs.

Windows: ``n`` consecutive words of an item; an item with fewer words, but not none, is one window.
``proximity_matches`` answers the looser question from the same index: which documents have all distinct terms of a
query within a span of so many words, in any order.

Defined cases: null and wordless texts have 0 words and hits; null items and items without words match nothing;
rows repeating an item_id are one item; repeated documents are judged each; a null item_id is ignored; empty tables
give no row or no hit; ties of rarity go to the smaller offset; other columns are ignored, or kept in
``drop_contaminated``, which judges equal texts alike.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeweave.llm.common import forget, quoted, split_alnum, table, written

N = 8
MIN_ITEMS = 2
#: Bytes of text in one shard of the index (a longer document is a shard of its own).
SHARD_BYTES = 4_000_000
#: Candidate positions intersected at once.
CANDIDATES = 1_000_000
#: The row of a shard that holds where its documents start, and where the last one ends; no word is empty.
STARTS = ""


def windows_of(words: list[bytes], n: int = N) -> list[list[bytes]]:
    if len(words) <= n:
        return [words] if words else []
    return [words[i : i + n] for i in range(len(words) - n + 1)]


def shards(batch: pa.RecordBatch, col: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose texts together have about ``most`` bytes, in order."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for i, s in enumerate(sizes):
        if i > lo and held + s > most:
            yield batch.slice(lo, i - lo)
            lo, held = i, 0
        held += s
    if lo < batch.num_rows:
        yield batch.slice(lo)


def postings_of(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Terms in order, how often each occurs, their positions one after another, and the starts of the documents.

    A position is left free after every document, so that no phrase crosses from one to the next. The words of one
    document are held at a time.
    """
    vocabulary: defaultdict[bytes, int] = defaultdict()
    vocabulary.default_factory = vocabulary.__len__
    ids, starts = [], np.zeros(len(texts) + 1, np.int64)
    for k, text in enumerate(texts):
        words = split_alnum(text) if text else []
        own = np.full(len(words) + 1, -1, np.int32)
        own[:-1] = np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words))
        ids.append(own)
        starts[k + 1] = starts[k] + len(own)
    terms = sorted(vocabulary)
    rank = np.zeros(len(terms) + 1, np.int32)
    rank[np.fromiter(map(vocabulary.__getitem__, terms), np.int64, len(terms))] = np.arange(len(terms))
    rank[-1] = -1
    token = rank[np.concatenate([*ids, np.zeros(0, np.int32)])]
    at = np.flatnonzero(token >= 0)
    return terms, np.bincount(token[at], minlength=len(terms)), at[np.argsort(token[at], kind="stable")], starts


def _gaps(positions: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions of every list as differences, the first of a list as it is: few bytes once compressed."""
    out = np.diff(positions, prepend=0)
    at = first[:-1][first[:-1] < first[1:]]
    out[at] = positions[at]
    return out.astype(np.int32)


def _positions(gaps: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.cumsum(gaps, dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1][counts > 0]
    return total - np.repeat(total[first] - gaps[first], counts[counts > 0])


class Index:
    """The stored index: ``postings`` (shard, term, n, positions) and ``documents`` (shard, nth, n_words and kept columns)."""

    def __init__(self, stored: DataFrame, keep: list[str]):
        self.stored, self.keep = stored, keep
        self.postings = stored.where("term IS NOT NULL").select("shard", "term", "n", "positions")
        self.documents = stored.where("term IS NULL").select("shard", "nth", F.col("n").alias("n_words"), *[F.col(f"__cw_{i}").alias(c) for i, c in enumerate(keep)])

    def forget(self) -> None:
        forget(self.stored)

    def occurrences(self, phrases: DataFrame) -> DataFrame:
        """(shard, nth, phrase, n_hit) from distinct ``phrase`` strings, words between single blanks.

        One row with a phrase for each phrase that a document has, and one without, with the number of its words that any
        phrase covers.
        """
        return self._answers(phrases.select(F.col("phrase"), F.split("phrase", " ").alias("terms")), _find, "nth int, phrase string, n_hit long")

    def covers(self, queries: DataFrame, span: int) -> DataFrame:
        """(shard, nth, phrase, start, length): the first shortest stretch of at most ``span`` words of a document with all
        terms of the query, from (phrase, words between single blanks)."""
        return self._answers(queries.select("phrase", F.array_distinct(F.split("phrase", " ")).alias("terms")), lambda s, p: _cover(s, p, span), "nth int, phrase string, start long, length long")

    def _answers(self, asked: DataFrame, answer, columns: str) -> DataFrame:
        each = asked.select("phrase", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("offset", "term"))
        # written: Spark then knows the sizes of the test set's side before it plans to move the index's
        vocabulary = written(each.select("term").distinct().union(self.stored.sparkSession.createDataFrame([(STARTS,)], "term string")))
        frequency = self.postings.join(vocabulary, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
        rarest = F.min(F.struct("df", "offset", "term"))
        rare = each.join(frequency, "term").groupBy("phrase", "n_terms").agg(F.count(F.lit(1)).alias("have"), rarest.alias("r")).where("have = n_terms").select("phrase", F.col("r.term").alias("term"))
        rare = written(rare)
        places = written(rare.join(self.postings.select("term", F.col("shard").alias("place")), "term").select("place", "phrase"))
        forget(rare)
        # the lists of the test set's terms, in the shards that may have a phrase
        lists = self.postings.join(vocabulary, "term", "left_semi").join(places.select(F.col("place").alias("shard")).distinct(), "shard", "left_semi")

        def run(key: tuple, phrases: pa.Table, lists: pa.Table) -> pa.Table:
            got = answer(Shard.of(lists), phrases["phrase"].to_pylist()) if phrases.num_rows else []
            rows = list(zip(*got, strict=True)) or [()] * (len(schema) - 1)
            return pa.table([pa.array([key[0].as_py()] * len(got), pa.int64()), *(pa.array(list(r), t.type) for r, t in zip(rows, list(schema)[1:], strict=True))], schema=schema)

        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        schema = to_arrow_schema(StructType.fromDDL(f"shard long, {columns}"))
        return places.groupBy("place").cogroup(lists.groupBy("shard")).applyInArrow(run, f"shard long, {columns}")


def build_index(docs: DataFrame, keep: list[str], text_col: str = "text", shard_bytes: int | None = None) -> Index:
    """The index of all words of all texts, as a written table."""
    most = shard_bytes or SHARD_BYTES
    src = docs.select(*[quoted(c).alias(f"__cw_{i}") for i, c in enumerate(keep)], quoted(text_col).cast("binary").alias("__cw_text"))
    schema = src.drop("__cw_text").schema.add("shard", "long").add("nth", "integer").add("term", "string").add("n", "long").add("positions", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in shards(batch, batch.num_columns - 1, most):
                terms, counts, positions, starts = postings_of(part.column(part.num_columns - 1).to_pylist())
                k, d = len(terms) + 1, part.num_rows
                first = np.concatenate([[0, len(starts)], len(starts) + np.cumsum(counts)])
                data = _gaps(np.concatenate([starts, positions]), first)
                lists = pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer((first * 4).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
                names = [f.name for f in schema]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([shard] * d, pa.int64()), pa.array(range(d), pa.int32()), pa.nulls(d, pa.string()), pa.array(np.diff(starts) - 1, pa.int64()), pa.nulls(d, pa.binary())], names=names)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.nulls(k, c.type) for c in part.columns[:-1]), pa.array([shard] * k, pa.int64()), pa.nulls(k, pa.int32()), pa.array([STARTS, *(t.decode() for t in terms)], pa.string()), pa.array([len(starts), *counts.tolist()], pa.int64()), lists],
                    names=names,
                )
                shard += 1

    return Index(written(src.mapInArrow(run, schema)), keep)


class Shard:
    """Postings of a shard, of some terms."""

    def __init__(self, terms: list[str], counts: np.ndarray, positions: np.ndarray, starts: np.ndarray):
        self.vocabulary = {t: i for i, t in enumerate(terms)}
        self.counts, self.positions, self.starts, self.size = counts, positions, starts, int(starts[-1])
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.keys = np.repeat(np.arange(len(counts)), counts) * self.size + positions  # ascending: by term, then position

    @classmethod
    def of(cls, rows: pa.Table) -> Shard:
        terms, counts = rows["term"].to_pylist(), rows["n"].to_numpy().astype(np.int64)
        every = _positions(np.frombuffer(b"".join(rows["positions"].to_pylist()), np.int32), counts)
        lists = np.split(every, np.cumsum(counts)[:-1])
        at = terms.index(STARTS)
        kept = [i for i in range(len(terms)) if i != at]
        return cls([terms[i] for i in kept], counts[kept], np.concatenate([*(lists[i] for i in kept), np.zeros(0, np.int64)]), lists[at])

    def has(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Whether each term's list holds each position."""
        if not len(self.keys):
            return np.zeros(len(positions), bool)
        want = terms * self.size + positions
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return (self.keys[at] == want) & (positions >= 0) & (positions < self.size)

    def find(self, terms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Chunks of (phrase row, start position), every occurrence once. terms: a row of term numbers per phrase, padded with -1."""
        if not len(terms) or not len(self.positions):
            return
        freq = np.where(terms >= 0, self.counts[terms], np.iinfo(np.int64).max)
        order = np.argsort(freq, axis=1, kind="stable")
        rarest = freq[np.arange(len(terms)), order[:, 0]]
        edges = np.searchsorted(np.cumsum(rarest), np.arange(0, rarest.sum() + CANDIDATES, CANDIDATES), side="left")
        edges = np.unique(np.concatenate([edges, [0, len(terms)]]).astype(np.int64))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            t, o, n = terms[lo:hi], order[lo:hi], rarest[lo:hi]
            which = np.repeat(np.arange(hi - lo), n)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            start = self.positions[self.first[t[np.arange(hi - lo), o[:, 0]]][which] + nth] - o[which, 0]
            for k in range(1, terms.shape[1]):
                offset = o[which, k]
                term = t[which, offset]
                ok = (term < 0) | self.has(term, start + offset)
                which, start = which[ok], start[ok]
                if not len(which):
                    break
            if len(which):
                yield which + lo, start

    def doc(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1


def _find(shard: Shard, phrases: list[str]) -> list[tuple]:
    split = [[shard.vocabulary.get(t, -1) for t in p.split(" ")] for p in phrases]
    rows = [(p, t) for p, t in zip(phrases, split, strict=True) if min(t) >= 0]  # the others lack a term here
    if not rows:
        return []
    lengths = np.array([len(t) for _, t in rows])
    terms = np.full((len(rows), int(lengths.max())), -1, np.int64)
    for i, (_, t) in enumerate(rows):
        terms[i, : len(t)] = t
    delta, met = np.zeros(shard.size + 1, np.int64), []
    for row, start in shard.find(terms):
        np.add.at(delta, start, 1)
        np.add.at(delta, start + lengths[row], -1)
        met.append(np.unique(np.stack([shard.doc(start), row]), axis=1))
    if not met:
        return []
    pairs = np.unique(np.concatenate(met, axis=1), axis=1)
    hits = np.concatenate([[0], np.cumsum(np.cumsum(delta[:-1]) > 0)])
    docs = np.unique(pairs[0])
    out = [(d, rows[r][0], None) for d, r in pairs.T.tolist()]
    return out + [(d, None, n) for d, n in zip(docs.tolist(), (hits[shard.starts[docs + 1]] - hits[shard.starts[docs]]).tolist(), strict=True)]


def _cover(shard: Shard, queries: list[str], span: int) -> list[tuple]:
    out = []
    for q in queries:
        terms = [shard.vocabulary.get(t, -1) for t in set(q.split(" "))]
        if min(terms) < 0:
            continue
        lists = [shard.positions[shard.first[t] : shard.first[t + 1]] for t in terms]
        common = set.intersection(*(set(np.unique(shard.doc(x)).tolist()) for x in lists))
        for d in sorted(common):
            lo, hi = shard.starts[d], shard.starts[d + 1]
            best = shortest_cover([x[np.searchsorted(x, lo) : np.searchsorted(x, hi)] - lo for x in lists], span)
            if best:
                out.append((d, q, *best))
    return out


def benchmark_windows(benchmark: DataFrame, n: int = N, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (phrase, item): every window of every item."""
    rows = benchmark.select(quoted(id_col).cast("string").alias("item"), quoted(text_col).cast("binary").alias("text")).where("item IS NOT NULL AND text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = sorted({b" ".join(w).decode() for w in windows_of(split_alnum(text), n)})
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.string()), pa.array([item] * len(got), pa.string())], names=["phrase", "item"])

    return rows.mapInArrow(run, "phrase string, item string").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, n: int = N, min_items: int = MIN_ITEMS, text_col: str = "text") -> DataFrame:
    """The kept columns of every document, and n_words, n_hit, n_items, items_sha256, contaminated. The index is written at once."""
    keep = ["doc_id"] if keep is None else keep
    index = build_index(docs, keep, text_col)
    windows = written(benchmark_windows(benchmark, n))
    found = index.occurrences(windows.select("phrase").distinct())
    named = found.join(windows, "phrase", "left").groupBy("shard", "nth").agg(F.max("n_hit").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return index.documents.join(named, ["shard", "nth"], "left").select(
        *[quoted(c) for c in keep],
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size(items) >= min_items).alias("contaminated"),
    )


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, min_items: int = MIN_ITEMS, text_col: str = "text") -> DataFrame:
    """The clean documents, with all their columns. A verdict holds for a text, so that documents meet it by the text's digest."""
    judged = contamination(docs.select(_digest(quoted(text_col)).alias("sha"), quoted(text_col).alias("text")), benchmark, ["sha"], n, min_items)
    bad = judged.where("contaminated").select(F.col("sha").alias("__cw_bad")).distinct()
    return docs.join(bad, _digest(quoted(text_col)) == F.col("__cw_bad"), "left_anti")


def proximity_matches(docs: DataFrame, queries: dict[str, str], span: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, query, start, length) of the first shortest stretch of at most ``span`` words with all terms of the query.

    queries: name -> words. They are stated by the caller, so that their table is small.
    """
    index = build_index(docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text")), ["doc_id"])
    asked = [(q, b" ".join(sorted(set(split_alnum(t.encode())))).decode()) for q, t in sorted(queries.items())]
    named = docs.sparkSession.createDataFrame([a for a in asked if a[1]], "query string, phrase string")
    found = index.covers(named.select("phrase").distinct(), span)
    return found.join(named, "phrase").join(index.documents, ["shard", "nth"]).select("doc_id", "query", "start", "length")


def shortest_cover(lists: list[np.ndarray], span: int) -> tuple[int, int] | None:
    """Start and length of the first shortest stretch that meets every list, if at most span long."""
    if not lists or any(len(x) == 0 for x in lists):
        return None
    at = np.concatenate(lists)
    own = np.concatenate([np.full(len(x), i) for i, x in enumerate(lists)])
    order = np.argsort(at, kind="stable")
    last, best = {}, None
    for p, k in zip(at[order].tolist(), own[order].tolist(), strict=True):
        last[k] = p
        if len(last) == len(lists):
            start = min(last.values())
            if p - start + 1 <= span and (best is None or p - start + 1 < best[1]):
                best = (start, p - start + 1)
    return best


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(len(w), {N}) AS n, array_to_string(w[i : i + least(len(w), {N}) - 1], ' ') AS win
  FROM b, unnest(range(1, greatest(len(w) - {N} + 1, 1) + 1)) AS r(i) WHERE len(w) > 0
), ns AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM d CROSS JOIN ns, unnest(range(1, len(w) - n + 2)) AS r(i) WHERE len(w) >= n
), m AS (SELECT dw.doc_id, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_items, 0) >= {MIN_ITEMS} AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
