"""Substring deduplication: Rabin-Karp hashes of every fixed-length token window, counted in Spark.

1. Documents are dealt by a hash of id and text into blocks of about ``BLOCK_BYTES`` of text.
2. Each block hashes all its windows (a polynomial over 64-bit word hashes, modulo 2^64, finalised), sorts and
   pre-counts them, and sends each bucket of the hash range that it has any for one row with its distinct hashes,
   ``SHORT`` bytes each beside the bits that the bucket implies. A window that a third of all documents share is one
   entry per block. Rows are never more than the block's windows, however many buckets there are.
3. Each bucket finds the short hashes that two blocks sent and answers every block with one bit per hash it sent. The
   number of buckets follows the size of the input, so a bucket's memory doesn't.
4. Windows that were found twice, elsewhere or within their block, are only candidates. Each block hashes them again to
   128 bits (the word hashes being independent ones), and the same counting by bucket decides which repeat.
5. Each block marks the confirmed windows and merges covered words into maximal removal intervals. Its texts come from
   the same shuffle in all three steps, which Spark reuses.

Blocks, buckets and the order within them depend on the data only, so a lost executor's tasks redo the same rows.
Two different windows are taken for equal only if 128 bits collide: for w windows about w^2 / 6.8e38 of them.

Defined cases: null and blank texts have no words; a text shorter than the window is kept; the windows of one
document count against each other; repeated rows are documents of their own (rows equal in id and text lie in one
block); null ids are dealt by their texts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeweave.llm.common import quoted, split_words, table

WINDOW = 35
BLOCK_BYTES = 6_000_000
BUCKET_BYTES = 6_000_000
BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: Word hashes a worker keeps; beyond it the table is emptied, which changes no hash.
WORD_CACHE = 150_000


#: Bytes of a hash in the first count, beside the bits of its bucket.
SHORT = 5
#: Text that one task of the block steps reads, about.
TASK_BYTES = 48_000_000


class WordHash(dict):
    """word -> 64-bit hash, computed once."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64, for i < n."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = 1 << max(n - 1, 1).bit_length()
        inverse = pow(BASE, -1, 1 << 64)
        both = []
        for b in (BASE, inverse):
            p = np.full(size, np.uint64(b))
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _POWERS[0] = tuple(both)
    return have[0][:n], have[1][:n]


def window_hashes(words: np.ndarray, window: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``window`` words; words are their uint64 hashes."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(words))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * down, dtype=np.uint64)])
    return mixed((prefix[window:] - prefix[:-window]) * up[:n])


def covered(repeated: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Which words lie in a repeated window: the union of the windows, that is the maximal removal intervals."""
    delta = np.zeros(n_words + 1, np.int64)
    at = np.flatnonzero(repeated)
    delta[at] += 1
    np.subtract.at(delta, at + window, 1)
    return np.cumsum(delta[:-1]) > 0


class Block:
    """The documents of a block in an order that depends on the data only, their words, and the hashes of their windows."""

    def __init__(self, rows: pa.Table, window: int, bits: int):
        rows = rows.combine_chunks()
        self.window, self.bits = window, bits
        ids, texts = rows["doc_id"].to_pylist(), rows["text"].to_pylist()
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i], texts[i] or b""))
        self.ids = rows["doc_id"].take(pa.array(self.order, pa.int64()))
        self.words = [split_words(texts[i] or b"") for i in self.order]
        self.first = self._hashes(self.words, 0)
        every = np.concatenate([*self.first, np.zeros(0, np.uint64)])
        # bucket bits, then the lowest SHORT bytes: what the first count compares
        short = (every >> np.uint64(64 - bits)) << np.uint64(8 * SHORT) if bits else np.zeros(len(every), np.uint64)
        short |= every & np.uint64((1 << 8 * SHORT) - 1)
        self.short, self.at, self.times = np.unique(short, return_inverse=True, return_counts=True)

    def _hashes(self, docs: list[list[bytes]], seed: int) -> list[np.ndarray]:
        cache = WordHash(seed)
        return [window_hashes(np.fromiter((cache[x] for x in w), np.uint64, len(w)), self.window) if len(w) >= self.window else np.zeros(0, np.uint64) for w in docs]

    def candidates(self, elsewhere: np.ndarray) -> None:
        """Keep the windows found twice: their places, 128-bit hashes without repeats in order, and how often each is here."""
        may = (elsewhere | (self.times > 1))[self.at]
        edges = np.concatenate([[0], np.cumsum([len(h) for h in self.first])]).astype(np.int64)
        second = np.zeros(len(may), np.uint64)
        own = [d for d in range(len(self.words)) if may[edges[d] : edges[d + 1]].any()]
        for d, h in zip(own, self._hashes([self.words[d] for d in own], 1), strict=True):
            second[edges[d] : edges[d + 1]] = h
        self.edges, self.place = edges, np.flatnonzero(may)
        a, b = np.concatenate([*self.first, np.zeros(0, np.uint64)])[self.place], second[self.place]
        order = np.lexsort((b, a))
        new = np.ones(len(order), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        self.long = (a[order][new], b[order][new])
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        self.here = np.bincount(self.which, minlength=int(new.sum()))


def _answers(answers: pa.Table, n: int) -> np.ndarray:
    """The bits of all buckets, in the order in which the block sent its hashes."""
    got = sorted(zip(answers["bucket"].to_pylist(), answers["n"].to_pylist(), answers["bits"].to_pylist(), strict=True))
    out = np.concatenate([*[np.unpackbits(np.frombuffer(b, np.uint8), count=k) for _, k, b in got], np.zeros(0, np.uint8)]).astype(bool)
    if len(out) != n:
        raise ValueError(f"{len(out)} answers to {n} hashes")
    return out


def _sent(buckets: np.ndarray, block: int, packed: np.ndarray) -> pa.Table:
    """One row for every bucket that occurs; packed holds the bytes of one hash in each row, ordered by bucket."""
    starts = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])) if len(buckets) else np.zeros(0, np.int64)
    ends = np.concatenate([starts[1:], [len(buckets)]]) if len(buckets) else starts
    lists = [packed[lo:hi].tobytes() for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True)]
    return pa.table({"bucket": pa.array(buckets[starts].astype(np.int64), pa.int64()), "block": pa.array([block] * len(lists), pa.int64()), "hashes": pa.array(lists, pa.binary())})


def repeated_bits(lists: list[bytes], width: int) -> list[np.ndarray]:
    """For every list of distinct keys of ``width`` bytes, which of them another list has too."""
    sizes = [len(x) // width for x in lists]
    if not sum(sizes):
        return [np.zeros(n, bool) for n in sizes]
    raw = np.frombuffer(b"".join(lists), np.uint8).reshape(-1, width)
    parts = []
    for i in range(0, width, 8):
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, : min(8, width - i)] = raw[:, i : i + 8]
        parts.append(wide.view(np.uint64)[:, 0])
    order = np.lexsort(parts[::-1]) if len(parts) > 1 else np.argsort(parts[0], kind="stable")
    same = np.ones(len(order) - 1, bool)
    for p in parts:
        same &= p[order][1:] == p[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    out = np.zeros(len(order), bool)
    out[order] = twice
    return np.split(out, np.cumsum(sizes)[:-1])


def removal(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, short: int = SHORT) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the kept words joined by one space), starts and ends of the removed word intervals.

    The size of the input, which sets the numbers of blocks, buckets and tasks, is read by one job beforehand. ``short``
    counts fewer bytes in the first pass; the result is the same, as tests that force collisions show.
    """
    size = docs.select(F.sum(F.octet_length(quoted(text_col)))).first()[0] or 0
    n_blocks = -(-size // block_bytes) or 1
    bits = min(24, max(0, (-(-size // bucket_bytes) - 1).bit_length()))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    src = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("binary").alias("text"))
    dealt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("long")
    blocks = src.withColumn("block", dealt).repartition(tasks, "block")
    few = np.uint64((1 << 8 * short) - 1)

    def read(rows: pa.Table) -> Block:
        b = Block(rows, window, bits)
        if short < SHORT:
            coarse = ((b.short >> np.uint64(8 * SHORT)) << np.uint64(8 * SHORT)) | (b.short & few)
            values, at = np.unique(coarse, return_inverse=True)
            b.short, b.at, b.times = values, at[b.at], np.bincount(at, weights=b.times, minlength=len(values)).astype(np.int64)
        return b

    def first(key: tuple, rows: pa.Table) -> pa.Table:
        b = read(rows)
        return _sent(b.short >> np.uint64(8 * SHORT), key[0].as_py(), b.short.view(np.uint8).reshape(-1, 8)[:, :SHORT])

    def answer(width: int):
        def run(key: tuple, rows: pa.Table) -> pa.Table:
            rows = rows.combine_chunks()
            got = repeated_bits(rows["hashes"].to_pylist(), width)
            return pa.table({"block": rows["block"], "bucket": pa.array([key[0].as_py()] * len(got), pa.int64()), "n": pa.array([len(x) for x in got], pa.int64()), "bits": pa.array([np.packbits(x).tobytes() for x in got], pa.binary())})

        return run

    def second(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        b = read(rows)
        b.candidates(_answers(answers, len(b.short)))
        packed = np.stack(b.long, axis=1).view(np.uint8) if len(b.long[0]) else np.zeros((0, 16), np.uint8)
        return _sent(b.long[0] >> np.uint64(64 - bits) if bits else np.zeros(len(b.long[0]), np.uint64), key[0].as_py(), packed)

    def cut(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        b = read(rows)
        last = pc.equal(answers["round"], 2)
        b.candidates(_answers(answers.filter(pc.invert(last)), len(b.short)))
        sure = _answers(answers.filter(last), len(b.long[0])) | (b.here > 1)
        bad = np.zeros(int(b.edges[-1]), bool)
        bad[b.place] = sure[b.which]
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept": [], "starts": [], "ends": []}
        for d, w in enumerate(b.words):
            mine = bad[b.edges[d] : b.edges[d + 1]]
            gone = covered(mine, len(w), window) if mine.any() else np.zeros(len(w), bool)
            change = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            out["n_words"].append(len(w))
            out["n_removed"].append(int(gone.sum()))
            out["kept"].append(b" ".join([x for x, g in zip(w, gone.tolist(), strict=True) if not g]) if gone.any() else b" ".join(w))
            out["starts"].append(change[::2].tolist())
            out["ends"].append(change[1::2].tolist())
        return pa.table({
            "doc_id": b.ids, "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()),
            "kept": pa.array(out["kept"], pa.binary()), "starts": pa.array(out["starts"], pa.list_(pa.int64())), "ends": pa.array(out["ends"], pa.list_(pa.int64())),
        })

    hashes, bits_of = "bucket long, block long, hashes binary", "block long, bucket long, n long, bits binary"
    count = lambda sent, width: sent.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(answer(width), bits_of)
    found = count(blocks.groupBy("block").applyInArrow(first, hashes), SHORT)
    long = blocks.groupBy("block").cogroup(found.repartition(tasks, "block").groupBy("block")).applyInArrow(second, hashes)
    both = found.withColumn("round", F.lit(1)).union(count(long, 16).withColumn("round", F.lit(2)))
    id_type = src.schema["doc_id"].dataType.simpleString()
    out = blocks.groupBy("block").cogroup(both.repartition(tasks, "block").groupBy("block")).applyInArrow(cut, f"doc_id {id_type}, n_words long, n_removed long, kept binary, starts array<long>, ends array<long>")
    return out.withColumn("kept", F.col("kept").cast("string"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS win FROM d, unnest(range(1, len(w) - {WINDOW} + 2)) AS r(i) WHERE len(w) >= {WINDOW}),
c AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY win) AS n FROM v) WHERE n > 1),
g AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM c) GROUP BY doc_id),
x AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS r(p)),
y AS (SELECT DISTINCT doc_id, unnest(gone) AS p FROM g),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) AS kept FROM x ANTI JOIN y ON x.doc_id = y.doc_id AND x.p = y.p GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""
