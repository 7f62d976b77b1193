"""MinHash near-deduplication: a chosen-path set similarity join, confirmed on full shingle sets.

1. One pass gives every document its shingle count, a 128-bit key of its shingle set and a MinHash sketch.
   Documents with one key are one class from here on: exact copies never meet in a group.
2. Chosen paths: in every tree a class goes, at each node, to one or two children, given by its minwise tokens at
   coordinates that the node draws (1 / threshold of them on average). Nodes of at most ``LEAF`` classes are
   compared exhaustively on sketches; larger ones branch again. A node still large after ``DEPTH`` levels shares
   that many minwise tokens and becomes one candidate group uncompared. Independent trees repeat this: a pair at
   the threshold J meets in a node of depth d with chance of at least J^d per tree; with 8 trees and d = 1 that is
   1 - 0.15^8. A leaf emits at most one candidate edge per member, never its pairs.
3. Candidate edges, drawn generously (five standard deviations below the threshold), form candidate groups. Every
   group is compared on full sets, in units of bounded size that emit one confirmed edge per member at most. Up to
   ``CHUNK`` classes are one unit. A larger group is dealt into chunks, and ``PIVOTS`` of its members sit in every chunk:
   what links to one of them is one component. Only pairs of different components are compared then, chunk by chunk.
   Only the texts of group members are shuffled: one scan leaves out by a bitmap of fixed size (2 MB, which comes to the
   driver) most documents that are in no group, the join by id leaves out the rest, and the units read that table.
4. Confirmed edges give the components. Up to ``EDGES`` edges are one task's work; more go through alternating star
   contractions on written tables. Of the edges only counts come to the driver.

Cost in step 3: a group whose members all link through pivots costs one copy of each text. Otherwise r members outside
its large components cost r / CHUNK further copies of each text, and components of n and m members a pair of chunks for
every CHUNK of each: a group of many large components that never link remains quadratic in their chunks.

Defined cases: null texts and texts without words have no shingles, link with nothing and stay; fewer words than a
shingle count as one shingle; rows that repeat an id are one document; null ids form their classes like others but
never become a component id while another id is there; an empty table gives an empty result; other columns are
ignored by ``near_duplicates`` and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeweave.llm.common import forget, quoted, split_words, table, written
from changeweave.llm.substring_dedup import WordHash, mixed, window_hashes

SHINGLE = 5
PERCENT = 85
COORDINATES = 64
TREES = 8
LEAF = 256
DEPTH = 6
CHUNK = 512
#: Members of a large group that every chunk of it is compared with, and nodes from which a component is a body.
PIVOTS, BODY = 16, 128
#: Pairs of sketches compared at once.
PAIRS = 20_000
#: Edges whose components one task finds, and places of the bitmap that tells which texts are needed (2 MB).
EDGES, PLACES = 500_000, 1 << 24
#: Sketches from which a level leaves out those that it no longer needs.
POOL = 20_000


def shingle_set(text: bytes | None, words: WordHash, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    w = split_words((text or b"").lower())
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter((words[x] for x in w), np.uint64, len(w))
    if len(w) < width:
        return mixed(window_hashes(h, len(w)) + np.uint64(len(w)))
    return np.unique(window_hashes(h, width))


def _coefficients(n: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**63, size=n, dtype=np.uint64) | np.uint64(1)


def sketch(shingles: np.ndarray, a: np.ndarray) -> np.ndarray:
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(shingles), 8192):
        out = np.minimum(out, ((shingles[i : i + 8192, None] * a[None, :]) >> np.uint64(32)).min(0).astype(np.uint32))
    return out


def sketches(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, key (null without shingles), sketch."""
    src = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("binary").alias("text"))
    schema = src.select("doc_id").schema.add("n_shingles", "long").add("key", "binary").add("sketch", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        words, a = WordHash(), _coefficients(COORDINATES)
        for batch in batches:
            n, keys, lines = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), words, width)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                lines.append(sketch(s, a).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(lines, pa.binary())], names=[f.name for f in schema])

    return src.mapInArrow(run, schema)


def _mix64(x: np.ndarray) -> np.ndarray:
    return mixed(x + np.uint64(BASE_STEP))


BASE_STEP = 0x9E3779B97F4A7C15


def children(node: np.ndarray, lines: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of (row index, child node): each node draws one coordinate, and a second one with chance share - 1."""
    draw = _mix64(node)
    first = (draw % np.uint64(lines.shape[1])).astype(np.int64)
    second = ((draw >> np.uint64(32)) % np.uint64(lines.shape[1] - 1)).astype(np.int64)
    second = np.where(second >= first, second + 1, second)
    twice = (_mix64(draw) >> np.uint64(11)).astype(np.float64) / 2**53 < share - 1
    at = np.arange(len(node))
    row = np.concatenate([at, at[twice]])
    coordinate = np.concatenate([first, second[twice]])
    value = lines[row, coordinate].astype(np.uint64)
    return row, _mix64(_mix64(node[row] ^ (coordinate.astype(np.uint64) << np.uint64(40))) ^ value)


def branch(rows: DataFrame, percent: int, roots: int = 0) -> DataFrame:
    """(key, node): the children of (key, sketch, node), or of the roots of all trees for (key, sketch)."""
    share = 100.0 / percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lines = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, -1)
            if roots:
                starts = [np.full(batch.num_rows, np.uint64(t + 1)) for t in range(roots)]
            else:
                starts = [batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)]
            for node in starts:
                row, child = children(node, lines, share)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(child.view(np.int64))], names=["key", "node"])

    return rows.mapInArrow(run, "key binary, node long")


def smallest_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Component label (smallest index) of n points linked by the pairs (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _leaf_edges(keys: list[bytes], node: np.ndarray, lines: np.ndarray, least: int) -> tuple[list[bytes], list[bytes]]:
    """Rows are sorted by node. Candidate edges, one per row at most."""
    starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    ends = np.concatenate([starts[1:], [len(node)]])
    a, b = [], []
    pend_i, pend_j, held = [], [], 0

    def flush() -> None:
        nonlocal pend_i, pend_j, held
        if held:
            i, j = np.concatenate(pend_i), np.concatenate(pend_j)
            ok = (lines[i] == lines[j]).sum(1) >= least
            label = smallest_labels(len(node), i[ok], j[ok])
            for x in np.flatnonzero(label != np.arange(len(node))).tolist():
                a.append(keys[x])
                b.append(keys[label[x]])
        pend_i, pend_j, held = [], [], 0

    for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
        n = hi - lo
        if n < 2:
            continue
        i, j = np.triu_indices(n, 1)
        pend_i.append(i + lo)
        pend_j.append(j + lo)
        held += len(i)
        if held > PAIRS:
            flush()
    flush()
    return a, b


def leaf_edges(rows: DataFrame, least: int) -> DataFrame:
    """(a, b) from (key, sketch, node), nodes of at most LEAF rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            t = t.combine_chunks()
            node = t["node"].to_numpy()
            last = int(np.searchsorted(node, node[-1], side="left")) if len(node) else 0
            rest = t.slice(last)
            if last:
                yield one(t.slice(0, last))
        if rest is not None and rest.num_rows:
            yield one(rest)

    def one(t: pa.Table) -> pa.RecordBatch:
        lines = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint32).reshape(t.num_rows, -1)
        a, b = _leaf_edges(t["key"].to_pylist(), t["node"].to_numpy(), lines, least)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return rows.repartition("node").sortWithinPartitions("node").select("key", "sketch", "node").mapInArrow(run, "a binary, b binary")


def candidates(classes: DataFrame, percent: int) -> list[DataFrame]:
    """Written tables of candidate edges (a, b) between class keys; an edge may come more than once. classes: key, sketch."""
    j = percent / 100
    least = math.floor(COORDINATES * j - 5 * math.sqrt(COORDINATES * j * (1 - j)))
    found, rows, pool, held = [], written(branch(classes, percent, TREES)), classes, classes.count()
    for level in range(1, DEPTH + 1):
        sizes = written(rows.groupBy("node").count().where("count > 1"))  # written, so that Spark can split a hot node in the join
        met = written(rows.join(sizes, "node").join(pool, "key"))
        found.append(written(leaf_edges(met.where(F.col("count") <= LEAF), least)))
        big = met.where(F.col("count") > LEAF)
        if level < DEPTH:
            deeper = written(branch(big.select("key", "sketch", "node"), percent))
            more = not deeper.isEmpty()
            if more and held > POOL:  # only these are sketched against from here on
                spent, pool = pool, written(big.groupBy("key").agg(F.min("sketch").alias("sketch")))
                if spent is not classes:
                    forget(spent)
                held = pool.count()
        else:
            heads = written(big.groupBy("node").agg(F.min("key").alias("b")))
            found.append(written(big.select("node", "key").join(heads, "node").where("key <> b").select(F.col("key").alias("a"), "b").distinct()))
            forget(heads)
            more, deeper = False, None
        for t in (rows, sizes, met):
            forget(t)
        rows = deeper
        if not more:
            break
    for t in (rows, pool):
        if t is not None and t is not classes:
            forget(t)
    return found


def components(edges: DataFrame) -> DataFrame:
    """Written table (node, root): root is the smallest node of its component. Nodes without an edge are absent."""
    edges = edges.where("a <> b").select("a", "b")
    return written(few_components(edges)) if edges.count() <= EDGES else many_components(edges)


def few_components(edges: DataFrame) -> DataFrame:
    """(node, root) of edges that fit into one task."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        nodes = pc.unique(pa.chunked_array([*t["a"].chunks, *t["b"].chunks]))
        nodes = nodes.take(pc.sort_indices(nodes))
        at = [pc.index_in(t[side], nodes).to_numpy().astype(np.int64) for side in "ab"]
        label = smallest_labels(len(nodes), *at)
        for i in range(0, len(nodes), 10_000):
            yield pa.RecordBatch.from_arrays([nodes[i : i + 10_000], nodes.take(pa.array(label[i : i + 10_000]))], names=["node", "root"])

    return edges.coalesce(1).mapInArrow(run, f"node {kind}, root {kind}")


def many_components(edges: DataFrame) -> DataFrame:
    """Written table (node, root) of any number of edges.

    Alternating star contractions: large stars hang bigger neighbours on the smallest, small stars the smaller ones.
    The edges shrink to stars in O(log n) rounds; each round is written, so no lineage grows. The smallest neighbours are
    written before the edges meet them: both sides of the join are then plain shuffles, and Spark splits a star's centre.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        new = written(small)
        # done when the edges are stars around the smallest: no root hangs on another node, each node hangs on one
        roots, leaves = new.select(F.col("v").alias("n")).distinct(), new.select(F.col("u").alias("n"))
        bad = roots.join(leaves, "n", "left_semi").select(F.lit(1)).union(leaves.groupBy("n").count().where("count > 1").select(F.lit(1)))
        done = bad.isEmpty()
        forget(now)
        forget(low)
        now = new
        if done:
            out = written(now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
            forget(now)
            return out


def links(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i < j) with 100 * intersection >= percent * union, on the full sets."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    token = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    _, code, counts = np.unique(token, return_inverse=True, return_counts=True)
    shared = counts[code] > 1
    rank = np.cumsum(counts > 1) - 1
    code, owner = rank[code[shared]], owner[shared]
    common = np.zeros((n, n), np.float32)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    width = 4096
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        i, j = np.searchsorted(code, [lo, lo + width])
        m = np.zeros((n, width), np.float32)
        m[owner[i:j], code[i:j] - lo] = 1
        common += m @ m.T
    inter = common.astype(np.int64)
    ok = (100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter)) & (inter > 0)
    return np.nonzero(np.triu(ok, 1))


def confirmed(groups: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """Written table (a, b): confirmed edges, with the components of all links. groups: (node, root) of candidate groups; classes: key, rep."""
    spread = written(groups.join(groups.groupBy("root").count(), "root"))
    texts = members(groups, classes, docs, id_col, text_col)
    units = written(first_units(spread))
    first = written(compared(units, texts, percent, width))
    forget(units)
    # every pair of a small group has been compared; of a large one, those of different components are left
    large = written(spread.where(F.col("count") > CHUNK).select("node", "root"))
    forget(spread)
    out, spent = first, [large, texts]
    if not large.isEmpty():
        linked = components(first)
        named = written(large.join(linked.withColumnRenamed("root", "label"), "node", "left").select("root", "node", F.coalesce("label", "node").alias("label")))
        parts = written(named.groupBy("root", "label").count())
        spent += [linked, named, parts]
        if not parts.groupBy("root").count().where("count > 1").isEmpty():
            units = written(open_units(named, parts))
            rest = written(compared(units, texts, percent, width))
            out = written(first.union(rest))
            spent += [first, units, rest]
    for t in spent:
        forget(t)
    return out


def members(groups: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Written table (key, text): the texts of what is in a group, so that other texts are not shuffled."""
    wanted = written(groups.select(F.col("node").alias("key")).join(classes.select("key", "rep"), "key"))
    texts = docs.select(quoted(id_col).alias("rep"), quoted(text_col).cast("binary").alias("text"))
    held = sifted(texts, wanted)
    out = written(held.join(wanted, held["rep"].eqNullSafe(wanted["rep"])).select("key", "text"))
    forget(wanted)
    return out


def sifted(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of texts (rep, text) whose rep is in wanted, and the few others whose hash has a place in common with one of them."""
    place = F.pmod(F.xxhash64("rep"), F.lit(PLACES))
    pages = wanted.select(F.shiftright(place, 15).alias("page"), place.bitwiseAND(F.lit(32767)).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    marks = np.zeros((-(-PLACES // 32768), 4096), np.uint8)
    for x in pages.collect():  # 2 MB at most, however many are wanted
        marks[x.page] = np.frombuffer(x.bits, np.uint8)
    marks = marks.ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            keep = (marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            if keep.any():
                yield batch.select([0, 1]).filter(pa.array(keep.astype(bool)))

    return texts.select("rep", "text", place.alias("place")).mapInArrow(run, texts.schema)


def first_units(spread: DataFrame) -> DataFrame:
    """(key, unit) from (node, root, count): a group up to CHUNK is a unit; a larger one has a unit for each chunk, and its pivots in each."""
    chunks = F.ceil(F.col("count") / CHUNK).cast("int")
    own = spread.select(F.col("node").alias("key"), F.xxhash64("root", F.pmod(F.xxhash64("node"), chunks)).alias("unit"))
    drawn = spread.where(F.col("count") > CHUNK).groupBy("root").agg(
        F.max("count").alias("count"), F.array_distinct(F.array(*[F.min_by("node", F.xxhash64("node", F.lit(i))) for i in range(PIVOTS)])).alias("pivots")
    )
    numbers = F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk")
    pivots = drawn.select("root", numbers, "pivots").select("root", "chunk", F.explode("pivots").alias("key"))
    return own.union(pivots.select("key", F.xxhash64("root", F.col("chunk").cast("long")).alias("unit")))  # a pivot is in its own chunk twice


def open_units(named: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, unit) for the pairs left in (root, node, label), where (root, label, count) says how many nodes a label has.

    A label with more than BODY nodes is a body of its own, the others of its group are pooled. Units are pairs of a chunk
    of the pool with any chunk of the group, and pairs of chunks of different bodies: no body meets itself.
    """
    body = F.when(F.col("count") > BODY, F.col("label"))
    groups = parts.groupBy("root").agg(F.count(F.lit(1)).alias("labels")).where("labels > 1").select("root")
    pooled = parts.join(groups, "root").select("root", "label", body.alias("body"), "count")
    bodies = written(pooled.groupBy("root", "body").agg(F.ceil(F.sum("count") / CHUNK).cast("int").alias("chunks")))
    x, y = (bodies.select("root", F.col("body").alias(f"body_{i}"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias(f"chunk_{i}")) for i in "xy")
    of_pool = x.where("body_x IS NULL").join(y, "root").where("body_y IS NOT NULL OR chunk_x <= chunk_y")
    ordered = bodies.where("body IS NOT NULL")
    apart = ordered.select("root", F.col("body").alias("body_x"), F.col("chunks").alias("n_x")).join(
        ordered.select("root", F.col("body").alias("body_y"), F.col("chunks").alias("n_y")), "root"
    ).where("body_x < body_y")
    of_bodies = apart.withColumn("chunk_x", F.explode(F.sequence(F.lit(0), F.col("n_x") - 1))).withColumn("chunk_y", F.explode(F.sequence(F.lit(0), F.col("n_y") - 1)))
    pairs = of_pool.select("root", "body_x", "chunk_x", "body_y", "chunk_y").union(of_bodies.select("root", "body_x", "chunk_x", "body_y", "chunk_y"))
    pairs = pairs.withColumn("unit", F.xxhash64("root", F.coalesce("body_x", F.lit(b"")), "chunk_x", F.coalesce("body_y", F.lit(b"")), "chunk_y"))
    sides = pairs.select("root", F.col("body_x").alias("body"), F.col("chunk_x").alias("chunk"), "unit").union(
        pairs.where(~(F.col("body_x").eqNullSafe(F.col("body_y")) & (F.col("chunk_x") == F.col("chunk_y")))).select("root", "body_y", "chunk_y", "unit")  # a chunk with itself has one side
    )
    placed = named.join(pooled.select("root", "label", "body"), ["root", "label"]).join(bodies.withColumnRenamed("body", "b").withColumnRenamed("root", "r"), (F.col("root") == F.col("r")) & F.col("body").eqNullSafe(F.col("b")))
    placed = placed.select("root", "node", F.coalesce("body", F.lit(b"")).alias("body"), F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"))
    sides = sides.withColumn("body", F.coalesce("body", F.lit(b"")))
    return placed.join(sides, ["root", "body", "chunk"]).select(F.col("node").alias("key"), "unit")


def compared(units: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """(a, b): a spanning forest of the links on full sets in each unit of (key, unit). texts: key, text."""
    rows = texts.join(units, "key").select("unit", "key", "text")

    def unit(rows: pa.Table) -> pa.Table:
        import xxhash

        words, seen = WordHash(), {}
        for key, text in zip(rows["key"].to_pylist(), rows["text"].to_pylist(), strict=True):
            if key not in seen:
                s = shingle_set(text, words, width)
                if len(s) and xxhash.xxh3_128_digest(s.tobytes()) == key:  # another text under a repeated id isn't this class
                    seen[key] = s
        keys = sorted(seen)
        if len(keys) < 2:
            return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
        label = smallest_labels(len(keys), *links([seen[k] for k in keys], percent))
        moved = np.flatnonzero(label != np.arange(len(keys))).tolist()
        return pa.table({"a": pa.array([keys[x] for x in moved], pa.binary()), "b": pa.array([keys[label[x]] for x in moved], pa.binary())})

    return rows.groupBy("unit").applyInArrow(unit, "a binary, b binary")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    own = written(sketches(docs, width, id_col, text_col))
    classes = written(own.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("sketch").alias("sketch")))
    found = candidates(classes.select("key", "sketch"), percent)
    edges = found[0]
    for more in found[1:]:
        edges = edges.union(more)
    groups = components(edges)
    for f in found:
        forget(f)
    real = confirmed(groups, classes, docs, percent, width, id_col, text_col)
    linked = components(real)
    forget(groups)
    forget(real)
    named = classes.select("key", "rep").join(linked, classes["key"] == linked["node"], "left").select("key", "rep", F.coalesce("root", "key").alias("root"))
    lowest = written(named.groupBy("root").agg(F.min("rep").alias("component_id")))
    by_key = named.join(lowest, "root").select("key", "component_id")
    out = own.join(by_key, "key", "left").withColumn("component_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with all its columns."""
    stay = near_duplicates(docs, percent, width, id_col, text_col).where("kept").select(F.col("doc_id").alias("__cw_id")).distinct()
    return docs.join(stay, quoted(id_col).eqNullSafe(F.col("__cw_id")), "left_semi")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), {SHINGLE}) - 1], ' ') AS x
  FROM d, unnest(range(1, greatest(len(w) - {SHINGLE} + 1, 1) + 1)) AS r(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a AS doc_id, a AS r FROM both_ways UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.doc_id
"""
