"""Candidate groups larger than a chunk: pivots first, then only what they leave open."""

import random

import pytest
from pyspark.sql import functions as F

from changeweave.llm import near_dedup


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def parents(docs, percent):
    sets = [shingles(t) for t in docs]
    par = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((par[i], par[j]))
                par = [a if p == b else p for p in par]
    return par


def drifting(r, n, tag):
    """Texts each of which links to its neighbours only."""
    words = [f"{tag}{r.randrange(10**6)}" for _ in range(100)]
    out = []
    for i in range(n):
        words = list(words)
        words[(i * 7) % 100] = f"{tag}n{i}"
        out.append(" ".join(words))
    return out


def alike(r, n, tag):
    """Texts that all link with each other."""
    words = [f"{tag}{r.randrange(10**6)}" for _ in range(300)]
    return [" ".join(words + [f"{tag}own{i}"]) for i in range(n)]


CASES = {
    "one component by a chain": lambda r: drifting(r, 40, "a"),
    "all alike": lambda r: alike(r, 40, "a"),
    "two bodies and loners": lambda r: alike(r, 20, "a") + alike(r, 17, "b") + [" ".join(f"l{i}x{j}" for j in range(30)) for i in range(12)],
    "bodies, a chain and a bridge": lambda r: alike(r, 15, "a") + drifting(r, 25, "c") + alike(r, 9, "b"),
}


@pytest.mark.parametrize("name", CASES)
def test_a_large_group_equals_brute_force(spark, monkeypatch, name):
    docs = CASES[name](random.Random(11))
    for key, value in {"CHUNK": 7, "PIVOTS": 2, "BODY": 3}.items():
        monkeypatch.setattr(near_dedup, key, value)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    own = near_dedup.written(near_dedup.sketches(df, 5, "doc_id", "text"))
    classes = near_dedup.written(own.select("key", F.col("doc_id").alias("rep")))
    groups = near_dedup.written(classes.select(F.col("key").alias("node"), F.lit(b"one").alias("root")))
    ids = {bytes(x.key): x.rep for x in classes.collect()}
    want, par = parents(docs, 85), list(range(len(docs)))
    for x in near_dedup.confirmed(groups, classes, df, 85, 5, "doc_id", "text").collect():
        a, b = sorted((par[ids[bytes(x.a)]], par[ids[bytes(x.b)]]))
        par = [a if p == b else p for p in par]
    assert par == want


def test_a_dense_group_is_read_once(spark, monkeypatch):
    for key, value in {"CHUNK": 8, "PIVOTS": 2, "BODY": 3}.items():
        monkeypatch.setattr(near_dedup, key, value)
    nodes = [(i.to_bytes(4, "big"), b"r", 400) for i in range(400)]
    units = near_dedup.first_units(spark.createDataFrame(nodes, "node binary, root binary, count long"))
    assert 400 <= units.count() <= 400 + 2 * 50  # each member once, two pivots in each of 50 chunks
    named = spark.createDataFrame([(b"r", n, nodes[0][0]) for n, _, _ in nodes], "root binary, node binary, label binary")
    assert near_dedup.open_units(named, named.groupBy("root", "label").count()).count() == 0
    empty = near_dedup.open_units(named.limit(0), named.limit(0).groupBy("root", "label").count())
    assert empty.count() == 0


def test_open_units_hold_every_open_pair_and_no_body_with_itself(spark, monkeypatch):
    for key, value in {"CHUNK": 5, "BODY": 3}.items():
        monkeypatch.setattr(near_dedup, key, value)
    labels = [b"A"] * 21 + [b"B"] * 12 + [b"c"] * 3 + [b"d", b"e", b"f", b"g", b"h", b"i"]
    rows = [(b"r", i.to_bytes(2, "big"), label) for i, label in enumerate(labels)]
    named = spark.createDataFrame(rows, "root binary, node binary, label binary")
    units = {}
    for x in near_dedup.open_units(named, named.groupBy("root", "label").count()).collect():
        units.setdefault(x.unit, set()).add(int.from_bytes(x.key, "big"))
    met = {(i, j) for u in units.values() for i in u for j in u if i < j}
    assert all((i, j) in met for i in range(len(rows)) for j in range(i + 1, len(rows)) if labels[i] != labels[j])
    assert not any(all(labels[i] == label for i in u) and len(u) > 5 for u in units.values() for label in (b"A", b"B"))


def test_few_edges_are_one_table(spark, monkeypatch):
    made = []
    monkeypatch.setattr(near_dedup, "written", lambda df, keep=near_dedup.written: made.append(1) or keep(df))
    r = random.Random(8)
    edges = spark.createDataFrame([(r.randrange(90).to_bytes(2, "big"), r.randrange(90).to_bytes(2, "big")) for _ in range(60)], "a binary, b binary").repartition(3)
    few = {bytes(x.node): bytes(x.root) for x in near_dedup.components(edges).collect()}
    assert len(made) == 1 and few
    monkeypatch.setattr(near_dedup, "EDGES", 0)
    assert few == {bytes(x.node): bytes(x.root) for x in near_dedup.components(edges).collect()} and len(made) > 2


@pytest.mark.parametrize("kind", ["long", "string"])
def test_only_texts_of_groups_are_moved(spark, monkeypatch, kind):
    docs = spark.range(2000).selectExpr(f"cast(id AS {kind}) AS doc_id", "concat('text ', id) AS text").union(spark.sql(f"SELECT cast(NULL AS {kind}), 'text of no id'")).repartition(3)
    classes = docs.selectExpr("cast(text AS binary) AS key", "doc_id AS rep")
    groups = classes.where("rep IS NULL OR cast(rep AS long) % 100 = 7").selectExpr("key AS node", "key AS root")
    want = {bytes(x.node) for x in groups.collect()}
    texts = docs.selectExpr("doc_id AS rep", "cast(text AS binary) AS text")
    wanted = classes.join(groups, classes["key"] == groups["node"]).select("key", "rep")
    assert len(want) == 21 and {bytes(x.text) for x in near_dedup.sifted(texts, wanted).collect()} >= want and near_dedup.sifted(texts, wanted).count() <= 25
    assert near_dedup.sifted(texts, wanted.limit(0)).count() == 0
    for places in (near_dedup.PLACES, 1 << 3):  # with few places most rows have one in common
        monkeypatch.setattr(near_dedup, "PLACES", places)
        assert sorted((bytes(x.key), bytes(x.text)) for x in near_dedup.members(groups, classes, docs, "doc_id", "text").collect()) == sorted((k, k) for k in want)


def test_small_pools_are_not_written_again(spark, monkeypatch):
    """Deeper levels give the same edges from the sketches at hand as from those that are still needed, in fewer tables."""
    docs = spark.createDataFrame(list(enumerate(alike(random.Random(4), 30, "a") + drifting(random.Random(5), 30, "b"))), "doc_id long, text string")
    classes = near_dedup.written(near_dedup.sketches(docs, 5, "doc_id", "text").select("key", "sketch"))
    monkeypatch.setattr(near_dedup, "LEAF", 4)
    monkeypatch.setattr(near_dedup, "DEPTH", 3)
    made, seen = [], []
    monkeypatch.setattr(near_dedup, "written", lambda df, keep=near_dedup.written: made.append(1) or keep(df))
    for pool in (0, 1000):
        monkeypatch.setattr(near_dedup, "POOL", pool)
        made.clear()
        found = near_dedup.candidates(classes, 85)
        seen.append((len(made), sorted({(bytes(x.a), bytes(x.b)) for t in found for x in t.collect()})))
    assert seen[0][1] == seen[1][1] != [] and seen[1][0] == seen[0][0] - 2
