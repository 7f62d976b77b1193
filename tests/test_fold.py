import random

import pytest
from pyspark.sql import functions as F

from changeweave.operators import changelog, fold, guard
from changeweave.plans import queries as catalog

from .conftest import SF

SCHEMA = "k long, seq long, op string, val long, props string, has_val boolean, has_props boolean"
COLUMNS = {"val": "has_val", "props": "has_props"}


def changes(seed, n=300):
    r = random.Random(seed)
    out = []
    for i in range(n):
        op = r.choices(["insert", "update", "delete"], [3, 6, 2])[0]
        full = op == "insert"
        out.append((r.randrange(12), i, op, r.choice([None, r.randrange(100)]), r.choice([None, "x", "y"]), full or r.random() < 0.6, full or r.random() < 0.6))
    return out


def sequential(rows, truncate=None):
    state = {}
    for k, i, op, val, props, hv, hp in sorted(rows, key=lambda r: r[1]):
        if truncate is not None and i <= truncate:
            continue
        if op == "delete":
            state.pop(k, None)
            continue
        s = state.setdefault(k, {"val": None, "props": None})
        if hv:
            s["val"] = val
        if hp:
            s["props"] = props
    return {k: (s["val"], s["props"]) for k, s in state.items()}


def found(df):
    return {r.k: (r.val, r.props) for r in df.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_fold_equals_sequential_apply(spark, seed):
    rows = changes(seed)
    shuffled = random.Random(seed).sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, SCHEMA).repartition(5)
    assert found(fold.current_state(df, ["k"], COLUMNS)) == sequential(rows)
    assert found(fold.current_state(df, ["k"], COLUMNS, since=150)) == sequential(rows, 150)


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_micro_batches_give_the_same(spark, parts):
    rows = changes(9)
    state = None
    for p in range(parts):
        part = fold.partial(spark.createDataFrame([r for r in rows if r[1] % parts == p], SCHEMA), ["k"], COLUMNS)
        state = part if state is None else fold.merged(state.unionByName(part), ["k"], COLUMNS)
    assert found(fold.live(state, ["k"], COLUMNS)) == sequential(rows)


def test_cases(spark):
    t = True
    rows = [
        (1, 1, "delete", None, None, t, t), (1, 2, "insert", 1, "a", t, t), (1, 3, "update", 2, None, t, False), (1, 4, "delete", None, None, t, t),  # absent
        (2, 1, "insert", 1, "a", t, t), (2, 2, "update", 5, None, t, False), (2, 3, "update", None, "b", False, t),  # both images kept
        (3, 1, "insert", 1, "a", t, t), (3, 2, "update", None, None, t, False),  # an explicit null overwrites
        (4, 1, "insert", 1, "a", t, t), (4, 2, "delete", None, None, t, t), (4, 3, "update", 7, None, t, False),  # nothing survives a delete
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(fold.current_state(df, ["k"], COLUMNS)) == {2: (5, "b"), 3: (None, "a"), 4: (7, None)}
    twice = df.unionAll(df)
    assert found(fold.current_state(twice, ["k"], COLUMNS)) == {2: (5, "b"), 3: (None, "a"), 4: (7, None)}
    assert fold.current_state(df.limit(0), ["k"], COLUMNS).count() == 0


def test_chained_key_changes(spark):
    rows = spark.createDataFrame([(1, 1, 1, "insert"), (1, 2, 2, "update"), (2, 3, 3, "update")], "old long, new long, seq long, op string").withColumn("val", F.col("seq"))
    split = fold.split_key_changes(rows, "old", "new", "k").withColumn("seq", F.col("seq") * 2 + F.col("part"))
    assert [(r.k, r.val) for r in fold.current_state(split, ["k"], {"val": None}).collect()] == [(3, 3)]


def test_guard(spark):
    rows = [(1, 1, 5, 10, "a", "insert"), (1, 2, 9, 20, "-", "delete"), (1, 3, 7, 30, "b", "insert"), (1, 4, 9, 20, "-", "delete"), (1, 5, 9, 20, "z", "insert"), (1, 6, 9, 21, "c", "insert")]
    df = spark.createDataFrame(rows, "k long, arrival long, wm long, pos long, digest string, op string")
    got = guard.decisions(df, ["k"], "wm", "pos", "arrival", "digest")
    assert [r.decision for r in got.orderBy("arrival").collect()] == ["accept", "accept", "stale", "replay", "conflict", "accept"]
    assert guard.conflicts(got).count() == 1
    assert guard.tombstones(df.where("arrival <= 4"), ["k"], "wm", "pos").first().deleted is True


def test_partial_updates_of_one_key_keep_both_columns(spark):
    rows = [
        (1, 1, "update", 5, None, True, False), (1, 2, "update", None, "x", False, True),  # disjoint columns
        (2, 1, "update", 7, "y", True, True), (2, 2, "update", None, None, True, False),  # an explicit null overwrites
        (3, 1, "update", 8, "z", False, False),  # nothing present
        (4, 1, "update", 9, None, True, False), (4, 2, "update", None, "w", False, True),  # no target row
    ]
    images = fold.latest_images(spark.createDataFrame(rows, SCHEMA).repartition(3), ["k"], COLUMNS)
    target = spark.createDataFrame([(i, 100 + i, f"t{i}") for i in (1, 2, 3)], "k long, val long, props string")
    matched = {(1, 5, "x"), (2, None, "y"), (3, 103, "t3")}
    assert {tuple(r) for r in fold.apply_updates(target, images, ["k"], COLUMNS).collect()} == matched
    assert {tuple(r) for r in fold.upsert(target, images, ["k"], COLUMNS).collect()} == matched | {(4, 9, "w")}


@pytest.mark.parametrize("name", ["cdc_apply_update_join", "cdc_upsert_outer"])
def test_registered_updates_keep_every_column(spark, name):
    present = {}
    for r in changelog.from_events(spark, SF).where("op = 'update'").orderBy("seq").collect():
        present.setdefault(r.k, {}).update({c: r[c] for c, p in COLUMNS.items() if r[p]})
    got = {r.k: r for r in catalog.QUERIES[name](spark, SF).collect()}
    assert present and all(got[k][c] == v for k, columns in present.items() if k in got for c, v in columns.items())
