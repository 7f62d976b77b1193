"""Borders, crashes and odd values of the change-data operators."""

import random

import pytest
from pyspark.sql import functions as F

from changeweave.functions import scalars
from changeweave.operators import artifacts, certify, changelog, evolve, fold, guard, lifecycle, mapping, warehouse
from changeweave.sources import sinks, tables, wire
from changeweave.streaming import apply
from changeweave.streaming.apply import UpsertTarget

from .conftest import SF


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_different_tuples_have_different_digests(spark):
    lit = lambda *parts: scalars.sha(*[F.lit(p) for p in parts])
    made = [one(spark, lit(*p)) for p in (("a|b", "c"), ("a", "b|c"), ("", "c"), (None, "c"), ("1:a", "c"), ("a", None), ("a", "n"))]
    assert len(set(made)) == len(made)


def test_certificate_holds_large_sums(spark):
    rows = spark.range(1000).withColumn("v", F.lit("x"))
    c = certify.certificate(rows, ["v"]).first()
    assert c.n == 1000 and all(int(c[f"h{i}"]) % 1000 == 0 for i in range(4))
    assert str(certify.certificate(rows.limit(0), ["v"]).first().h3) == "0"


def test_a_crash_between_receipts_and_state_leaves_neither(spark, tmp_path):
    t = UpsertTarget(spark, str(tmp_path / "t"), ["k"], {"v": None})
    rows = lambda *vs: spark.createDataFrame([(k, s, "insert", v) for k, s, v in vs], "k long, seq long, op string, v string")
    assert t.apply(rows((1, 1, "a")), 1)
    publish = t.state.publish

    def crash(df):
        raise RuntimeError("lost")

    t.state.publish = crash
    with pytest.raises(RuntimeError):
        t.apply(rows((2, 2, "b")), 2)
    t.state.publish = publish
    assert t.apply(rows((2, 2, "b")), 2) and t.apply(rows((3, 3, "c")), 3)
    assert not t.apply(rows((2, 2, "b")), 2) and not t.apply(rows((3, 3, "c")), 3)
    t.vacuum(1)
    assert sorted(r.v for r in t.read().collect()) == ["a", "b", "c"] and not t.apply(rows((1, 1, "a")), 1)


def test_overlaps_across_ranges(spark):
    rows = [(99, 0, 120), (100, 100, 150), (101, 151, 160), (350, 155, 170)]
    got = sinks.overlaps(spark.createDataFrame(rows, "xid long, first_seq long, last_seq long"), "xid", 100).collect()
    assert sorted((r.xid, r.previous_last) for r in got) == [(100, 120), (350, 160)]


def test_long_ancestry_and_cycles(spark):
    line = spark.createDataFrame([(i, i - 1 if i else None) for i in range(500)] + [(900, 901), (901, 900)], "id long, parent long")
    assert sorted(r.id for r in artifacts.ancestry(line, 499).collect()) == list(range(500))
    assert [r.id for r in artifacts.ancestry(line, 0).collect()] == [0] and artifacts.ancestry(line, 7777).count() == 0
    assert sorted(r.id for r in artifacts.ancestry(line, 900).collect()) == [900, 901]
    cycle = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None)], "t string, base string")
    assert sorted((r.t, r.node) for r in tables.type_chain(cycle, "t", "base").collect()) == [("a", "a"), ("a", "b"), ("b", "a"), ("b", "b"), ("c", "c")]


def test_chunks_keep_both_limits(spark):
    sizes = [39, 10, 31, 5, 4, 41, 1] + [1] * 7
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate(sizes)], "k int, seq int, n int")
    got = artifacts.chunks(rows, ["k"], "seq", F.col("n"), 3, 40).groupBy("chunk").agg(F.count("n").alias("rows"), F.sum("n").alias("bytes")).orderBy("chunk").collect()
    assert [r.bytes for r in got] == [39, 10, 40, 41, 3, 3, 2] and all(r.rows <= 3 for r in got)


def test_bisection_by_real_sizes(spark):
    sizes = [100, 1, 1, 1, 1, 1, 1, 1]
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate(sizes)], "xid int, seq int, n int")
    got = sorted((r["first"], r.n_rows, r.bytes) for r in artifacts.bisected(rows, "xid", "seq", F.col("n"), 10).collect())
    assert got == [(0, 1, 100), (1, 1, 1), (2, 2, 2), (4, 4, 4)]


@pytest.mark.parametrize(("text", "p", "s", "want"), [
    ("1" * 24, 38, 0, True), ("0.1234567890123456789", 38, 18, False), ("0.5", 4, 2, True), ("100.25", 4, 2, False), ("1e3", 4, 0, True), ("1e4", 4, 0, False), ("1.5e-1", 4, 2, True),
    ("1.50", 2, 1, True), ("-00012", 2, 0, True), ("0", 1, 0, True), ("x", 4, 2, False), (None, 4, 2, False), ("1" * 39, 38, 0, False), (".5", 2, 1, True),
])
def test_decimal_fits(spark, text, p, s, want):
    assert one(spark, scalars.fits_decimal(F.lit(text).cast("string"), p, s)) is want


def test_vectors_hstores_times(spark):
    assert one(spark, scalars.as_vector(F.lit("[a,b]"))) is None and one(spark, scalars.as_vector(F.lit("{1, 2.5}"))) == [1.0, 2.5] and one(spark, scalars.as_vector(F.lit("[]"))) == []
    assert one(spark, scalars.as_hstore(F.lit(r'"a"=>"1", "b"=>NULL, "a"=>"2", "q\"t"=>"x\\y"'))) == {"a": "2", "b": None, 'q"t': "x\\y"}
    assert str(one(spark, scalars.parse_time(F.lit("2024-01-01T02:00:00+02:00")))) == "2024-01-01 00:00:00" and str(one(spark, scalars.parse_time(F.lit("2024-01-01T02:00:00.000005Z")))) == "2024-01-01 02:00:00.000005"
    assert one(spark, scalars.as_inet(F.lit("1.2.3.256"))) is None and one(spark, scalars.as_inet(F.lit("1.2.3.4/33"))) is None and one(spark, scalars.as_inet(F.lit("01.2.3.4"))) == "1.2.3.4"
    assert one(spark, scalars.as_json(F.lit("{"))) is None


def test_nearest_rank_equals_sorting(spark):
    r = random.Random(4)
    for n in (1, 2, 37, 400):
        values = [round(r.choice([r.gauss(0, 1), 5.0, -3.0]), 3) for _ in range(n)]
        got = lifecycle.nearest_rank(spark.createDataFrame([(v,) for v in [*values, None]], "v double"), "v", 1, 50, 99, 100, ranges=8).first()
        want = sorted(values)
        assert [got[f"p{p}"] for p in (1, 50, 99, 100)] == [want[max(-(-n * p // 100), 1) - 1] for p in (1, 50, 99, 100)]


def test_newest_takes_one_row(spark):
    rows = spark.createDataFrame([(1, 5, "a", None), (1, 7, None, "y"), (2, 1, "c", "z")], "k int, v int, a string, b string")
    assert sorted(map(tuple, fold.newest(rows, ["k"], "v").collect())) == [(1, 7, None, "y"), (2, 1, "c", "z")]


def test_messages_read_back(spark):
    rows = spark.createDataFrame([(1, i, "t", "update", f"k{i}", "", "x" * 300 * i, i, 3) for i in range(3)], "b int, seq int, table string, op string, key string, before_json string, after_json string, ts_millis long, schema_version long")
    got = wire.proto_batches(rows, "b", "seq").first()
    back = wire.read_proto(bytes(got.payload))
    assert got.n_records == 3 and [r[3] for r in back] == [b"k0", b"k1", b"k2"] and len(back[2][5]) == 600 and back[2][6] == 2 and 4 not in back[0]
    schema = wire.avro_schema(spark.createDataFrame([], "a long, b string, c array<int>").schema, "r")
    assert '"name":"a","type":["null","long"]' in schema and '"name":"c","type":["null","bytes"]' in schema


def test_objects_and_misfits(spark):
    with pytest.raises(ValueError):
        warehouse.mapped_plan(spark.range(1), "AB" * 32)
    same = [one(spark, warehouse.same_key(F.lit(a).cast("string"), F.lit(b).cast("string"))) for a, b in (("1", "1.0"), ("a", "a"), ("a", "b"), (None, None), ("1", None))]
    assert same == [True, True, False, True, False]


@pytest.mark.parametrize("span", [1, 90, 10_000])
def test_split_windows_equal_whole_ones(spark, span):
    log = changelog.from_events(spark, SF)
    key = lambda df: sorted(map(str, df.collect()))
    columns = {"val": "has_val", "props": "has_props"}
    assert key(fold.hydrated(log, ["k"], columns, span=span)) == key(fold.hydrated(log, ["k"], columns))
    rows = log.withColumn("arrival", F.col("seq")).unionByName(log.where("seq % 10 = 0").withColumn("arrival", F.col("seq") + 5_000)).withColumn("digest", F.col("op")).select("k", "wm", "pos", "arrival", "digest")
    assert key(guard.decisions(rows, ["k"], "wm", "pos", "arrival", "digest", span)) == key(guard.decisions(rows, ["k"], "wm", "pos", "arrival", "digest"))


def test_types_of_targets():
    assert [mapping.target_type("NUMERIC(10, 2)", t) for t in mapping.TARGETS] == ["Decimal(10,2)", "DECIMAL(10,2)", "NUMBER(10,2)"]
    assert mapping.target_type("timestamp with time zone", "snowflake") == "TIMESTAMP_TZ" and mapping.target_type("ext:postgis.geometry", "duckdb") == "VARCHAR" and mapping.target_type("unheard_of", "duckdb") == "TEXT"
    assert mapping.target_type("bool", "clickhouse", nullable=True) == "Nullable(UInt8)" and mapping.target_type("vector(3)", "clickhouse", True) == "Array(Float32)"
    assert mapping.target_type("bool", "clickhouse", rules={"bool": "Bool"}) == "Bool"


def test_ddl_of_keys_indexes_and_constraints():
    kinds = lambda sql: [c.kind.name for c in evolve.parse(sql)]
    made = evolve.parse('CREATE TABLE t (id bigint, "a--b" text DEFAULT \'/* x */\', PRIMARY KEY (id)) -- end')
    assert made[0].columns == (("id", "bigint"), ("a--b", "text")) and made[0].key == ("id",)
    assert evolve.render(evolve.parse("ALTER TABLE t ADD PRIMARY KEY (id, b)")[0], "postgres") == 'ALTER TABLE "t" ADD PRIMARY KEY ("id", "b")'
    added = evolve.parse("ALTER TABLE t ADD COLUMN n numeric(9,2)")[0]
    assert evolve.render(added, "clickhouse", translate=True) == "ALTER TABLE `t` ADD COLUMN `n` Nullable(Decimal(9,2))" and evolve.render(added, "snowflake", translate=True).endswith('"n" NUMBER(9,2)')
    assert kinds("RENAME TABLE a TO b") == ["RENAME_TABLE"] and kinds("ALTER TABLE t ADD CONSTRAINT c FOREIGN KEY (a) REFERENCES u (b) ON DELETE CASCADE") == ["ALTER_FOREIGN_KEY"]
    assert kinds("ALTER TABLE t ADD CONSTRAINT c CHECK (a > 0)") == kinds("ALTER TABLE t DROP CONSTRAINT c") == ["ALTER_CONSTRAINTS"] and kinds("ALTER TABLE t ADD CONSTRAINT k PRIMARY KEY (a, b)") == ["SET_KEY"]
    index = evolve.parse("CREATE UNIQUE INDEX i ON s.t USING btree (a, b)")[0]
    assert evolve.render(index, "duckdb") == 'CREATE UNIQUE INDEX "i" ON "s"."t" ("a", "b")' and kinds("DROP INDEX IF EXISTS i") == ["DROP_INDEX"]
    for dialect in ("clickhouse", "snowflake", "spark"):
        with pytest.raises(evolve.UnsupportedChange):
            evolve.render(index, dialect)
    assert kinds("ALTER TABLE t ADD COLUMN constraint_x int") == ["ADD_COLUMN"] and kinds("ALTER TABLE t DROP COLUMN c") == ["DROP_COLUMN"]


def test_giving_up_and_heartbeats():
    tries = []

    def fails():
        tries.append(1)
        raise OSError

    with pytest.raises(OSError):
        apply.with_retry(fails, 3, 0)
    assert len(tries) == 3
    with pytest.raises(OSError):
        apply.with_retry(fails, 3, 0, "never", stop=lambda: len(tries) >= 10)
    assert len(tries) == 10
    released = []
    apply.after_failure("hold", lambda: released.append(1))
    apply.after_failure("drop", lambda: released.append(2))
    assert released == [2]
    assert apply.ends_empty(iter([(5, "a"), (0, None), (0, "b"), (0, None), (7, "c")]), 2) == 4 and apply.ends_empty(iter([(0, None)] * 3), 0) == 3


def test_pruning_cascades(spark):
    m = spark.createDataFrame([(i,) for i in range(6)], "manifest_id long")
    left = lifecycle.prune(m, m.where("manifest_id < 4"), m.where("manifest_id = 1"), m.union(m), 2)
    assert [sorted(r.manifest_id for r in t.collect()) for t in left] == [[1, 3, 4, 5], [1, 3], [1, 1, 3, 3, 4, 4, 5, 5]]
