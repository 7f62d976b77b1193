import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from changeweave.functions import position, scalars
from changeweave.operators import artifacts, evolve, lifecycle
from changeweave.operators import mapping as m
from changeweave.plans import queries as catalog
from changeweave.sources import backfill, sinks
from changeweave.streaming import apply

from .conftest import SF, same


def ddl(s):
    return StructType.fromDDL(s)


def test_positions(spark):
    assert position.canonical_py("0/00a0") == "0/A0" and position.canonical_py("007") == "7" and position.number_py("FFFFFFFF/16B6C50") == 18446744069438401616
    for bad in ("+1", " 1", "0/", "1/2/3", "", "0/123456789"):
        with pytest.raises(ValueError):
            position.canonical_py(bad)
    df = spark.createDataFrame([("FFFFFFFF/16B6C50", "0/9"), ("0/10", "0/9"), ("5", "0/9"), ("x", None)], "a string, b string")
    got = df.select(position.number(F.col("a")).cast("string"), position.compare(F.col("a"), F.col("b")), position.canonical(F.col("a"))).collect()
    assert [tuple(r) for r in got] == [("18446744069438401616", 1, "FFFFFFFF/16B6C50"), ("16", 1, "0/10"), ("5", None, "5"), (None, None, None)]
    assert spark.range(1).select(position.text_of(F.lit(0x1_0000_00FF))).first()[0] == "1/FF"


def test_positions_with_more_than_eight_digits(spark):
    good = {"000/005b8d900": "0/5B8D900", "000000001/0000000000FFFFFFFF": "1/FFFFFFFF", "0000000000/000000000": "0/0"}
    bad = ["0/123456789", "0123456789/0", "00/100000000", "000000000/", "/000000000"]
    df = spark.createDataFrame([(t,) for t in [*good, *bad]], "a string")
    got = df.select(position.canonical(F.col("a")), position.number(F.col("a")), position.is_position(F.col("a"))).collect()
    assert [tuple(r) for r in got] == [(c, position.number_py(t), True) for t, c in good.items()] + [(None, None, False)] * len(bad)
    assert [position.canonical_py(t) for t in good] == list(good.values()) and position.number_py("000/005b8d900") == 0x5B8D900
    for text in bad:
        with pytest.raises(ValueError):
            position.canonical_py(text)


@pytest.mark.parametrize("name", ["lsn_canonical", "lsn_numeric"])
def test_positions_of_large_events(spark, tmp_path, name):
    import duckdb

    ids = f"{1_048_560 - 2}, {1_048_560}, 5999999, {(1 << 28) - 17}"
    events = spark.read.parquet(f"{SF}/events.parquet").limit(1).drop("event_id").selectExpr(f"explode(array({ids})) AS event_id", "*").selectExpr("CAST(event_id AS BIGINT) AS event_id", "* EXCEPT (event_id)")
    events.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert same(catalog.QUERIES[name](spark, str(tmp_path)), con, catalog.ORACLES[name]) == 4


def test_scalars(spark):
    df = spark.createDataFrame([("yes", "{1, 2.5}", '"a"=>"1", "b"=>NULL'), ("", "[]", ""), (None, None, None)], "b string, v string, h string")
    rows = df.select(scalars.as_bool(F.col("b")), scalars.as_vector(F.col("v")), scalars.as_hstore(F.col("h"))).collect()
    assert tuple(rows[0]) == (True, [1.0, 2.5], {"a": "1", "b": None}) and tuple(rows[1]) == (None, [], {}) and tuple(rows[2]) == (None, None, None)
    assert scalars.quote_identifier("a`b") == "`a``b`"


def test_templates_and_mappings():
    t = m.Template.parse("raw_{{ .Table }}_v1")
    assert t.apply("x") == "raw_x_v1" and t.inverse("raw_x_v1") == "x" and t.inverse("other") is None
    for bad in ("plain", "{{ .Table }}{{ .Table }}", "{{ .Other }}", "{{ .Table"):
        with pytest.raises(m.MappingError):
            m.Template.parse(bad)
    a, b = m.TableMapping("s", "a"), m.TableMapping("s", "b", policy=m.WritePolicy("upsert", ("id",)))
    assert m.fingerprint(m.Mappings((a, b))) == m.fingerprint(m.Mappings((b, a))) != m.fingerprint(m.Mappings((a,)))
    m.validate(m.Mappings((a, b)))
    for bad in (
        m.Mappings((a, a)),
        m.Mappings((a, m.TableMapping("s", "b", target_table="a"))),
        m.Mappings((m.TableMapping("s", "a", columns={"x": "z", "y": "z"}),)),
        m.Mappings((m.TableMapping("s", "a", columns={"x": "y"}),)),
        m.Mappings((m.TableMapping("s", "a", policy=m.WritePolicy("upsert")),)),
        m.Mappings((m.TableMapping("s", "a", policy=m.WritePolicy("append", ("k",))),)),
        m.Mappings((m.TableMapping("s", "a", target_table="t_b"),), future_tables="t_{{ .Table }}"),
    ):
        with pytest.raises(m.MappingError):
            m.validate(bad)


def test_projection_rules():
    schema = ddl("id bigint, value string, secret string")
    t = m.TableMapping("s", "w", columns={"secret": None, "value": "v"}, policy=m.WritePolicy("upsert", ("id",)))
    assert m.projection(t, schema) == [("id", "id"), ("value", "v")]
    assert not m.is_identity(t, schema) and m.is_identity(m.TableMapping("s", "w"), schema)
    with pytest.raises(m.MappingError):
        m.projection(m.TableMapping("s", "w", columns={"value": "id"}), schema)
    with pytest.raises(m.MappingError):
        m.projection(m.TableMapping("s", "w", columns={"value": "_op"}), schema)
    with pytest.raises(m.MappingError):
        m.projection(m.TableMapping("s", "w", columns={"id": None}, policy=m.WritePolicy("upsert", ("id",))), schema)
    got = m.generate({("s", "a"): schema, ("s", "b"): schema}, {("s", "a"): ["id"]}, {("s", "a"): "value"})
    assert [t.policy.mode for t in got.tables] == ["upsert", "append"] and got.tables[0].policy.watermark == "value"


def test_types():
    rules = m.merge_type_rules({"NUMERIC": "string", "text": "string"}, {" Numeric ": "double", "varchar(3)": "char(3)", "int4[]": "array<bigint>"})
    assert m.mapped_type("numeric(10,2)", rules) == "double" and m.mapped_type("VARCHAR(3)", rules) == "char(3)" and m.mapped_type("_int4", rules) == "array<bigint>"
    assert m.mapped_type("public.text", rules) == "string" and m.mapped_type("xyz", rules) == "xyz"
    assert [m.spark_type(t) for t in ("numeric(10,2)", "int8", "text[]", "timestamptz", "date", "ext.thing", "odd")] == ["decimal(10,2)", "bigint", "array<string>", "timestamp", "date", "binary", "string"]


def test_diff_and_apply():
    old, new = ddl("id bigint not null, a int, b string"), ddl("id bigint not null, a bigint, c date")
    plan = evolve.diff("t", old, new)
    assert [c.kind.value for c in plan] == ["alter_type", "add_column", "drop_column"]
    assert {f.name: f.dataType for f in evolve.apply(old, plan)} == {f.name: f.dataType for f in new}
    assert evolve.diff("t", new, new) == [] and [c.kind.value for c in evolve.diff_shape("t", old, new)] == ["alter_type", "add_column"]
    assert evolve.reconcile(plan[1:], new) == "applied" and evolve.reconcile(plan[1:], old) == "not applied" and evolve.reconcile([evolve.Change(evolve.Kind.TRUNCATE, "t")], new) == "indeterminate"
    with pytest.raises(evolve.UnsupportedChange):
        evolve.additive_only(plan)


def test_ddl_text():
    (c,) = evolve.parse('CREATE TABLE IF NOT EXISTS "Sales West"."Orders" (id bigint PRIMARY KEY, "a,b" numeric(10,2) NOT NULL DEFAULT 0, PRIMARY KEY (id)); -- x')
    assert c.table == "Sales West.Orders" and c.columns == (("id", "bigint"), ("a,b", "numeric(10,2)"))
    plan = evolve.parse("ALTER TABLE t ADD COLUMN x int NOT NULL, DROP COLUMN y CASCADE, RENAME COLUMN a TO b, ALTER COLUMN z TYPE text USING z::text, ALTER z DROP NOT NULL")
    assert [p.kind.value for p in plan] == ["add_column", "drop_column", "rename_column", "alter_type", "alter_nullable"]
    assert evolve.render(plan[0]) == "ALTER TABLE `t` ADD COLUMN `x` int" and evolve.render(plan[3], "snowflake") == 'ALTER TABLE "t" ALTER COLUMN "z" SET DATA TYPE text'
    assert evolve.render(evolve.parse("ALTER TABLE a RENAME TO b")[0], "clickhouse") == "RENAME TABLE `a` TO `b`" and evolve.parse("TRUNCATE t")[0].kind is evolve.Kind.TRUNCATE
    for bad in ("GRANT ALL ON t TO u", "ALTER TABLE t OWNER TO u"):
        with pytest.raises(evolve.UnsupportedChange):
            evolve.parse(bad)
    with pytest.raises(evolve.UnsupportedChange):
        evolve.render(plan[4], "clickhouse")
    kept = evolve.project_changes(plan, m.TableMapping("s", "t", target_table="u", columns={"x": None, "a": "aa", "b": "bb"}))
    assert [(k.kind.value, k.column, k.to) for k in kept][:2] == [("drop_column", "y", None), ("rename_column", "aa", "bb")] and kept[0].table == "s.u"


def test_cursors_and_manifests():
    for part, keys in ((None, [1, "a"]), ("x", []), (3, [2])):
        assert backfill.decode_cursor(backfill.encode_cursor(part, keys)) == (part, keys)
    assert backfill.decode_cursor("plain-old") == ("plain-old", [])
    a, b = {"relation": "a", "task": 1}, {"relation": "a", "task": 2}
    assert backfill.manifest([a, b]) == backfill.manifest([b, a])
    with pytest.raises(ValueError):
        backfill.manifest([a] * 257)
    assert len(backfill.jdbc_predicates("id", 4)) == 4


def test_policies_and_states():
    sinks.check_policy("postgres", "upsert", True, True)
    for bad in (("kafka", "upsert"), ("nowhere", "append")):
        with pytest.raises(sinks.UnsupportedTarget):
            sinks.check_policy(*bad)
    assert lifecycle.may_follow("created", "running") and not lifecycle.may_follow("stopped", "paused")
    sinks.register("mine", lambda x: x + 1)
    assert sinks.make("mine", x=1) == 2
    with pytest.raises(ValueError):
        lifecycle.prunable(None, None, None, 0)


def test_gate_and_retry():
    g = apply.Gate()
    g.seen("add x")
    with pytest.raises(apply.GateClosed):
        g.check()
    g.decide("add x", "approved")
    g.check()
    g.decide("add x", "applied")
    with pytest.raises(ValueError):
        g.decide("add x", "rejected")
    tries = []
    assert apply.with_retry(lambda: tries.append(1) or (len(tries) == 3 or 1 / 0)) is True


def test_tables_and_messages(spark):
    from changeweave.sources import messages, tables

    p = tables.Poller()
    a, b = ddl("id bigint, x int"), ddl("id bigint, x int, y date")
    assert [(t, v, s, c[0].kind.value) for t, v, s, c in p.poll({"t": a})] == [("t", 1, "pending", "create_table")]
    assert p.poll({"t": a}) == [] and [(v, [k.kind.value for k in c]) for _, v, _, c in p.poll({"t": b})] == [(2, ["add_column"])]
    assert p.poll({})[0][3][0].kind.value == "drop_table"
    plan = tables.match_fields({1: a["id"], 2: a["x"]}, {1: a["id"], 2: ddl("z int")["z"], 3: b["y"]})
    assert [(c.kind.value, c.column, c.to) for c in plan] == [("rename_column", "x", "z"), ("add_column", "y", None)]
    relations = [("s", "a", "table"), ("s", "v", "view"), ("s", "p", "partitioned"), ("o", "b", "table")]
    assert tables.include(relations, schemas=["s"]) == [("s", "a")] and tables.include(relations, tables=["o.b"]) == [("o", "b")]
    with pytest.raises(ValueError):
        tables.include(relations, tables=["s.p"])
    spark.createDataFrame([(1, "a")], "id long, name string").createOrReplaceTempView("people")
    assert tables.schema_of(spark, "people", ["name"]).names == ["name"]
    assert messages.available(spark, "parquet") and not messages.available(spark, "kafka")
    with pytest.raises(sinks.UnsupportedTarget):
        messages.require(spark, "iceberg")
    with pytest.raises(sinks.UnsupportedTarget):
        messages.payload_mode("wal", False)
    df = spark.createDataFrame([(1, "0/1", "insert", "x" * 50)], "k long, lsn string, op string, v string")
    assert messages.log_messages(df, "t", "k", ["v"], 20).first().too_big and messages.log_messages(df, "t", "k", ["v"], 20, "drop").count() == 0


@pytest.mark.parametrize("span", [1, 3, 100])
def test_overlaps_across_ranges(spark, span):
    rows = [(x, x * 8 - x % 3, x * 8 + 7) for x in range(1000) if not 300 <= x < 520]  # a gap of whole ranges
    rows[rows.index((520, 4159, 4167))] = (520, 2390, 4167)
    want = {(b[0], b[1], a[2]) for a, b in zip(rows, rows[1:]) if a[2] >= b[1]}
    df = spark.createDataFrame(rows, "xid long, first_seq long, last_seq long").repartition(5)
    got = [tuple(r) for r in sinks.overlaps(df, "xid", span).collect()]
    assert len(got) == len(want) and set(got) == want and {100, 520} <= {x for x, _, _ in got}


def test_bisect_by_real_sizes(spark):
    batches = {1: [90, 1, 1, 1, 1, 1, 1, 1], 2: [2, 3], 3: [50], 4: [1, 1, 60, 30, 5, None, 7], 5: [3] * 13}

    def by_hand(sizes, first=0, n=0):
        if sum(sizes) <= 10 or len(sizes) == 1:
            return [(first, len(sizes), sum(sizes), n)]
        mid = len(sizes) // 2
        return by_hand(sizes[:mid], first, n + 1) + by_hand(sizes[mid:], first + mid, n + 1)

    rows = [(x, i, s) for x, sizes in batches.items() for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "xid long, seq long, size long").repartition(3)
    got = sorted(tuple(r) for r in artifacts.bisected(df, "xid", "seq", F.col("size"), 10).collect())
    assert got == sorted((x, *p) for x, sizes in batches.items() for p in by_hand([s or 0 for s in sizes]))
