"""The registered queries of the change-data operators, each with the SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeweave.functions import position, scalars
from changeweave.operators import artifacts, certify, changelog, evolve, fold, guard, lifecycle, mapping, queue
from changeweave.sources import backfill, sinks, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: events as a changelog, as in operators.changelog.from_events.
CL = """cl AS (
  SELECT user_id AS k, event_id AS seq, event_id * 16 + 256 AS pos, '0/' || upper(to_hex(event_id * 16 + 256)) AS lsn, event_id // 8 AS xid,
    CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op, event_type, CAST(round(value * 100) AS BIGINT) AS val, props, ts,
    event_id * 7919 % 1009 AS wm, event_type = 'signup' OR (event_type <> 'error' AND event_id % 3 <> 0) AS has_val, event_type = 'signup' OR (event_type <> 'error' AND event_id % 5 <> 0) AS has_props
  FROM events)"""
COLUMNS = {"val": "has_val", "props": "has_props"}


def query(name: str, sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def framed(*exprs: str) -> str:
    """SQL of functions.scalars.framed."""
    return " || ".join(f"coalesce(length(CAST({e} AS VARCHAR)) || ':' || CAST({e} AS VARCHAR), 'n')" for e in exprs)


def _fold_sql(rows: str, p: str = "") -> str:
    """Meaning of the fold in SQL, by windows: the rows after the last delete, and of them the last present values. p: suffix of the CTEs."""
    return f"""z{p} AS (SELECT *, max(CASE WHEN op = 'delete' THEN seq END) OVER (PARTITION BY k) AS gone, max(seq) OVER (PARTITION BY k) AS last_order FROM {rows}),
y{p} AS (SELECT * FROM z{p} WHERE op <> 'delete' AND (gone IS NULL OR seq > gone)),
v{p} AS (SELECT k, val FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS n FROM y{p} WHERE has_val) WHERE n = 1),
p{p} AS (SELECT k, props FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS n FROM y{p} WHERE has_props) WHERE n = 1),
state{p} AS (SELECT DISTINCT y.k AS k, v.val, p.props, y.last_order FROM y{p} y LEFT JOIN v{p} v ON y.k = v.k LEFT JOIN p{p} p ON y.k = p.k)"""


# --- fold -------------------------------------------------------------------------------------------------------------


@query("cdc_current_state", f"WITH {CL} SELECT k, seq, event_type, val FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS n FROM cl) WHERE n = 1 AND op <> 'delete'")
def cdc_current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changelog.from_events(spark, sf_dir)
    return fold.current_state(rows, ["k"], {"event_type": None, "val": None}).select("k", F.col("last_order").alias("seq"), "event_type", "val")


@query("cdc_partial_image_fold", f"WITH {CL}, {_fold_sql('cl')} SELECT k, val, props, last_order FROM state")
def cdc_partial_image_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.current_state(changelog.from_events(spark, sf_dir), ["k"], COLUMNS)


@query("cdc_append_log", f"WITH {CL} SELECT seq, k, CASE WHEN op = 'delete' THEN k END AS before_k, val, op AS _op, op = 'delete' AS _deleted, pos AS _pos FROM cl")
def cdc_append_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changelog.from_events(spark, sf_dir).withColumn("before_seq", F.col("seq")).withColumn("before_k", F.col("k")).withColumn("before_val", F.col("val"))
    return mapping.append_rows(rows, ["seq", "k", "val"]).withColumn("before_k", F.when(F.col("_deleted"), F.col("k")))


_EPOCH = "SELECT *, coalesce(sum(CASE WHEN op = 'delete' THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM cl"
_HYDRATED = f"""h AS (SELECT k, seq, pos, op, has_val, has_props,
  CASE WHEN op <> 'delete' THEN last_value(CASE WHEN has_val THEN val END IGNORE NULLS) OVER w END AS val,
  CASE WHEN op <> 'delete' THEN last_value(CASE WHEN has_props THEN props END IGNORE NULLS) OVER w END AS props
  FROM ({_EPOCH}) WINDOW w AS (PARTITION BY k, epoch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("cdc_toast_hydrate", f"WITH {CL}, {_HYDRATED} SELECT k, seq, op, val, props FROM h")
def cdc_toast_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.hydrated(changelog.from_events(spark, sf_dir), ["k"], COLUMNS).select("k", "seq", "op", "val", "props")


_SPLIT = f"""{_HYDRATED}, s AS (
  SELECT k, seq * 2 AS seq, CASE WHEN op = 'update' AND seq % 97 = 0 THEN 'delete' ELSE op END AS op, val, props,
    NOT (op = 'update' AND seq % 97 = 0) AND op <> 'delete' AS has_val, NOT (op = 'update' AND seq % 97 = 0) AND op <> 'delete' AS has_props FROM h
  UNION ALL SELECT k + 1000000, seq * 2 + 1, 'insert', val, props, true, true FROM h WHERE op = 'update' AND seq % 97 = 0)"""


def _split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 97th update moves its key; images are hydrated first, so no column is lost on the way."""
    rows = fold.hydrated(changelog.from_events(spark, sf_dir), ["k"], COLUMNS)
    rows = rows.withColumn("new_k", F.when((F.col("op") == "update") & (F.col("seq") % 97 == 0), F.col("k") + 1_000_000).otherwise(F.col("k")))
    rows = fold.split_key_changes(rows.withColumnRenamed("k", "old_k"), "old_k", "new_k", "k")
    full = F.col("op") != "delete"
    return rows.withColumn("seq", F.col("seq") * 2 + F.col("part")).withColumn("has_val", full).withColumn("has_props", full)


@query("cdc_key_change_split", f"WITH {CL}, {_SPLIT}, {_fold_sql('s')} SELECT k, val, props, last_order FROM state")
def cdc_key_change_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.current_state(_split_rows(spark, sf_dir), ["k"], COLUMNS)


@query("cdc_truncate_reset", f"WITH {CL}, t AS (SELECT * FROM cl WHERE seq > (SELECT max(event_id) // 2 FROM events)), {_fold_sql('t')} SELECT k, val, props, last_order FROM state")
def cdc_truncate_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changelog.from_events(spark, sf_dir)
    truncates = rows.agg(F.expr("max(seq) div 2").alias("at"))  # the truncate record: one row
    return fold.current_state(rows, ["k"], COLUMNS, since=truncates)


_TARGET = "t AS (SELECT c_custkey AS k, CAST(round(c_acctbal * 100) AS BIGINT) AS val, c_mktsegment AS props FROM customer)"
_LAST_UPDATE = """x AS (SELECT *, row_number() OVER (PARTITION BY k, has_val ORDER BY seq DESC) AS nv, row_number() OVER (PARTITION BY k, has_props ORDER BY seq DESC) AS np FROM cl WHERE op = 'update'),
u AS (SELECT k, max(val) FILTER (WHERE has_val AND nv = 1) AS val, max(props) FILTER (WHERE has_props AND np = 1) AS props, bool_or(has_val) AS has_val, bool_or(has_props) AS has_props FROM x GROUP BY k)"""


def _target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.round(F.col("c_acctbal") * 100).cast("long").alias("val"), F.col("c_mktsegment").alias("props"))


@query("cdc_apply_update_join", f"WITH {CL}, {_TARGET}, {_LAST_UPDATE} SELECT t.k, CASE WHEN u.has_val THEN u.val ELSE t.val END AS val, CASE WHEN u.has_props THEN u.props ELSE t.props END AS props FROM t LEFT JOIN u ON t.k = u.k")
def cdc_apply_update_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = fold.latest_images(changelog.from_events(spark, sf_dir).where("op = 'update'"), ["k"], COLUMNS)
    return fold.apply_updates(_target(spark, sf_dir), updates, ["k"], COLUMNS)


@query("cdc_apply_delete_anti", f"WITH {CL}, {_TARGET} SELECT * FROM t WHERE k NOT IN (SELECT k FROM cl WHERE op = 'delete')")
def cdc_apply_delete_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.apply_deletes(_target(spark, sf_dir), changelog.from_events(spark, sf_dir).where("op = 'delete'"), ["k"])


@query(
    "cdc_upsert_outer",
    f"WITH {CL}, {_TARGET}, {_LAST_UPDATE} SELECT coalesce(t.k, u.k) AS k, CASE WHEN coalesce(u.has_val, false) THEN u.val ELSE t.val END AS val, CASE WHEN coalesce(u.has_props, false) THEN u.props ELSE t.props END AS props FROM t FULL JOIN u ON t.k = u.k",
)
def cdc_upsert_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fold.latest_images(changelog.from_events(spark, sf_dir).where("op = 'update'"), ["k"], COLUMNS)
    return fold.upsert(_target(spark, sf_dir), rows, ["k"], COLUMNS)


@query(
    "cdc_snapshot_plus_stream",
    f"WITH {CL}, m AS (SELECT max(event_id) // 2 AS cut FROM events), a AS (SELECT cl.* FROM cl, m WHERE seq <= cut), {_fold_sql('a')}, "
    "r AS (SELECT k, last_order AS seq, 'load' AS op, val, props, true AS has_val, true AS has_props FROM state UNION ALL SELECT k, seq, op, val, props, has_val, has_props FROM cl, m WHERE seq > cut), "
    + _fold_sql("r", "2")
    + " SELECT k, val, props, last_order FROM state2",
)
def cdc_snapshot_plus_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changelog.from_events(spark, sf_dir)
    rows = rows.join(F.broadcast(rows.agg(F.expr("max(seq) div 2").alias("at"))))  # the snapshot's position: one row
    snapshot = fold.current_state(rows.where("seq <= at"), ["k"], COLUMNS).select(
        "k", F.col("last_order").alias("seq"), F.lit("load").alias("op"), "val", "props", F.lit(True).alias("has_val"), F.lit(True).alias("has_props")
    )
    stream = rows.where("seq >= at - 50").select("k", "seq", "op", "val", "props", "has_val", "has_props", "at")
    return fold.current_state(fold.snapshot_plus_stream(snapshot, stream, F.col("at")), ["k"], COLUMNS)


@query("cdc_staging_append", "SELECT o_orderkey AS k, o_orderstatus AS status FROM orders UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 10 = 0")
def cdc_staging_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))
    return sinks.resolve_staging(target, target.where("k % 10 = 0"), "append")


@query("cdc_staging_replace", "SELECT o_orderkey AS k, o_orderstatus AS status FROM orders WHERE o_orderkey % 10 = 0")
def cdc_staging_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))
    return sinks.resolve_staging(target, target.where("k % 10 = 0"), "replace")


@query("cdc_metadata_latest", f"WITH {CL} SELECT k, 'events' AS tbl, op, lsn, op = 'delete' AS is_deleted, '{{\"k\":' || k || '}}' AS key_json FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS n FROM cl) WHERE n = 1")
def cdc_metadata_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.metadata_rows(changelog.from_events(spark, sf_dir), ["k"], "events")


@query("cdc_final_view", f"WITH {CL} SELECT k, xid, pos, op FROM (SELECT *, row_number() OVER (PARTITION BY k, xid ORDER BY pos DESC) AS n FROM cl) WHERE n = 1")
def cdc_final_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.newest(changelog.from_events(spark, sf_dir), ["k", "xid"], "pos").select("k", "xid", "pos", "op")


@query(
    "cdc_changelog_rows",
    f"WITH {CL} SELECT sha256({framed("'events'", "pos", "seq % 8")}) AS identity, pos AS version, xid, seq % 8 AS ordinal, op, op = 'delete' AS tombstone, '{{\"k\":' || k || '}}' AS key_json, "
    f"sha256({framed('k', 'op', 'val', 'props')}) AS row_hash FROM cl",
)
def cdc_changelog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changelog.from_events(spark, sf_dir).withColumn("ordinal", F.col("seq") % 8)
    return sinks.changelog_rows(rows, "events", ["k"], ["val", "props"])


# --- guard ------------------------------------------------------------------------------------------------------------

_GUARD = f"""WITH {CL}, r AS (SELECT *, seq AS arrival FROM cl UNION ALL SELECT *, seq + 1000000000 FROM cl WHERE seq % 10 = 0),
b AS (SELECT *, max(wm * 1000000000 + pos) OVER (PARTITION BY k ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top, wm * 1000000000 + pos AS ver FROM r),
d AS (SELECT *, CASE WHEN top IS NULL OR ver > top THEN 'accept' WHEN ver < top THEN 'stale' ELSE 'replay' END AS decision FROM b)"""


def _guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changelog.from_events(spark, sf_dir)
    rows = rows.withColumn("arrival", F.col("seq")).unionByName(rows.where("seq % 10 = 0").withColumn("arrival", F.col("seq") + 1_000_000_000))
    return guard.decisions(rows.withColumn("digest", scalars.sha(F.col("op"), F.col("val"), F.col("props"))), ["k"], "wm", "pos", "arrival", "digest")


@query("cdc_guard_decisions", f"{_GUARD} SELECT k, arrival, decision FROM d")
def cdc_guard_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _guarded(spark, sf_dir).select("k", "arrival", "decision")


@query("cdc_guarded_upsert", f"{_GUARD}, c AS (SELECT * EXCLUDE (seq), arrival AS seq FROM d WHERE decision = 'accept'), {_fold_sql('c')} SELECT k, val, props, last_order FROM state")
def cdc_guarded_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.current_state(_guarded(spark, sf_dir).where("decision = 'accept'"), ["k"], COLUMNS, order="arrival")


@query("cdc_guard_tombstones", f"WITH {CL} SELECT k, wm AS guard, pos, op = 'delete' AS deleted FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY wm DESC, pos DESC) AS n FROM cl) WHERE n = 1")
def cdc_guard_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.tombstones(changelog.from_events(spark, sf_dir), ["k"], "wm", "pos")


@query("cdc_guard_seed", "SELECT o_orderkey AS k, CAST(epoch(o_orderdate) AS BIGINT) AS guard, CAST(4096 AS BIGINT) AS pos, false AS deleted FROM (SELECT o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_orderkey)")
def cdc_guard_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)").cast("long")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), seconds.alias("wm"), F.lit(4096).cast("long").alias("pos"), F.lit("load").alias("op"))
    return guard.tombstones(rows, ["k"], "wm", "pos")


# --- batches and transactions -----------------------------------------------------------------------------------------


@query("cdc_op_runs", f"WITH {CL}, a AS (SELECT *, CASE WHEN lag(op) OVER (PARTITION BY k ORDER BY seq) IS DISTINCT FROM op AND row_number() OVER (PARTITION BY k ORDER BY seq) > 1 THEN 1 ELSE 0 END AS s FROM cl) SELECT k, seq, op, CAST(sum(s) OVER (PARTITION BY k ORDER BY seq) AS BIGINT) AS run FROM a")
def cdc_op_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.runs(changelog.from_events(spark, sf_dir), ["op"], ["seq"], ["k"]).select("k", "seq", "op", "run")


@query("cdc_txn_fragments", f"WITH {CL}, a AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS s FROM cl WINDOW w AS (PARTITION BY xid ORDER BY seq)), f AS (SELECT *, CAST(sum(s) OVER (PARTITION BY xid ORDER BY seq) AS BIGINT) AS fragment FROM a) SELECT xid, fragment, event_type AS tbl, count(*) AS n, min(seq) AS first_seq FROM f GROUP BY ALL")
def cdc_txn_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changelog.runs(changelog.from_events(spark, sf_dir), ["event_type"], ["seq"], ["xid"], "fragment")
    return rows.groupBy("xid", "fragment", F.col("event_type").alias("tbl")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


@query("cdc_txn_stamp", f"WITH {CL} SELECT seq, xid, max(pos) OVER (PARTITION BY xid) AS commit_pos, row_number() OVER (PARTITION BY xid ORDER BY seq) - 1 AS ordinal FROM cl")
def cdc_txn_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.stamped(changelog.from_events(spark, sf_dir)).select("seq", "xid", "commit_pos", "ordinal")


@query("cdc_subtxn_abort", f"WITH {CL} SELECT seq, xid * 10 + seq % 3 AS subxid FROM cl WHERE (xid * 10 + seq % 3) % 7 <> 0")
def cdc_subtxn_abort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changelog.from_events(spark, sf_dir).select("seq", (F.col("xid") * 10 + F.col("seq") % 3).alias("subxid"))
    return changelog.committed(rows, rows.where("subxid % 7 = 0")).select("seq", "subxid")


@query("cdc_ddl_segments", f"WITH {CL} SELECT seq, CAST(sum(CASE WHEN seq % 1000 = 500 THEN 1 ELSE 0 END) OVER (PARTITION BY seq // 1000 ORDER BY seq) AS BIGINT) AS segment FROM cl")
def cdc_ddl_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changelog.from_events(spark, sf_dir).select("seq", F.expr("seq div 1000").alias("txn"), (F.col("seq") % 1000 == 500).alias("ddl"))
    return changelog.ddl_segments(rows, "txn", "seq", F.col("ddl")).select("seq", "segment")


@query("batch_validate", f"WITH {CL} SELECT xid, count(*) AS n, count(DISTINCT event_type) <= 1 AS one_table, NOT (bool_or(seq % 50 = 0) AND bool_or(seq % 50 <> 0)) AS one_kind, true AS known_ops FROM cl GROUP BY xid")
def batch_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changelog.from_events(spark, sf_dir).select("xid", F.col("event_type").alias("tbl"), F.lit(1).alias("version"), F.when(F.col("seq") % 50 == 0, "ddl").otherwise(F.col("op")).alias("op"))
    return changelog.sound_batches(rows, "xid")


@query("ordinal_gaps", f"WITH {CL} SELECT xid, count(*) AS n, min(seq % 8) AS lowest, max(seq % 8) AS highest, count(DISTINCT seq % 8) AS distinct_ordinals FROM cl WHERE seq % 11 <> 0 GROUP BY xid HAVING min(seq % 8) <> 0 OR max(seq % 8) <> count(*) - 1 OR count(DISTINCT seq % 8) <> count(*)")
def ordinal_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changelog.from_events(spark, sf_dir).where("seq % 11 <> 0").withColumn("ordinal", F.col("seq") % 8)
    return changelog.ordinal_gaps(rows, "xid", "ordinal")


@query("checkpoint_regressions", f"WITH {CL} SELECT k, seq, wm, previous FROM (SELECT k, seq, wm, lag(wm) OVER (PARTITION BY k ORDER BY seq) AS previous FROM cl) WHERE previous > wm")
def checkpoint_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.regressions(changelog.from_events(spark, sf_dir), "k", "seq", "wm").select("k", "seq", "wm", "previous")


@query("wire_key_json", "SELECT l_orderkey, l_linenumber, '{\"l_linenumber\":' || l_linenumber || ',\"l_orderkey\":' || l_orderkey || '}' AS key_json FROM lineitem")
def wire_key_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", changelog.key_json(["l_orderkey", "l_linenumber"]).alias("key_json"))


# --- projections ------------------------------------------------------------------------------------------------------

ORDERS = mapping.TableMapping("public", "orders", target_table="sales", columns={"o_orderkey": "id", "o_orderpriority": None, "o_totalprice": None}, policy=mapping.WritePolicy("upsert", ("o_orderkey",)))


@query("proj_rename_prune", "SELECT o_orderkey AS id, o_custkey, o_orderstatus, o_orderdate FROM orders")
def proj_rename_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.project(table(spark, sf_dir, "orders"), ORDERS)


@query("proj_template", "SELECT s_suppkey AS src_s_suppkey_v1, s_name AS src_s_name_v1, s_nationkey AS src_s_nationkey_v1 FROM supplier")
def proj_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.project(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), mapping.TableMapping("public", "supplier", future_columns="src_{{ .Column }}_v1"))


@query("proj_table_filter", f"WITH {CL} SELECT seq, event_type AS tbl FROM cl WHERE event_type NOT IN ('error', 'signup')")
def proj_table_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mapping.Mappings((mapping.TableMapping("app", "error", include=False), mapping.TableMapping("app", "signup", include=False)), future_tables="t_{{ .Table }}")
    rows = changelog.from_events(spark, sf_dir).select("seq", F.col("event_type").alias("tbl"), F.lit("app").alias("schema"))
    return mapping.keep_tables(rows, m).select("seq", "tbl")


@query("proj_renumber", f"WITH {CL} SELECT seq, xid, dense_rank() OVER (PARTITION BY xid ORDER BY seq % 8) - 1 AS fragment FROM cl WHERE event_type <> 'error'")
def proj_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changelog.from_events(spark, sf_dir).withColumn("fragment", F.col("seq") % 8)
    return mapping.renumbered(rows, "xid", "fragment", F.col("event_type") != "error").select("seq", "xid", "fragment")


@query("proj_upsert_key", f"WITH {CL} SELECT seq, coalesce(CASE WHEN op <> 'delete' THEN k END, k) AS key FROM cl")
def proj_upsert_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changelog.from_events(spark, sf_dir)
    return rows.select("seq", mapping.resolved_key(F.when(F.col("op") != "delete", F.col("k")), F.when(F.col("op") == "delete", F.col("k")), F.col("k")).alias("key"))


@query("proj_image", f"WITH {CL} SELECT seq, CASE WHEN op <> 'delete' THEN val END AS amount, op = 'delete' AS no_image FROM cl")
def proj_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changelog.from_events(spark, sf_dir).select("seq", F.when(F.col("op") != "delete", F.struct("k", "val", "props")).alias("after"))
    t = mapping.TableMapping("app", "events", columns={"val": "amount", "props": None})
    image = mapping.project_image(F.col("after"), t, rows.schema["after"].dataType)
    return rows.withColumn("image", image).select("seq", F.col("image.amount").alias("amount"), F.col("image").isNull().alias("no_image"))


@query("proj_unchanged", f"WITH {CL} SELECT seq, CASE WHEN op = 'update' AND NOT has_val THEN 'amount' ELSE '' END AS unchanged FROM cl")
def proj_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changelog.from_events(spark, sf_dir)
    lacks = F.filter(F.array(F.when((F.col("op") == "update") & ~F.col("has_val"), "val"), F.when((F.col("op") == "update") & ~F.col("has_props"), "props")), lambda c: c.isNotNull())
    t = mapping.TableMapping("app", "events", columns={"val": "amount", "props": None})
    return rows.select("seq", F.array_join(mapping.project_unchanged(lacks, t, rows.select("k", "val", "props").schema), ",").alias("unchanged"))


@query("proj_cast_types", "SELECT o_orderkey AS k, CAST(o_orderkey AS INTEGER) AS small, CAST(o_orderdate AS DATE) AS day FROM orders")
def proj_cast_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").alias("small"), F.col("o_orderdate").alias("day"))
    return mapping.cast_types(rows, {"small": "int4", "day": "date"})


@query("wire_envelope", f"WITH {CL} SELECT op AS _op, ts AS _ts, CAST(1 AS BIGINT) AS _version, 'events' AS _table, 'app' AS _namespace, '{{\"k\":' || k || '}}' AS _key, CASE WHEN op = 'delete' THEN '{{\"k\":' || k || '}}' END AS _before, CASE WHEN op <> 'delete' THEN k END AS k, CASE WHEN op <> 'delete' THEN val END AS val FROM cl")
def wire_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = changelog.key_json(["k"])
    return mapping.envelope(changelog.from_events(spark, sf_dir), ["k", "val"], "events", "app", key, F.when(F.col("op") == "delete", key))


@query("wire_record_json", f"WITH {CL} SELECT seq, '{{\"k\":' || k || ',\"op\":\"' || op || '\",\"val\":' || coalesce(CAST(val AS VARCHAR), 'null') || '}}' AS record FROM cl")
def wire_record_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.from_events(spark, sf_dir).select("seq", mapping.record_json(["k", "op", "val"]).alias("record"))


# --- positions, digests, tokens ---------------------------------------------------------------------------------------


@query("lsn_canonical", f"WITH {CL} SELECT seq, lsn AS canonical FROM cl")
def lsn_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("000/00"), F.lower(F.substring("lsn", 3, 20)))
    return changelog.from_events(spark, sf_dir).select("seq", position.canonical(raw).alias("canonical"))


@query("lsn_numeric", f"WITH {CL} SELECT seq, CAST(pos AS DECIMAL(20,0)) AS number FROM cl")
def lsn_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.from_events(spark, sf_dir).select("seq", position.number(F.col("lsn")).alias("number"))


@query("lsn_lag", f"WITH {CL} SELECT k, max(pos) - max(CASE WHEN seq % 4 = 3 THEN pos ELSE 0 END) AS lag FROM cl GROUP BY k")
def lsn_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.lag(changelog.from_events(spark, sf_dir), "k", "pos", F.col("seq") % 4 == 3)


@query("content_hash", f"WITH {CL}, r AS (SELECT xid, seq, {framed('k', 'op', 'val', 'props')} AS r FROM cl) SELECT xid, sha256(string_agg(r, '' ORDER BY seq)) AS digest FROM r GROUP BY xid")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.batch_digests(changelog.from_events(spark, sf_dir), "xid", "seq", ["k", "op", "val", "props"])


@query(
    "logical_batch_id",
    f"WITH {CL}, r AS (SELECT xid, seq, pos, {framed('k', 'op', 'val', 'props')} AS r FROM cl), d AS (SELECT xid, max(pos) AS pos, sha256(string_agg(r, '' ORDER BY seq)) AS digest FROM r GROUP BY xid) "
    f"SELECT xid, 'batch:' || sha256({framed("'events'", 'pos', 'digest')}) AS batch_id FROM d",
)
def logical_batch_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.logical_batch_ids(changelog.from_events(spark, sf_dir), "xid", "seq", "pos", ["k", "op", "val", "props"], "events")


@query("checkpoint_id", f"WITH {CL} SELECT seq, 'checkpoint:' || sha256({framed("'lsn'", "lsn", "'xid'", "xid")}) AS checkpoint_id FROM cl")
def checkpoint_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.from_events(spark, sf_dir).select("seq", position.checkpoint_id({"lsn": F.col("lsn"), "xid": F.col("xid")}).alias("checkpoint_id"))


@query("idempotency_key", f"WITH {CL} SELECT seq, sha256({framed("'events'", "lsn", "op", "k")}) AS id_key, coalesce(nullif(lsn, ''), sha256(CAST(k AS VARCHAR))) AS txn_id FROM cl")
def idempotency_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.from_events(spark, sf_dir).select("seq", scalars.sha(F.lit("events"), F.col("lsn"), F.col("op"), F.col("k")).alias("id_key"), sinks.transaction_id(F.col("lsn"), F.col("k")).alias("txn_id"))


@query("kafka_key_hash", f"WITH {CL} SELECT seq, sha256(CASE WHEN seq % 4 = 0 THEN {framed("'events'", "lsn", "op")} ELSE CAST(k AS VARCHAR) END) AS key_hash FROM cl")
def kafka_key_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("seq") % 4 == 0, "").otherwise(F.col("k").cast("string"))
    return changelog.from_events(spark, sf_dir).select("seq", sinks.message_key(key, F.lit("events"), F.col("lsn"), F.col("op")).alias("key_hash"))


@query("path_token", "SELECT c_custkey, 'v1-' || rtrim(replace(replace(to_base64(encode(c_name)), '+', '-'), '/', '_'), '=') AS token, substr(sha256(c_name), 1, 16) AS short FROM customer")
def path_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.path_token(F.col("c_name")).alias("token"), scalars.short_hash(F.col("c_name")).alias("short"))


@query("partition_bucket", "SELECT event_id, strftime(ts, '%Y') AS y, strftime(ts, '%Y-%m') AS m, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%Y-%m-%d-%H') AS h, CASE WHEN event_id % 7 = 0 THEN '__null__' ELSE event_type END AS part FROM events")
def partition_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    buckets = [scalars.time_bucket(F.col("ts"), b).alias(b[0]) for b in ("year", "month", "day", "hour")]
    return e.select("event_id", *buckets, scalars.partition_value(F.when(F.col("event_id") % 7 != 0, F.col("event_type"))).alias("part"))


@query("time_parse", "SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS parsed FROM events")
def time_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return e.select("event_id", scalars.parse_time(text).alias("parsed"))


@query(
    "normalize_values",
    "WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'T' WHEN 1 THEN ' no' WHEN 2 THEN '' WHEN 3 THEN '42' WHEN 4 THEN '007' ELSE '1.5e3' END AS raw FROM events) "
    "SELECT event_id, CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN false END AS as_bool, CASE event_id % 6 WHEN 3 THEN 42 WHEN 4 THEN 7 END::BIGINT AS as_int, CASE event_id % 6 WHEN 3 THEN '42' WHEN 5 THEN '1.5e3' END AS as_number, event_id % 6 IN (0, 1, 5) AS bad_int FROM t",
)
def normalize_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id")
    raw = F.element_at(F.array(*[F.lit(x) for x in ("T", " no", "", "42", "007", "1.5e3")]), (F.col("event_id") % 6 + 1).cast("int"))
    return e.withColumn("raw", raw).select("event_id", scalars.as_bool(F.col("raw")).alias("as_bool"), scalars.as_int(F.col("raw")).alias("as_int"), scalars.as_number(F.col("raw")).alias("as_number"), scalars.invalid(F.col("raw"), scalars.as_int(F.col("raw"))).alias("bad_int"))


@query("normalize_uuid", "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN substr(md5(c_name), 1, 8) || '-' || substr(md5(c_name), 9, 4) || '-' || substr(md5(c_name), 13, 4) || '-' || substr(md5(c_name), 17, 4) || '-' || substr(md5(c_name), 21, 12) END AS uuid FROM customer")
def normalize_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.upper(F.md5(F.col("c_name").cast("binary")))
    text = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.as_uuid(F.when(F.col("c_custkey") % 3 == 0, F.concat(text, F.lit("x"))).otherwise(text)).alias("uuid"))


@query("vector_parse", "SELECT event_id, CAST(len([event_id % 9, event_id % 5]) AS INTEGER) AS n, CAST(event_id % 9 AS FLOAT) AS first_value FROM events")
def vector_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = scalars.as_vector(F.concat(F.lit("["), (F.col("event_id") % 9).cast("string"), F.lit(", "), (F.col("event_id") % 5).cast("string"), F.lit("]")))
    return table(spark, sf_dir, "events").select("event_id", F.size(v).alias("n"), F.element_at(v, 1).alias("first_value"))


@query("hstore_parse", "SELECT event_id, event_type AS kind, CAST(NULL AS VARCHAR) AS nothing FROM events")
def hstore_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = scalars.as_hstore(F.concat(F.lit('"kind"=>"'), "event_type", F.lit('", "nothing"=>NULL')))
    return table(spark, sf_dir, "events").select("event_id", h["kind"].alias("kind"), h["nothing"].alias("nothing"))


@query("retry_backoff", "SELECT event_id, CAST(least(30000, 50 * power(2, least(event_id % 60, 40))) AS BIGINT) AS wait_ms FROM events")
def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", scalars.backoff(F.col("event_id") % 60, 50, 30_000).alias("wait_ms"))


@query("field_ids", "SELECT p_partkey, CAST(('0x' || substr(sha256('lineage/part/' || p_name), 1, 8))::BIGINT & 2147483647 AS BIGINT) AS field_id FROM part")
def field_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", scalars.field_id(F.lit("lineage"), F.lit("part"), F.col("p_name")).alias("field_id"))


@query("decimal_fits", "SELECT event_id, event_id % 1000 < 100 AS fits FROM events")
def decimal_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat((F.col("event_id") % 1000).cast("string"), F.lit(".25"))
    return table(spark, sf_dir, "events").select("event_id", scalars.fits_decimal(text, 4, 2).alias("fits"))


# --- scans ------------------------------------------------------------------------------------------------------------


@query("backfill_load", "SELECT c_custkey AS k, 'load' AS op FROM customer")
def backfill_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backfill.loads(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))).select("k", "op")


@query("backfill_partition_law", "SELECT count(*) AS n, count(*) AS in_one_partition, CAST(8 AS BIGINT) AS partitions FROM customer")
def backfill_partition_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row lies in exactly one of the partitions, and all are used: n predicates together select each row once."""
    c = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 10 != 0, F.col("c_name")).alias("part"))
    p = backfill.hash_partition(F.col("part"), 8)
    hits = sum((p == i).cast("int") for i in range(8))
    return c.agg(F.count(F.lit(1)).alias("n"), F.sum((hits == 1).cast("long")).alias("in_one_partition"), F.countDistinct(p).alias("partitions"))


@query("keyset_resume", "SELECT o_orderkey, part FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS part FROM orders) WHERE part > 'O' OR part IS NULL OR (part = 'O' AND o_orderkey >= 500)")
def keyset_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("part"))
    return backfill.resume(o, "part", ["o_orderkey"], ("O", [500]))


@query("bootstrap_page", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_orderkey > 10 OR (l_orderkey = 10 AND l_linenumber > 2) GROUP BY ALL ORDER BY l_orderkey, l_linenumber LIMIT 100")
def bootstrap_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return backfill.page(keys, ["l_orderkey", "l_linenumber"], [10, 2], 100)


@query("snapshot_unfinished", "SELECT DISTINCT o_custkey % 64 AS task FROM orders WHERE o_custkey % 64 % 3 <> 0")
def snapshot_unfinished(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 64).alias("task")).distinct()
    return backfill.unfinished(tasks, tasks.select("task", F.when(F.col("task") % 3 == 0, "done").otherwise("running").alias("state")))


@query("artifact_overlaps", f"WITH {CL}, a AS (SELECT xid, min(seq) - xid % 3 AS first_seq, max(seq) AS last_seq FROM cl GROUP BY xid) SELECT xid, first_seq, previous_last FROM (SELECT *, lag(last_seq) OVER (ORDER BY xid) AS previous_last FROM a) WHERE previous_last >= first_seq")
def artifact_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changelog.from_events(spark, sf_dir).groupBy("xid").agg(F.min("seq").alias("lo"), F.max("seq").alias("last_seq")).select("xid", (F.col("lo") - F.col("xid") % 3).alias("first_seq"), "last_seq")
    return sinks.overlaps(rows, "xid", 100)


@query("artifact_rows", f"WITH {CL} SELECT pos AS _pos, seq % 8 AS _seq, xid AS _batch_id, CASE WHEN op = 'update' AND NOT has_val THEN '[\"val\"]' ELSE '[]' END AS _unchanged, k, val FROM cl")
def artifact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changelog.from_events(spark, sf_dir).withColumn("lacks", F.array_compact(F.array(F.when((F.col("op") == "update") & ~F.col("has_val"), "val"))))
    return artifacts.projected_rows(rows.withColumn("ordinal", F.col("seq") % 8), ["k", "val"], F.col("lacks"))


@query("sample_predicate", "SELECT o_orderkey FROM orders WHERE ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 1000000 < 50000")
def sample_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return certify.sampled(table(spark, sf_dir, "orders"), ["o_orderkey"], 0.05).select("o_orderkey")


_CERT = f"SELECT sha256({framed('o_orderkey', 'o_custkey', 'o_orderstatus')}) AS h FROM orders"
_LANES = ", ".join(f"CAST(sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT) AS DECIMAL(38,0)) AS h{i}" for i in range(4))


@query("table_certificate", f"SELECT count(*) AS n, {_LANES} FROM ({_CERT})")
def table_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return certify.certificate(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"])


@query("certify_compare", "SELECT count(*) AS n_left, count(*) AS n_right, false AS equal FROM orders")
def certify_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    altered = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") == 7, "X").otherwise(F.col("o_orderstatus")))
    return certify.compare(o, altered, ["o_orderkey", "o_custkey", "o_orderstatus"])


@query("row_hash_counts", f"SELECT sha256({framed('c_nationkey', 'c_mktsegment')}) AS row_hash, count(*) AS n FROM customer GROUP BY 1")
def row_hash_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return certify.hash_counts(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"])


@query("append_missing_hashes", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0")
def append_missing_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", certify.row_hash([F.col("o_orderkey")]).alias("row_hash"))
    return certify.missing_hashes(rows, rows.where("o_orderkey % 3 = 0")).select("o_orderkey")


# --- queue ------------------------------------------------------------------------------------------------------------

_NOW = "TIMESTAMP '2024-01-01 00:00:00'"
_DELIVERIES = f"""dl AS (SELECT event_id, 'g' AS grp, CASE event_id % 4 WHEN 3 THEN 'acked' ELSE 'claimed' END AS status,
  CASE event_id % 4 WHEN 1 THEN {_NOW} - INTERVAL 1 HOUR ELSE {_NOW} + INTERVAL 1 HOUR END AS visible_at, CAST(1 AS BIGINT) AS attempts, 'a' AS consumer FROM events WHERE event_id % 4 <> 0)"""


def _queue(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 16 + 256).alias("pos"), "ts")
    now, m = _now(), F.col("event_id") % 4
    d = e.where(m != 0).select(
        "event_id", F.lit("g").alias("grp"), F.when(m == 3, "acked").otherwise("claimed").alias("status"),
        F.when(m == 1, now - F.expr("INTERVAL 1 HOUR")).otherwise(now + F.expr("INTERVAL 1 HOUR")).alias("visible_at"), F.lit(1).cast("long").alias("attempts"), F.lit("a").alias("consumer"),
    )
    return e, d


def _now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")


@query("queue_visible", f"WITH {_DELIVERIES} SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM dl) OR event_id IN (SELECT event_id FROM dl WHERE status IN ('available', 'claimed') AND visible_at <= {_NOW})")
def queue_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d = _queue(spark, sf_dir)
    return queue.visible(e, d, "g", _now()).select("event_id")


@query("queue_claim", f"SELECT event_id, 'g' AS grp, 'claimed' AS status, {_NOW} + INTERVAL 30 SECOND AS visible_at, CAST(event_id % 4 + 1 AS BIGINT) AS attempts, 'b' AS consumer FROM events WHERE event_id % 4 IN (0, 1) ORDER BY event_id LIMIT 100")
def queue_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d = _queue(spark, sf_dir)
    return queue.claim(e, d, "g", "b", _now(), 100, 30)


@query("queue_ack", f"WITH {_DELIVERIES} SELECT event_id, grp, CASE WHEN event_id % 10 = 1 AND status = 'claimed' THEN 'acked' ELSE status END AS status, visible_at, attempts, consumer FROM dl")
def queue_ack(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d = _queue(spark, sf_dir)
    return queue.ack(d, e.where("event_id % 10 = 1"), "g")


@query("queue_replay", f"WITH {_DELIVERIES} SELECT event_id, grp, CASE WHEN event_id * 16 + 256 >= 4096 THEN 'available' ELSE status END AS status, CASE WHEN event_id * 16 + 256 >= 4096 THEN {_NOW} ELSE visible_at END AS visible_at, attempts, consumer FROM dl")
def queue_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d = _queue(spark, sf_dir)
    return queue.replay(d, e, "g", _now(), from_pos=F.lit(4096))


# --- delivery, retention, registries ----------------------------------------------------------------------------------


@query("replay_dedupe", f"WITH {CL}, r AS (SELECT DISTINCT xid FROM cl WHERE xid % 3 <> 0) SELECT DISTINCT xid FROM cl WHERE xid NOT IN (SELECT xid FROM r)")
def replay_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = changelog.from_events(spark, sf_dir).select("xid").distinct()
    return lifecycle.unseen(b, b.where("xid % 3 <> 0"), "xid")


@query("replay_verdicts", f"WITH {CL} SELECT DISTINCT xid, CASE WHEN xid % 3 = 0 THEN 'apply' WHEN xid % 30 = 1 THEN 'conflict' ELSE 'skip' END AS verdict FROM cl")
def replay_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = changelog.from_events(spark, sf_dir).select("xid").distinct().withColumn("digest", scalars.sha(F.col("xid")))
    receipts = b.where("xid % 3 <> 0").withColumn("digest", F.when(F.col("xid") % 30 == 1, "other").otherwise(F.col("digest")))
    return lifecycle.replay_verdicts(b, receipts, "xid").select("xid", "verdict")


@query(
    "dedupe_window",
    f"""WITH RECURSIVE {CL}, o AS (SELECT k, seq, row_number() OVER (PARTITION BY k ORDER BY seq) AS n FROM cl),
w AS (SELECT k, n, seq, seq AS anchor, true AS delivered FROM o WHERE n = 1
  UNION ALL SELECT o.k, o.n, o.seq, CASE WHEN o.seq - w.anchor >= 1000 THEN o.seq ELSE w.anchor END, o.seq - w.anchor >= 1000 FROM w JOIN o ON o.k = w.k AND o.n = w.n + 1)
SELECT k, seq, delivered FROM w""",
)
def dedupe_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.dedupe_window(changelog.from_events(spark, sf_dir), "k", "seq", 1000).select("k", "seq", "delivered")


@query("outbox_pending", f"WITH {CL} SELECT seq, k % 4 AS destination, row_number() OVER (PARTITION BY k % 4 ORDER BY seq) AS place FROM cl WHERE seq % 3 <> 0")
def outbox_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = changelog.from_events(spark, sf_dir).select("seq", (F.col("k") % 4).alias("destination"))
    return lifecycle.outbox_pending(e, e.where("seq % 3 = 0"), ["seq", "destination"], "seq").select("seq", "destination", "place")


def _artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.from_events(spark, sf_dir).groupBy(F.col("xid").alias("object_id")).agg(F.min("seq").alias("created"), F.sum("val").alias("bytes"))


@query("gc_orphans", f"WITH {CL}, o AS (SELECT xid AS object_id, min(seq) AS created FROM cl GROUP BY xid) SELECT object_id, created FROM o WHERE created <= 4000 AND object_id % 2 <> 0 AND object_id % 5 <> 0 AND object_id % 7 <> 0")
def gc_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _artifacts(spark, sf_dir).select("object_id", "created")
    claims = o.where("object_id % 7 = 0").withColumn("until", F.lit(9_000))
    return lifecycle.orphans(o, claims, o.where("object_id % 2 = 0"), o.where("object_id % 5 = 0"), F.lit(5_000), 1_000)


@query("gc_retention", f"WITH {CL}, o AS (SELECT xid AS object_id, max(pos) AS pos FROM cl GROUP BY xid) SELECT object_id, pos FROM o WHERE object_id % 3 <> 0 AND object_id % 7 <> 0 AND pos <= 40000")
def gc_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = changelog.from_events(spark, sf_dir).groupBy(F.col("xid").alias("object_id")).agg(F.max("pos").alias("pos")).withColumn("publication_id", F.col("object_id"))
    checkpoint = spark.range(1).select(F.lit(40_000).alias("pos"))
    return lifecycle.retainable(p, p.select("object_id"), p.where("publication_id % 3 <> 0"), checkpoint, p.where("object_id % 7 = 0")).select("object_id", "pos")


@query("delivery_prune", f"WITH {CL} SELECT DISTINCT xid AS manifest_id FROM cl WHERE xid % 2 = 0 AND xid % 3 <> 0 ORDER BY 1 LIMIT 50")
def delivery_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = changelog.from_events(spark, sf_dir).select(F.col("xid").alias("manifest_id")).distinct()
    return lifecycle.prunable(m, m.where("manifest_id % 2 = 0"), m.where("manifest_id % 3 = 0"), 50)


@query("backlog_agg", f"WITH {CL} SELECT count(*) AS n, CAST(sum(val) AS BIGINT) AS bytes, 2000000 - min(seq) AS age, true AS blocked FROM cl")
def backlog_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.over_limit(changelog.from_events(spark, sf_dir), F.lit(2_000_000).cast("long"), "seq", "val", 10_000_000, 10**15, 1_000_000)


@query("quota_filter_sum", f"WITH {CL} SELECT k, CAST(coalesce(sum(val) FILTER (WHERE op <> 'delete'), 0) AS BIGINT) AS live_bytes, CAST(coalesce(sum(val), 0) AS BIGINT) AS all_bytes FROM cl GROUP BY k")
def quota_filter_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.quota(changelog.from_events(spark, sf_dir), "k", "val", F.col("op") != "delete")


@query("identity_conflicts", f"WITH {CL} SELECT k AS id, count(DISTINCT event_type) AS n FROM cl GROUP BY k HAVING count(DISTINCT event_type) <> 1")
def identity_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changelog.from_events(spark, sf_dir).select(F.col("k").alias("id"), "event_type", "seq")
    return lifecycle.identity_conflicts(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"), "id", ["event_type"])


@query("active_executions", f"WITH {CL} SELECT event_type, count(*) AS n FROM (SELECT event_type, seq FROM cl WHERE seq % 4 = 0 UNION ALL SELECT event_type, seq FROM cl WHERE seq % 4 = 1) WHERE seq % 5 <> 0 GROUP BY event_type")
def active_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changelog.from_events(spark, sf_dir).select("event_type", "seq")
    return lifecycle.active([rows.where("seq % 4 = 0"), rows.where("seq % 4 = 1")], rows.where("seq % 5 = 0"), "seq", "event_type")


@query("publication_sequence", f"WITH {CL}, p AS (SELECT event_type AS flow, xid, min(seq) AS published FROM cl GROUP BY ALL) SELECT flow, xid, row_number() OVER (PARTITION BY flow ORDER BY published, xid) AS sequence FROM p")
def publication_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = changelog.from_events(spark, sf_dir).groupBy(F.col("event_type").alias("flow"), "xid").agg(F.min("seq").alias("published"))
    return lifecycle.numbered(p, "flow", "published", "xid").select("flow", "xid", "sequence")


@query("consumer_latest", f"WITH {CL} SELECT DISTINCT ON (event_type) event_type AS consumer, seq, xid FROM cl ORDER BY event_type, seq DESC")
def consumer_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.latest_by(changelog.from_events(spark, sf_dir).withColumnRenamed("event_type", "consumer"), "consumer", "seq", "xid")


@query("schema_next_version", f"WITH {CL} SELECT s.event_type AS subject, CAST(coalesce(max(cl.xid) FILTER (WHERE cl.event_type <> 'signup'), 0) + 1 AS BIGINT) AS next_version FROM (SELECT DISTINCT event_type FROM cl) s JOIN cl USING (event_type) GROUP BY 1")
def schema_next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changelog.from_events(spark, sf_dir).select(F.col("event_type").alias("subject"), F.col("xid").alias("version"))
    return lifecycle.next_versions(rows.where("subject <> 'signup'"), rows)


@query("schema_latest", "SELECT o_orderpriority AS relation, max(o_orderkey) AS version, arg_max(o_orderstatus, o_orderkey) AS schema FROM (SELECT o_orderpriority, o_orderkey, max(o_orderstatus) AS o_orderstatus FROM orders GROUP BY ALL) GROUP BY 1")
def schema_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderkey").agg(F.max("o_orderstatus").alias("s"))
    return lifecycle.latest_by(versions.toDF("relation", "version", "schema"), "relation", "version", "schema")


@query("index_signature", "SELECT c_nationkey, string_agg(c_mktsegment, ',' ORDER BY c_mktsegment) AS columns, bool_or(big) AS is_unique FROM (SELECT DISTINCT c_nationkey, c_mktsegment, bool_or(c_custkey % 97 = 0) OVER (PARTITION BY c_nationkey) AS big FROM customer) GROUP BY c_nationkey")
def index_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_mktsegment").alias("column"), F.col("c_mktsegment").alias("ordinal"), (F.col("c_custkey") % 97 == 0).alias("is_unique"))
    return tables.index_signatures(c, "c_nationkey")


@query("index_columns", "SELECT c_nationkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) - 1 AS INTEGER) AS ordinal, c_mktsegment AS \"column\" FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)")
def index_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexes = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("columns"))
    return tables.index_columns(indexes, "c_nationkey", "columns")


@query("type_chain", "WITH RECURSIVE c AS (SELECT CAST(n_nationkey AS BIGINT) AS start, CAST(n_nationkey AS BIGINT) AS node FROM nation UNION SELECT c.start, c.node // 2 FROM c WHERE c.node > 0) SELECT start, node FROM c")
def type_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey").cast("long")
    return tables.type_chain(table(spark, sf_dir, "nation").select(n.alias("start"), F.when(n > 0, F.floor(n / 2)).alias("base")), "start", "base")


@query("latency_quantiles", "SELECT quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95, quantile_disc(v, 0.99) AS p99 FROM (SELECT CAST(round(value * 100) AS DOUBLE) AS v FROM events)")
def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.nearest_rank(table(spark, sf_dir, "events").select(F.round(F.col("value") * 100).alias("v")), "v", 50, 95, 99)


@query("bench_throughput", f"WITH {CL} SELECT op, count(*) AS records, CAST(sum(length(props)) AS BIGINT) AS bytes FROM cl GROUP BY op")
def bench_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return certify.throughput(changelog.from_events(spark, sf_dir), "op", F.length("props"))


@query(
    "trace_invariants",
    f"""WITH {CL}, t AS (SELECT k AS flow, seq, pos, CASE seq % 3 WHEN 0 THEN 'apply' WHEN 1 THEN 'checkpoint' ELSE 'ack' END AS event FROM cl),
w AS (SELECT *, coalesce(max(CASE WHEN event = 'apply' THEN pos END) OVER x, -1) AS applied, coalesce(max(CASE WHEN event = 'checkpoint' THEN pos END) OVER x, -1) AS saved FROM t WINDOW x AS (PARTITION BY flow ORDER BY seq)),
v AS (SELECT *, CASE WHEN event = 'ack' AND pos > saved THEN 'ack before checkpoint' WHEN event = 'checkpoint' AND pos > applied THEN 'checkpoint before apply' END AS violation FROM w)
SELECT flow, seq, event, pos, violation FROM v WHERE violation IS NOT NULL""",
)
def trace_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("seq") % 3
    t = changelog.from_events(spark, sf_dir).select(F.col("k").alias("flow"), "seq", "pos", F.when(m == 0, "apply").when(m == 1, "checkpoint").otherwise("ack").alias("event"))
    return lifecycle.trace_violations(t)


@query("schema_conform", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS o_custkey, CAST(NULL AS DATE) AS shipped FROM orders")
def schema_conform(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.types import StructType

    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("o_custkey"), "o_orderstatus")
    return evolve.conform(o, StructType.fromDDL("o_orderkey bigint, o_custkey string, shipped date"))
