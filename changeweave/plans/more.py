"""Queries of full changelog rows, warehouse targets, delivery, traces and baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeweave.functions import scalars
from changeweave.operators import artifacts, certify, changelog, lifecycle, mapping, warehouse
from changeweave.plans.catalog import CL, COLUMNS, _fold_sql, framed, query, table
from changeweave.plans.wire import _PLAN, _planned
from changeweave.sources import sinks, wire

_DIGEST = f"r AS (SELECT xid, seq, {framed('k', 'op', 'val', 'props')} AS r FROM cl), d AS (SELECT xid, sha256(string_agg(r, '' ORDER BY seq)) AS digest FROM r GROUP BY xid)"
_SCHEMA = '{"k":"bigint","val":"bigint","props":"string"}'
_JSON = "'{\"k\":' || k || ',\"val\":' || coalesce(CAST(val AS VARCHAR), 'null') || ',\"props\":' || CASE WHEN props IS NULL THEN 'null' ELSE '\"' || replace(replace(props, '\\', '\\\\'), '\"', '\\\"') || '\"' END || '}'"


@query(
    "changelog_full_rows",
    f"""WITH {CL}, {_DIGEST} SELECT 'f' AS flow, 'i' AS incarnation, 'l' AS lineage, 'r1' AS revision, 'app' AS namespace, 'events' AS tbl, 'b' || cl.xid AS batch_id, digest AS content_hash,
  max(lsn) OVER w AS position, cl.xid AS xid, first_value(lsn) OVER o AS begin_lsn, last_value(lsn) OVER o AS commit_lsn, last_value(lsn) OVER o AS end_lsn, CAST(0 AS BIGINT) AS fragment,
  row_number() OVER (PARTITION BY cl.xid ORDER BY seq) - 1 AS ordinal, CAST(1 AS BIGINT) AS schema_version, sha256('{_SCHEMA}') AS schema_fingerprint, '{_SCHEMA}' AS schema_json, op, op = 'delete' AS tombstone,
  '{{"k":' || k || '}}' AS key_json, CASE WHEN op = 'delete' THEN '{{"k":' || k || '}}' END AS before_json, CASE WHEN op <> 'delete' THEN {_JSON} END AS after_json, '' AS payload, '' AS ddl_plan,
  coalesce(ts, TIMESTAMP '1970-01-01') AS event_time, sha256({framed('k', 'op', 'val', 'props')}) AS record_hash, pos AS version
FROM cl JOIN d ON d.xid = cl.xid WINDOW w AS (PARTITION BY cl.xid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), o AS (PARTITION BY cl.xid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""".replace("max(lsn) OVER w AS position", "last_value(lsn) OVER w AS position"),
)
def changelog_full_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changelog.from_events(spark, sf_dir)
    digests = sinks.batch_digests(rows, "xid", "seq", ["k", "op", "val", "props"]).select("xid", F.concat(F.lit("b"), F.col("xid").cast("string")).alias("batch_id"), F.col("digest").alias("content_hash"))
    names = {"flow": "f", "incarnation": "i", "lineage": "l", "revision": "r1", "namespace": "app", "tbl": "events"}
    return changelog.full_rows(rows, digests, names, ["k"], ["val", "props"])


@query(
    "warehouse_operations",
    f"WITH {CL}, {_fold_sql('cl')}, f AS (SELECT k, arg_min(op, seq) AS first_op, max(seq) AS last_order, max(CASE WHEN op = 'delete' THEN seq END) AS gone FROM cl GROUP BY k), "
    "h AS (SELECT f.k, bool_or(has_val AND (gone IS NULL OR seq > gone) AND op <> 'delete') AS hv, bool_or(has_props AND (gone IS NULL OR seq > gone) AND op <> 'delete') AS hp FROM cl JOIN f USING (k) GROUP BY f.k) "
    "SELECT f.k, CASE WHEN gone = f.last_order THEN 'delete' WHEN gone IS NOT NULL OR first_op = 'insert' THEN 'insert' ELSE 'update' END AS op, "
    "concat_ws(',', CASE WHEN hv AND gone IS DISTINCT FROM f.last_order THEN 'val' END, CASE WHEN hp AND gone IS DISTINCT FROM f.last_order THEN 'props' END) AS sets, state.val, state.props, f.last_order "
    "FROM f JOIN h ON f.k = h.k LEFT JOIN state ON f.k = state.k",
)
def warehouse_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse.operations(changelog.from_events(spark, sf_dir), ["k"], COLUMNS)


@query("warehouse_moved_keys", f"WITH {CL} SELECT seq FROM cl WHERE op = 'update' AND seq % 97 = 0")
def warehouse_moved_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changelog.from_events(spark, sf_dir).withColumn("new_k", F.when(F.col("seq") % 97 == 0, F.col("k") + 1_000_000).otherwise(F.col("k")))
    return warehouse.moved_keys(rows, "k", "new_k").select("seq")


@query("warehouse_misfits", "SELECT event_id, 'amount' AS \"column\", 'not a bigint' AS reason FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 'at', 'not a time' FROM events WHERE event_id % 5 = 0")
def warehouse_misfits(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(i % 3 == 0, "x").otherwise(i.cast("string")).alias("amount"), F.when(i % 5 == 0, "never").otherwise("2024-01-01 00:00:00").alias("at"))
    return warehouse.misfits(rows, {"amount": "bigint", "at": "timestamp"}).select("event_id", "column", "reason")


_LINE = "'{\"k\":' || k || ',\"op\":\"' || op || '\"}'"


@query("staged_objects", f"WITH {CL}, b AS (SELECT xid, count(*) AS n_rows, string_agg({_LINE}, chr(10) ORDER BY seq) AS body FROM cl GROUP BY xid) SELECT xid, 'stage/' || xid || '-' || substr(sha256(body), 1, 16) || '.json' AS object_key, n_rows, body FROM b")
def staged_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse.staged_objects(changelog.from_events(spark, sf_dir), "stage", "xid", "seq", ["k", "op"])


@query("object_writes", f"WITH {CL} SELECT DISTINCT xid, CASE WHEN xid % 3 = 0 THEN 'create' WHEN xid % 30 = 1 THEN 'conflict' ELSE 'skip' END AS action FROM cl")
def object_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = changelog.from_events(spark, sf_dir).select("xid").distinct().withColumn("object_key", scalars.path_token(F.col("xid").cast("string"))).withColumn("digest", scalars.sha(F.col("xid")))
    stored = o.where("xid % 3 <> 0").withColumn("digest", F.when(F.col("xid") % 30 == 1, "other").otherwise(F.col("digest")))
    return warehouse.object_writes(o, stored).select("xid", "action")


@query("column_sets", f"WITH {CL} SELECT concat_ws(',', CASE WHEN has_props THEN 'props' END, CASE WHEN has_val THEN 'val' END) AS columns, count(*) AS n FROM cl GROUP BY 1")
def column_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = F.array_compact(F.array(F.when(F.col("has_val"), "val"), F.when(F.col("has_props"), "props")))
    return warehouse.column_sets(present, changelog.from_events(spark, sf_dir))


@query("key_compare", "SELECT o_orderkey, o_orderkey % 7 <> 0 AS same FROM orders")
def key_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    other = F.when(k % 7 == 0, F.concat(F.lit("x"), k.cast("string"))).when(k % 2 == 0, F.concat(k.cast("string"), F.lit(".0"))).otherwise(F.concat(F.lit("0"), k.cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", warehouse.same_key(k, other).alias("same"))


@query("mapped_artifacts", f"{_PLAN} SELECT xid, artifact, min(ordinal) AS first_ordinal, count(*) AS n_rows, sha256({framed(repr('ab' * 32), 'xid', 'artifact')}) AS artifact_id FROM p GROUP BY xid, artifact")
def mapped_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse.mapped_plan(_planned(spark, sf_dir), "ab" * 32)


@query(
    "schema_baseline",
    f"WITH v AS (SELECT o_orderpriority AS name, o_orderkey AS version, max(o_orderstatus) AS definition FROM orders GROUP BY ALL), l AS (SELECT 'app' AS namespace, name, arg_max(definition, version) AS definition FROM v GROUP BY name), "
    f"b AS (SELECT count(*) AS n, string_agg({framed('namespace', 'name', 'definition')}, '' ORDER BY name) AS body FROM l) SELECT 'lineage' AS lineage, n, sha256({framed(repr('lineage'), 'body')}) AS fingerprint FROM b",
)
def schema_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderkey").agg(F.max("o_orderstatus").alias("definition"))
    return warehouse.baseline(v.select(F.lit("app").alias("namespace"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("version"), "definition"), "lineage")


@query("artifact_verified", f"WITH {CL} SELECT DISTINCT xid, CASE WHEN xid % 11 = 0 THEN 'missing' WHEN xid % 7 = 0 THEN 'rows' WHEN xid % 5 = 0 THEN 'content' ELSE 'ok' END AS state FROM cl")
def artifact_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changelog.from_events(spark, sf_dir)
    held = rows.groupBy("xid").agg(F.count(F.lit(1)).alias("n_rows")).join(sinks.batch_digests(rows, "xid", "seq", ["k", "val"]), "xid")
    promised = held.withColumn("n_rows", F.when(F.col("xid") % 7 == 0, F.col("n_rows") + 1).otherwise(F.col("n_rows"))).withColumn("digest", F.when(F.col("xid") % 5 == 0, "other").otherwise(F.col("digest")))
    return artifacts.verified(rows.where("xid % 11 <> 0"), promised, "xid", "seq", ["k", "val"])


@query("batch_size_estimate", f"WITH {CL} SELECT xid, count(*) AS n_rows, CAST(sum(coalesce(strlen(CAST(k AS VARCHAR)), 4) + 2 + coalesce(strlen(op), 4) + 2 + coalesce(strlen(props), 4) + 2) AS BIGINT) AS bytes FROM cl GROUP BY xid")
def batch_size_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts.batch_sizes(changelog.from_events(spark, sf_dir), "xid", ["k", "op", "props"])


@query("certificate_first_rows", f"SELECT o_orderkey, sha256({framed('o_orderkey', 'o_custkey', 'o_orderstatus')}) AS row_hash FROM orders WHERE ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 1000000 < 500000 ORDER BY o_orderkey LIMIT 200")
def certificate_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return certify.first_rows(table(spark, sf_dir, "orders"), ["o_orderkey"], ["o_orderkey", "o_custkey", "o_orderstatus"], 200, 0.5)


_TRACE = f"""WITH {CL}, t AS (SELECT k AS flow, seq, pos, CASE seq % 3 WHEN 0 THEN 'apply' WHEN 1 THEN 'checkpoint' ELSE 'ack' END AS event FROM cl),
w AS (SELECT *, coalesce(max(CASE WHEN event = 'apply' THEN pos END) OVER x, -1) AS applied, coalesce(max(CASE WHEN event = 'checkpoint' THEN pos END) OVER x, -1) AS saved FROM t WINDOW x AS (PARTITION BY flow ORDER BY seq)),
v AS (SELECT CASE WHEN event = 'ack' AND pos > saved THEN 'ack before checkpoint' WHEN event = 'checkpoint' AND pos > applied THEN 'checkpoint before apply' END AS violation FROM w)"""


@query("trace_coverage", f"{_TRACE} SELECT 'action' AS kind, event AS name, count(*) AS n FROM t GROUP BY event UNION ALL SELECT 'action', 'restart', 0 UNION ALL SELECT 'violation', violation, count(*) FROM v WHERE violation IS NOT NULL GROUP BY violation")
def trace_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("seq") % 3
    t = changelog.from_events(spark, sf_dir).select(F.col("k").alias("flow"), "seq", "pos", F.when(m == 0, "apply").when(m == 1, "checkpoint").otherwise("ack").alias("event"))
    return lifecycle.trace_coverage(t, ["apply", "checkpoint", "ack", "restart"], lifecycle.trace_violations(t))


@query("gc_next", f"WITH {CL}, o AS (SELECT xid AS object_id, min(seq) AS created FROM cl GROUP BY xid) SELECT object_id, created FROM o ORDER BY object_id % 5 = 4 DESC, created, object_id LIMIT 1")
def gc_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = changelog.from_events(spark, sf_dir).groupBy(F.col("xid").alias("object_id")).agg(F.min("seq").alias("created"))
    return lifecycle.next_candidate(o, F.col("object_id") % 5 == 4, "created", "object_id")


@query("outbox_drained", f"WITH {CL}, e AS (SELECT seq, k % 4 AS destination FROM cl WHERE seq % 3 <> 0), s AS (SELECT destination, min(seq) AS stop FROM e WHERE seq > 400 AND seq % 50 = 7 GROUP BY 1) SELECT e.seq, e.destination FROM e LEFT JOIN s USING (destination) WHERE stop IS NULL OR e.seq < stop")
def outbox_drained(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = changelog.from_events(spark, sf_dir).select("seq", (F.col("k") % 4).alias("destination"))
    return lifecycle.drained(e, e.where("seq % 3 = 0"), e.where("seq > 400 AND seq % 50 = 7"), ["seq", "destination"], "seq")


@query("delivery_next", f"WITH {CL} SELECT DISTINCT xid AS batch_id, CASE WHEN xid % 9 = 4 THEN 'conflict' WHEN xid % 4 = 3 THEN 'done' WHEN xid % 4 = 2 THEN 'record' WHEN xid % 4 = 1 THEN 'reconcile' ELSE 'start' END AS \"next\" FROM cl WHERE xid % 9 <> 4 OR xid % 4 = 3 UNION SELECT DISTINCT xid, CASE xid % 4 WHEN 0 THEN 'start' WHEN 1 THEN 'reconcile' ELSE 'record' END FROM cl WHERE xid % 9 = 4 AND xid % 4 <> 3")
def delivery_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = changelog.from_events(spark, sf_dir).select(F.col("xid").alias("batch_id")).distinct()
    steps = F.slice(F.array(*map(F.lit, lifecycle.STEPS)), F.lit(1), (F.col("batch_id") % 4 + 1).cast("int"))
    log = b.withColumn("step", F.explode(steps)).withColumn("digest", F.when((F.col("step") == "receipt") & (F.col("batch_id") % 9 == 4), "other").otherwise("d"))
    return lifecycle.delivery_state(log)


@query("ddl_vacuous", f"WITH {CL} SELECT DISTINCT xid AS change, event_type AS tbl FROM cl WHERE event_type NOT IN ('signup', 'error')")
def ddl_vacuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = changelog.from_events(spark, sf_dir).select(F.col("xid").alias("change"), F.col("event_type").alias("tbl")).distinct()
    return lifecycle.vacuous(changes, changes.where("tbl IN ('signup', 'error')"))


@query("wire_batch_json", f"WITH {CL} SELECT xid, '{{\"records\":[' || string_agg('{{\"k\":' || k || ',\"op\":\"' || op || '\"}}', ',' ORDER BY seq) || ']}}' AS body FROM cl GROUP BY xid")
def wire_batch_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.batch_json(changelog.from_events(spark, sf_dir), "xid", "seq", ["k", "op"])


def _sized(n: str) -> str:
    return f"CASE WHEN {n} < 128 THEN 1 ELSE 2 END + {n}"


@query(
    "wire_proto_batches",
    f"WITH {CL}, r AS (SELECT xid, 8 + length(op) + 2 + {_sized('strlen(CAST(k AS VARCHAR))')} + 1 + CASE WHEN op = 'delete' THEN 0 ELSE {_sized('strlen(props)')} + 1 END + 2 AS n FROM cl) SELECT xid AS batch, count(*) AS n_records, CAST(sum({_sized('n')} + 1) AS BIGINT) AS bytes FROM r GROUP BY xid",
)
def wire_proto_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changelog.from_events(spark, sf_dir).select(
        "xid", "seq", F.lit("events").alias("table"), "op", F.col("k").cast("string").alias("key"), F.lit("").alias("before_json"), F.when(F.col("op") != "delete", F.col("props")).alias("after_json"),
        F.lit(0).cast("long").alias("ts_millis"), F.lit(1).cast("long").alias("schema_version"),
    )
    return wire.proto_batches(rows, "xid", "seq").select("batch", "n_records", F.octet_length("payload").cast("long").alias("bytes"))


@query("wire_avro_values", "SELECT o_orderkey, CAST(epoch_ms(o_orderdate) AS BIGINT) AS o_orderdate, o_orderstatus FROM orders")
def wire_avro_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wire.avro_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus"), ["o_orderkey", "o_orderdate", "o_orderstatus"])


@query("normalize_inet", "SELECT event_id, CASE WHEN event_id % 300 <= 255 THEN '10.0.' || event_id % 300 || '.7/24' END AS inet FROM events")
def normalize_inet(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit(" 10.00."), (F.col("event_id") % 300).cast("string"), F.lit(".7/24"))
    return table(spark, sf_dir, "events").select("event_id", scalars.as_inet(text).alias("inet"))


@query("normalize_json", "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN '{\"a\":' || event_id || ',\"b\":[1,null]}' END AS doc FROM events")
def normalize_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('{ "b" : [1, null], "a" : '), F.col("event_id").cast("string"), F.when(F.col("event_id") % 4 == 0, "").otherwise("}"))
    return table(spark, sf_dir, "events").select("event_id", scalars.as_json(text).alias("doc"))


@query("path_escape", "SELECT c_custkey, 'a%2Fb%20' || replace(c_name, '#', '%23') AS part FROM customer")
def path_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.path_escape(F.concat(F.lit("a/b "), "c_name")).alias("part"))
