"""More registered queries: decoding, checks, artifacts and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from changeweave.functions import scalars
from changeweave.operators import artifacts, changelog, decode, fold, guard, lifecycle, queue
from changeweave.plans.catalog import CL, framed, query, table
from changeweave.sources import messages, sinks, tables


@query("decode_tuples", f"WITH {CL} SELECT seq, CASE WHEN has_val THEN val END AS val, CASE WHEN has_val THEN 'val' ELSE '' END || CASE WHEN has_props THEN (CASE WHEN has_val THEN ',props' ELSE 'props' END) ELSE '' END AS present FROM cl")
def decode_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changelog.from_events(spark, sf_dir)
    text = F.concat(F.lit("{"), F.concat_ws(",", F.when(F.col("has_val"), F.concat(F.lit('"val":'), F.coalesce(F.col("val").cast("string"), F.lit("null")))), F.when(F.col("has_props"), F.lit('"props":"x"'))), F.lit("}"))
    d = decode.decoded(text, StructType.fromDDL("val bigint, props string"))
    return rows.select("seq", d.alias("d")).select("seq", F.col("d.values.val").alias("val"), F.array_join("d.present", ",").alias("present"))


@query("decode_committed", f"WITH {CL} SELECT seq, xid FROM cl WHERE xid % 5 <> 0 AND seq % 8 NOT IN (0, 7)")
def decode_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("seq") % 8
    rows = changelog.from_events(spark, sf_dir).select("seq", "xid", F.when(m == 0, "begin").when((m == 7) & (F.col("xid") % 5 != 0), "commit").when(m == 7, "begin").otherwise("change").alias("kind"))
    # the last transaction may lack its closing message; it is complete in these tables
    return decode.committed_only(rows).select("seq", "xid")


@query("ddl_prefix_filter", f"WITH {CL} SELECT seq FROM cl WHERE event_type = 'signup'")
def ddl_prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.ddl_messages(changelog.from_events(spark, sf_dir).select("seq", F.col("event_type").alias("prefix")), "signup").select("seq")


@query("strict_types", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'not a bigint' END AS bad_int, CASE WHEN event_id % 1000 >= 100 THEN 'not a decimal(4,2)' END AS bad_decimal FROM events")
def strict_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    text = F.when(i % 3 == 0, F.concat(i.cast("string"), F.lit("x"))).otherwise(i.cast("string"))
    return table(spark, sf_dir, "events").select("event_id", decode.strict_violation(text, "bigint").alias("bad_int"), decode.strict_violation((i % 1000).cast("string"), "decimal(4,2)").alias("bad_decimal"))


@query("unchanged_contract", f"WITH {CL} SELECT seq, CASE WHEN op <> 'update' THEN 'not an update' WHEN seq % 11 = 0 THEN 'names a key' END AS violation FROM cl WHERE NOT has_val AND (op <> 'update' OR seq % 11 = 0)")
def unchanged_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changelog.from_events(spark, sf_dir)
    lacks = F.array_compact(F.array(F.when(~F.col("has_val"), F.when(F.col("seq") % 11 == 0, "k").otherwise("val"))))
    rows = rows.select("seq", "op", lacks.alias("unchanged"), F.array_compact(F.array(F.when(F.col("has_val"), "val"))).alias("present"))
    return decode.unchanged_violations(rows, ["k"]).select("seq", "violation")


_PLAN = f"""WITH {CL}, r AS (SELECT xid, seq, event_type AS tbl, CASE WHEN seq % 50 = 3 THEN 'ddl' ELSE op END AS op FROM cl),
a AS (SELECT *, row_number() OVER w - 1 AS ordinal, CASE WHEN row_number() OVER w = 1 THEN 0 WHEN op = 'ddl' OR lag(op) OVER w = 'ddl' OR lag(tbl) OVER w <> tbl THEN 1 ELSE 0 END AS opens FROM r WINDOW w AS (PARTITION BY xid ORDER BY seq)),
p AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY xid ORDER BY seq) AS BIGINT) AS artifact FROM a)"""


_ARTIFACT = framed("'events'", "xid", "artifact")


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changelog.from_events(spark, sf_dir).select("xid", "seq", F.col("event_type").alias("tbl"), F.lit(1).alias("version"), F.when(F.col("seq") % 50 == 3, "ddl").otherwise(F.col("op")).alias("op"))
    return artifacts.plan(rows)


@query("artifact_plan", f"{_PLAN} SELECT xid, seq, ordinal, artifact FROM p")
def artifact_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir).select("xid", "seq", "ordinal", "artifact")


@query("artifact_manifest", f"{_PLAN} SELECT xid, artifact, min(ordinal) AS first_ordinal, count(*) AS n_rows, sha256({_ARTIFACT}) AS artifact_id, 'events/v1-' || rtrim(to_base64(encode(CAST(xid AS VARCHAR))), '=') || '/' || substr(sha256({_ARTIFACT}), 1, 16) AS object_key FROM p GROUP BY xid, artifact")
def artifact_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts.manifest(_planned(spark, sf_dir), "events")


@query("artifact_misplaced", f"{_PLAN}, b AS (SELECT *, CASE WHEN seq % 97 = 5 THEN ordinal + 100 ELSE ordinal END AS moved, min(ordinal) OVER (PARTITION BY xid, artifact) AS first_ordinal FROM p), o AS (SELECT *, row_number() OVER (PARTITION BY xid, artifact ORDER BY moved) - 1 AS off FROM b) SELECT xid, seq FROM o WHERE moved <> first_ordinal + off")
def artifact_misplaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _planned(spark, sf_dir)
    moved = p.withColumn("ordinal", F.when(F.col("seq") % 97 == 5, F.col("ordinal") + 100).otherwise(F.col("ordinal")))
    return artifacts.misplaced(moved, artifacts.manifest(p, "events"), ["xid", "artifact"]).select("xid", "seq")


@query(
    "insert_chunks",
    f"""WITH RECURSIVE {CL}, o AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY seq) AS i, length(props) AS b FROM cl),
w AS (SELECT k, i, CAST(0 AS BIGINT) AS chunk, CAST(1 AS BIGINT) AS n, b AS held FROM o WHERE i = 1
  UNION ALL SELECT o.k, o.i, CASE WHEN n = 5 OR held + b > 40 THEN chunk + 1 ELSE chunk END, CASE WHEN n = 5 OR held + b > 40 THEN 1 ELSE n + 1 END, CASE WHEN n = 5 OR held + b > 40 THEN b ELSE held + b END FROM w JOIN o ON o.k = w.k AND o.i = w.i + 1)
SELECT k, chunk, count(*) AS n FROM w GROUP BY ALL""",
)
def insert_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = artifacts.chunks(changelog.from_events(spark, sf_dir), ["k"], "seq", F.length("props"), 5, 40)
    return rows.groupBy("k", "chunk").agg(F.count(F.lit(1)).alias("n"))


@query(
    "size_bisect",
    f"""WITH RECURSIVE {CL}, o AS (SELECT xid, row_number() OVER (PARTITION BY xid ORDER BY seq) AS i, length(props) AS b FROM cl),
s AS (SELECT xid, i, sum(b) OVER (PARTITION BY xid ORDER BY i) AS held FROM o UNION ALL SELECT DISTINCT xid, 0, 0 FROM o),
p AS (SELECT xid, CAST(0 AS BIGINT) AS lo, max(i) AS hi, CAST(0 AS BIGINT) AS n FROM o GROUP BY xid
  UNION ALL SELECT p.xid, CASE side WHEN 0 THEN lo ELSE (lo + hi) // 2 END, CASE side WHEN 0 THEN (lo + hi) // 2 ELSE hi END, n + 1
  FROM p JOIN s a ON a.xid = p.xid AND a.i = lo JOIN s b ON b.xid = p.xid AND b.i = hi, (VALUES (0), (1)) v(side) WHERE b.held - a.held > 10 AND hi - lo > 1)
SELECT xid, max(n) AS halvings FROM p GROUP BY xid""",
)
def size_bisect(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = artifacts.bisected(changelog.from_events(spark, sf_dir), "xid", "seq", F.length("props"), 10)
    return pieces.groupBy("xid").agg(F.max("halvings").alias("halvings"))


@query("snapshot_ancestry", "WITH RECURSIVE s AS (SELECT n_nationkey AS id, (n_nationkey - 1) // 2 AS parent FROM nation), a AS (SELECT id, parent FROM s WHERE id = 20 UNION ALL SELECT s.id, s.parent FROM a JOIN s ON s.id = a.parent AND a.id > 0) SELECT CAST(id AS BIGINT) AS id FROM a")
def snapshot_ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("n_nationkey").cast("long")
    s = table(spark, sf_dir, "nation").select(i.alias("id"), F.when(i > 0, F.floor((i - 1) / 2).cast("long")).alias("parent"))
    return artifacts.ancestry(s, 20)


@query("summary_match", f"WITH {CL} SELECT DISTINCT xid AS batch_id, CASE WHEN xid % 3 = 0 THEN 'absent' WHEN xid % 30 = 1 THEN 'conflict' ELSE 'committed' END AS outcome FROM cl")
def summary_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = changelog.from_events(spark, sf_dir).select(F.col("xid").alias("batch_id")).distinct().withColumn("digest", scalars.sha(F.col("batch_id")))
    snapshots = expected.where("batch_id % 3 <> 0").withColumn("digest", F.when(F.col("batch_id") % 30 == 1, "other").otherwise(F.col("digest")))
    return artifacts.summary_match(snapshots, expected)


@query("log_messages", f"WITH {CL} SELECT sha256(CAST(k AS VARCHAR)) AS key, '{{\"k\":' || k || ',\"val\":' || coalesce(CAST(val AS VARCHAR), 'null') || '}}' AS value, '{{\"op\":\"' || op || '\",\"table\":\"events\",\"lsn\":\"' || lsn || '\",\"txn\":\"' || lsn || '\"}}' AS headers, false AS too_big FROM cl")
def log_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.log_messages(changelog.from_events(spark, sf_dir), "events", "k", ["k", "val"], 1_000_000)


@query("http_requests", f"WITH {CL} SELECT sha256({framed("'events'", "lsn", "op", "k")}) AS idempotency_key, lsn AS transaction, '{{\"k\":' || k || ',\"val\":' || coalesce(CAST(val AS VARCHAR), 'null') || '}}' AS body FROM cl")
def http_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.requests(changelog.from_events(spark, sf_dir), "events", "k", ["k", "val"])


@query("published_columns", "SELECT c_custkey, c_mktsegment FROM customer")
def published_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.published(table(spark, sf_dir, "customer"), ["c_custkey", "c_mktsegment", "unknown"])


@query("object_partitions", "SELECT strftime(ts, '%Y-%m') AS p_ts, event_type AS p_event_type, count(*) AS n FROM events GROUP BY ALL")
def object_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = sinks.partitioned(table(spark, sf_dir, "events"), [("ts", "month"), ("event_type", None)])
    return rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


@query("queue_append", f"WITH {CL} SELECT seq AS id, 'changes' AS stream, lsn, '{{\"k\":' || k || ',\"op\":\"' || op || '\"}}' AS payload FROM cl")
def queue_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.from_events(spark, sf_dir).select(F.col("seq").alias("id"), "k", "op", "lsn").transform(queue.entries, "changes", ["k", "op"])


@query("vector_rows", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, CAST(embedding[1] AS FLOAT) AS first_value FROM embeddings")
def vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = scalars.as_vector(F.concat(F.lit("["), F.array_join("embedding", ","), F.lit("]")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(v).alias("n"), F.element_at(v, 1).alias("first_value"))


@query("cdc_toast_lookup", f"WITH {CL}, t AS (SELECT c_custkey AS k, CAST(round(c_acctbal * 100) AS BIGINT) AS val FROM customer) SELECT cl.seq, cl.k, CASE WHEN has_val THEN cl.val ELSE t.val END AS val FROM cl LEFT JOIN t ON cl.k = t.k")
def cdc_toast_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.round(F.col("c_acctbal") * 100).cast("long").alias("val"))
    return fold.looked_up(changelog.from_events(spark, sf_dir), source, ["k"], {"val": "has_val"}).select("seq", "k", "val")


@query("cdc_guard_unfit", f"WITH {CL} SELECT seq, CASE WHEN seq % 13 = 0 THEN 'no key' WHEN NOT has_val THEN 'no guard value' END AS reason FROM cl WHERE seq % 13 = 0 OR NOT has_val")
def cdc_guard_unfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changelog.from_events(spark, sf_dir).select("seq", "pos", F.when(F.col("seq") % 13 != 0, F.col("k")).alias("k"), F.when(F.col("has_val"), F.col("wm")).alias("wm"))
    return guard.unfit(rows, ["k"], "wm", "pos").select("seq", "reason")


_STATES = "CASE event_id % 7 WHEN 1 THEN 'approved' WHEN 2 THEN 'rejected' WHEN 3 THEN 'applied' ELSE 'pending' END"


@query("ddl_registry", f"SELECT user_id % 40 AS change, coalesce(arg_max(s, event_id) FILTER (WHERE s <> 'pending'), 'pending') AS state, min(event_id) AS first_seen FROM (SELECT user_id, event_id, {_STATES} AS s FROM events) GROUP BY 1")
def ddl_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("event_id") % 7
    e = table(spark, sf_dir, "events")
    return lifecycle.registry_state(e.select((F.col("user_id") % 40).alias("change"), F.col("event_id").alias("seq"), F.when(m == 1, "approved").when(m == 2, "rejected").when(m == 3, "applied").otherwise("pending").alias("state")))


@query("lru_evicted", "SELECT user_id, last_use FROM (SELECT user_id, max(event_id) AS last_use, row_number() OVER (ORDER BY max(event_id) DESC, user_id) AS n FROM events GROUP BY user_id) WHERE n > 10")
def lru_evicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.least_recently_used(table(spark, sf_dir, "events"), "user_id", "event_id", 10)


@query("metadata_overrides", f"WITH {CL}, m AS (SELECT xid, seq, CASE WHEN seq % 8 IN (2, 5) AND (xid * 10 + seq % 3) % 7 <> 0 THEN 1 ELSE 0 END AS o FROM cl) SELECT seq, CAST(sum(o) OVER (PARTITION BY xid ORDER BY seq) AS BIGINT) AS version FROM m")
def metadata_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema version inside a transaction: overrides count from their record on, those of aborted sub-transactions don't."""
    rows = changelog.from_events(spark, sf_dir).select("xid", "seq", (F.col("xid") * 10 + F.col("seq") % 3).alias("subxid"))
    overrides = rows.where("seq % 8 IN (2, 5)")
    return changelog.schema_versions(rows, overrides, overrides.where("subxid % 7 = 0"), "xid", "seq").select("seq", "version")
