"""Changelogs: rows of ordered changes, how they group into batches and transactions, and whether they are sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPS = ("insert", "update", "delete", "load", "ddl")


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a changelog: key k, order seq, position, transaction, operation, two columns and their presence."""
    e = F.col("event_id")
    op = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("update")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("k"), e.alias("seq"), (e * 16 + 256).alias("pos"), F.concat(F.lit("0/"), F.hex(e * 16 + 256)).alias("lsn"), F.expr("event_id div 8").alias("xid"),
        op.alias("op"), "event_type", F.round(F.col("value") * 100).cast("long").alias("val"), "props", "ts", (e * 7919 % 1009).alias("wm"),
        ((op == "insert") | ((op == "update") & (e % 3 != 0))).alias("has_val"), ((op == "insert") | ((op == "update") & (e % 5 != 0))).alias("has_props"),
    )


def runs(df: DataFrame, same: list[str], order: list[str], within: list[str], name: str = "run") -> DataFrame:
    """Adds the number (from 0) of the run of adjacent rows that agree in ``same``, within each group of ``within``."""
    w = Window.partitionBy(*within).orderBy(*order)
    ident = F.struct(*same)
    starts = F.coalesce((~ident.eqNullSafe(F.lag(ident).over(w))).cast("int"), F.lit(0))
    return df.withColumn("__start", F.when(F.row_number().over(w) == 1, 0).otherwise(starts)).withColumn(name, F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__start")


def stamped(df: DataFrame, txn: str = "xid", pos: str = "pos", order: str = "seq") -> DataFrame:
    """Every record takes its transaction's end position and its ordinal in it: equal on every replay."""
    w = Window.partitionBy(txn)
    return df.withColumn("commit_pos", F.max(pos).over(w)).withColumn("ordinal", (F.row_number().over(w.orderBy(order)) - 1).cast("long"))


def committed(df: DataFrame, aborted: DataFrame, subtxn: str = "subxid") -> DataFrame:
    """Without the changes of aborted sub-transactions."""
    return df.join(aborted.select(subtxn).distinct(), subtxn, "left_anti")


def sound_batches(df: DataFrame, batch: str) -> DataFrame:
    """Per batch: whether it holds one table and one schema version, and no control record beside data."""
    control = F.col("op") == "ddl"
    return df.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n"),
        (F.countDistinct("tbl", "version") <= 1).alias("one_table"),
        (~(F.bool_or(control) & F.bool_or(~control))).alias("one_kind"),
        F.bool_and(F.col("op").isin(*OPS)).alias("known_ops"),
    )


def ordinal_gaps(df: DataFrame, txn: str, ordinal: str) -> DataFrame:
    """Transactions whose ordinals are not 0..n-1."""
    return df.groupBy(txn).agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("lowest"), F.max(ordinal).alias("highest"), F.countDistinct(ordinal).alias("distinct_ordinals")).where(
        "lowest <> 0 OR highest <> n - 1 OR distinct_ordinals <> n"
    )


def regressions(df: DataFrame, flow: str, order: str, pos: str) -> DataFrame:
    """Checkpoints whose position lies before the one of their predecessor."""
    w = Window.partitionBy(flow).orderBy(order)
    return df.withColumn("previous", F.lag(pos).over(w)).where(F.col("previous") > F.col(pos))


def key_json(cols: list[str]) -> Column:
    """The key as a JSON object with sorted names, nulls kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(cols)]), {"ignoreNullFields": "false"})


def ddl_segments(df: DataFrame, txn: str, order: str, ddl: Column) -> DataFrame:
    """Adds ``segment``: how many schema changes of its transaction a row has met, itself included. Rows of one segment share a schema."""
    w = Window.partitionBy(txn).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("segment", F.sum(ddl.cast("long")).over(w))


def schema_versions(df: DataFrame, overrides: DataFrame, aborted: DataFrame, txn: str, order: str, subtxn: str = "subxid") -> DataFrame:
    """Adds ``version``: the overrides of a row's transaction up to it, without those of aborted sub-transactions."""
    kept = committed(overrides, aborted, subtxn).select(txn, order, F.lit(True).alias("__override"))
    met = df.join(kept, [txn, order], "left")
    return ddl_segments(met, txn, order, F.coalesce("__override", F.lit(False))).withColumnRenamed("segment", "version").drop("__override")


#: Columns of ``full_rows``, in order.
FULL = (
    "flow", "incarnation", "lineage", "revision", "batch_id", "content_hash", "position", "xid", "begin_lsn", "commit_lsn", "end_lsn", "fragment", "ordinal", "namespace",
    "tbl", "schema_version", "schema_fingerprint", "schema_json", "op", "tombstone", "key_json", "before_json", "after_json", "payload", "ddl_plan", "event_time", "record_hash", "version",
)


def full_rows(df: DataFrame, digests: DataFrame, names: dict[str, str], keys: list[str], columns: list[str], lsn: str = "lsn", pos: str = "pos", order: str = "seq", checkpoint_time: Column | None = None) -> DataFrame:
    """The immutable changelog rows that an append-only target keeps, one per change (columns: FULL).

    digests: xid, batch_id, content_hash. names: flow, incarnation, lineage, revision, namespace, tbl. The event time is
    the record's, else the checkpoint's, else the epoch. ``version`` is the position: the highest of an identity wins.
    """
    from changeweave.functions.scalars import sha

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema_json = F.lit("{" + ",".join(f'"{c}":"{kinds[c]}"' for c in [*keys, *columns]) + "}")
    json = lambda cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    w = Window.partitionBy("xid")
    gone = F.col("op") == "delete"
    rows = df.withColumn("begin_lsn", F.min_by(lsn, pos).over(w)).withColumn("commit_lsn", F.max_by(lsn, pos).over(w)).withColumn("ordinal", (F.row_number().over(w.orderBy(order)) - 1).cast("long"))
    made = rows.join(digests, "xid").select(
        *[F.lit(names[n]).alias(n) for n in ("flow", "incarnation", "lineage", "revision", "namespace", "tbl")], "batch_id", "content_hash", F.col("commit_lsn").alias("position"), "xid", "begin_lsn", "commit_lsn",
        F.col("commit_lsn").alias("end_lsn"), F.lit(0).cast("long").alias("fragment"), "ordinal", F.lit(1).cast("long").alias("schema_version"), F.sha2(schema_json.cast("binary"), 256).alias("schema_fingerprint"),
        schema_json.alias("schema_json"), "op", gone.alias("tombstone"), key_json(keys).alias("key_json"), F.when(gone, key_json(keys)).alias("before_json"), F.when(~gone, json([*keys, *columns])).alias("after_json"),
        F.lit("").alias("payload"), F.lit("").alias("ddl_plan"), F.coalesce(F.col("ts"), checkpoint_time if checkpoint_time is not None else F.lit(None), F.lit("1970-01-01").cast("timestamp_ntz")).alias("event_time"),
        sha(*[F.col(c) for c in (*keys, "op", *columns)]).alias("record_hash"), F.col(pos).alias("version"),
    )
    return made.select(*FULL)
