"""Sinks: the rows that targets receive, and how they are written so that a replay changes nothing."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from changeweave.functions.scalars import framed, partition_value, sha, time_bucket
from changeweave.operators.changelog import key_json
from changeweave.operators.fold import newest

#: What each target can do: (append, upsert, explicit keys, watermark).
CAPABILITIES = {
    "postgres": (True, True, True, True),
    "snapshot": (True, True, True, True),
    "clickhouse": (True, False, False, False),
    "snowflake": (True, False, False, False),
    "duckdb": (True, False, False, False),
    "files": (True, False, False, False),
    "kafka": (True, False, False, False),
    "http": (True, False, False, False),
    "queue": (True, False, False, False),
    "iceberg": (True, False, False, False),
}
#: Wire format -> Spark writer; those that need a jar are tried when asked for.
WIRE_FORMATS = {"parquet": "parquet", "json": "json", "orc": "orc", "csv": "csv", "avro": "avro"}


class UnsupportedTarget(ValueError):
    """The target, or the session, can't do what is asked."""


def check_policy(target: str, mode: str, keys: bool = False, watermark: bool = False) -> None:
    if target not in CAPABILITIES:
        raise UnsupportedTarget(target)
    append, upsert, explicit, guarded = CAPABILITIES[target]
    if (mode == "append" and not append) or (mode == "upsert" and not upsert) or (keys and not explicit) or (watermark and not guarded):
        raise UnsupportedTarget(f"{target} can't {mode}" + " with a watermark" * watermark)


def resolve_staging(target: DataFrame, staged: DataFrame, how: str) -> DataFrame:
    """What the target holds after staging is resolved: none keeps it, append adds, replace swaps."""
    if how == "none":
        return target
    if how == "append":
        return target.unionByName(staged)
    if how == "replace":
        return staged
    raise ValueError(how)


def metadata_rows(df: DataFrame, keys: list[str], table: str, order: str = "seq") -> DataFrame:
    """Per key its latest change: table, operation, position, whether deleted, key JSON."""
    rows = df.groupBy(*keys).agg(F.max_by(F.struct("op", "lsn"), order).alias("m"))
    return rows.select(*keys, F.lit(table).alias("tbl"), "m.op", "m.lsn", (F.col("m.op") == "delete").alias("is_deleted"), key_json(keys).alias("key_json"))


def changelog_rows(df: DataFrame, table: str, keys: list[str], columns: list[str]) -> DataFrame:
    """One immutable row per change: identity, version, transaction, ordinal, operation, tombstone, key JSON, row hash."""
    return df.select(
        sha(F.lit(table), F.col("pos"), F.col("ordinal")).alias("identity"), F.col("pos").alias("version"), "xid", "ordinal", "op", (F.col("op") == "delete").alias("tombstone"),
        key_json(keys).alias("key_json"), sha(*[F.col(c) for c in [*keys, "op", *columns]]).alias("row_hash"),
    )


def final_rows(df: DataFrame) -> DataFrame:
    return newest(df, ["identity"], "version")


def batch_digests(df: DataFrame, batch: str, order: str, columns: list[str]) -> DataFrame:
    """Per batch a digest of its rows in order; physical order and partitioning don't matter. A batch is bounded by its transaction.

    Every row has as many framed parts as there are columns, so that the rows need no frame of their own.
    """
    row = framed(*[F.col(c) for c in columns])
    rows = df.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("r")))).alias("rows"))
    return rows.select(batch, F.sha2(F.array_join(F.col("rows.r"), "").cast("binary"), 256).alias("digest"))


def logical_batch_ids(df: DataFrame, batch: str, order: str, pos: str, columns: list[str], source: str) -> DataFrame:
    """Per batch an id of its source, end position and content: equal on every replay."""
    ends = df.groupBy(batch).agg(F.max(pos).alias("end_pos"))
    ident = sha(F.lit(source), F.col("end_pos"), F.col("digest"))
    return batch_digests(df, batch, order, columns).join(ends, batch).select(batch, F.concat(F.lit("batch:"), ident).alias("batch_id"))


def message_key(key: Column, table: Column, lsn: Column, op: Column) -> Column:
    """Digest of the record's key; a record without one is keyed by table, position and operation."""
    return F.sha2(F.coalesce(F.nullif(key, F.lit("")), framed(table, lsn, op)).cast("binary"), 256)


def transaction_id(lsn: Column, key: Column) -> Column:
    return F.coalesce(F.nullif(lsn, F.lit("")), F.sha2(key.cast("string").cast("binary"), 256))


def with_previous(df: DataFrame, key: str, column: str, span: int, levels: int = 2) -> DataFrame:
    """Adds ``previous``: the column of the row before in the order of the key.

    Windows hold ranges of ``span`` keys; the last row of every range is carried to the next one that has rows. The
    carried rows are ordered the same way, and only those of the last level, one in ``span ** levels``, meet in one task.
    """
    if not levels:
        return df.withColumn("previous", F.lag(column).over(Window.orderBy(key)))
    part, carried = f"__range{levels}", f"__carried{levels}"
    rows = df.withColumn(part, F.floor(F.col(key) / span))
    lasts = rows.groupBy(part).agg(F.max_by(column, key).alias("__last"))
    before = with_previous(lasts, part, "__last", span, levels - 1).select(part, F.col("previous").alias(carried))
    w = Window.partitionBy(part).orderBy(key)
    met = rows.join(before, part).withColumn("previous", F.when(F.row_number().over(w) == 1, F.col(carried)).otherwise(F.lag(column).over(w)))
    return met.select(*df.columns, "previous")


def overlaps(df: DataFrame, key: str, span: int) -> DataFrame:
    """Artifacts whose first row lies at or before the last row of their predecessor. Windows hold ranges of ``span`` keys."""
    rows = with_previous(df, key, "last_seq", span).withColumnRenamed("previous", "previous_last")
    return rows.where("previous_last >= first_seq").select(key, "first_seq", "previous_last")


def dedupe_window(df: DataFrame, key: str, order: str, width: int) -> DataFrame:
    """Adds ``delivered``: false for a row within ``width`` of the last delivered row of its key. Skips don't extend the window.

    The anchor depends on all rows before it, which no window frame expresses: rows of a key go to one Python group.
    """
    rows = df.select(F.col(key).alias("k"), F.col(order).alias("seq"))

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("seq")
        anchor, out = None, []
        for s in g["seq"]:
            ok = anchor is None or s - anchor >= width
            anchor = s if ok else anchor
            out.append(ok)
        return g.assign(delivered=out)

    return rows.groupBy("k").applyInPandas(walk, StructType([*rows.schema, StructField("delivered", BooleanType())])).withColumnsRenamed({"k": key, "seq": order})


def partitioned(df: DataFrame, by: list[tuple[str, str | None]]) -> tuple[DataFrame, list[str]]:
    """Adds partition columns: (column, bucket) pairs; a time column has a bucket name. Returns their names."""
    names = []
    for column, bucket in by:
        name = f"p_{column}"
        df = df.withColumn(name, time_bucket(F.col(column), bucket) if bucket else partition_value(F.col(column)))
        names.append(name)
    return df, names


def write_files(df: DataFrame, path: str, wire: str = "parquet", by: list[tuple[str, str | None]] | None = None, mode: str = "overwrite", rows_per_file: int | None = None) -> None:
    """One immutable object tree; the same rows under the same path replace themselves."""
    if wire not in WIRE_FORMATS:
        raise UnsupportedTarget(wire)
    df, names = partitioned(df, by or [])
    w = df.write.mode(mode).format(WIRE_FORMATS[wire])
    if wire == "parquet":
        w = w.option("compression", "zstd")
    if rows_per_file:
        w = w.option("maxRecordsPerFile", rows_per_file)
    (w.partitionBy(*names) if names else w).save(path)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", rows_per_insert: int = 500, **options: str) -> None:
    """Rows to a database table over JDBC; the driver's jar comes with the session."""
    df.write.format("jdbc").mode(mode).options(url=url, dbtable=table, batchsize=str(rows_per_insert), **options).save()


def arrow_streams(df: DataFrame) -> DataFrame:
    """(n_rows, payload): the rows as Arrow IPC streams, one per batch."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["n_rows", "payload"])

    return df.mapInArrow(run, "n_rows long, payload binary")


class Snapshots:
    """A table as versioned folders and a pointer written last: readers see a whole version or the one before."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _p(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def version(self) -> int:
        """0 if nothing has been published."""
        fs = self._fs()
        if not fs.exists(self._p("_published")):
            return 0
        return max((int(s.getPath().getName()) for s in fs.listStatus(self._p("_published"))), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{version or self.version()}")

    def publish(self, df: DataFrame) -> int:
        """Writes the next version and then its marker. A version without marker is overwritten by the next attempt."""
        n = self.version() + 1
        self.stage(df, n)
        self._fs().mkdirs(self._p(f"_published/{n}"))
        return n

    def stage(self, df: DataFrame, version: int) -> None:
        """Writes a version without making it visible; a later attempt at it overwrites."""
        df.write.mode("overwrite").parquet(f"{self.path}/v{version}")

    def vacuum(self, keep: int = 2) -> list[int]:
        """Deletes all published versions but the last ``keep``, their folders before their markers; returns which."""
        fs, now = self._fs(), self.version()
        old = [n for n in range(1, now - keep + 1) if fs.exists(self._p(f"v{n}"))]
        for n in old:
            fs.delete(self._p(f"v{n}"), True)
            fs.delete(self._p(f"_published/{n}"), True)
        return old


def fan_out(df: DataFrame, targets: dict[str, Callable[[DataFrame], None]], attempts: int = 3) -> dict[str, Exception]:
    """Writes to all targets at once from one cached input; only those that failed are tried again. Returns what still failed."""
    df = df.persist()
    try:
        left, failed = dict(targets), {}
        for _ in range(attempts):
            with ThreadPoolExecutor(max_workers=max(1, len(left))) as pool:
                jobs = {name: pool.submit(write, df) for name, write in left.items()}
            failed = {name: e for name, j in jobs.items() if (e := j.exception())}
            left = {name: targets[name] for name in failed}
            if not left:
                break
        return failed
    finally:
        df.unpersist()


_FACTORIES: dict[str, Callable[..., object]] = {}


def register(name: str, factory: Callable[..., object]) -> None:
    """A source or target of the user's own."""
    if name in _FACTORIES:
        raise ValueError(f"{name} is registered")
    _FACTORIES[name] = factory


def make(name: str, **options: object) -> object:
    return _FACTORIES[name](**options)
