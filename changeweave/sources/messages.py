"""Rows as messages: keys, headers and payloads for logs and endpoints; the writers need their jar or a callable."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from changeweave.functions.scalars import sha
from changeweave.sources.sinks import UnsupportedTarget, message_key, transaction_id

OVERSIZE = ("error", "drop")


def log_messages(df: DataFrame, table: str, key: str, payload: list[str], most_bytes: int, oversize: str = "error") -> DataFrame:
    """key, value (JSON of the payload), headers (op, table, position, transaction), too_big. Oversized ones are kept and
    marked (error) or left out (drop)."""
    if oversize not in OVERSIZE:
        raise ValueError(oversize)
    value = F.to_json(F.struct(*payload), {"ignoreNullFields": "false"})
    headers = F.to_json(F.struct(F.col("op"), F.lit(table).alias("table"), F.col("lsn"), transaction_id(F.col("lsn"), F.col(key)).alias("txn")))
    rows = df.select(message_key(F.col(key).cast("string"), F.lit(table), F.col("lsn"), F.col("op")).alias("key"), value.alias("value"), headers.alias("headers"))
    rows = rows.withColumn("too_big", F.octet_length("value") > most_bytes)
    return rows.where("NOT too_big") if oversize == "drop" else rows


def requests(df: DataFrame, table: str, key: str, payload: list[str]) -> DataFrame:
    """One request per record: idempotency key, transaction, body."""
    ident = sha(F.lit(table), F.col("lsn"), F.col("op"), F.col(key))
    return df.select(ident.alias("idempotency_key"), transaction_id(F.col("lsn"), F.col(key)).alias("transaction"), F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}).alias("body"))


def send(df: DataFrame, make_client: Callable[[], Callable[[Row], None]]) -> None:
    """Sends every row through a client made once per partition. Deliveries may repeat: receivers use the idempotency key."""

    def run(rows: Iterator[Row]) -> None:
        call = make_client()
        for r in rows:
            call(r)

    df.foreachPartition(run)


def payload_mode(mode: str, identity: bool) -> None:
    """The raw log record can be sent on only if the mapping changes nothing."""
    if mode not in ("wire", "record_json", "wal"):
        raise ValueError(mode)
    if mode == "wal" and not identity:
        raise UnsupportedTarget("a raw record can't be projected")


def available(spark: SparkSession, source: str) -> bool:
    """Whether the session has the data source (Kafka, Avro, Iceberg and others come with a jar)."""
    try:
        spark._jvm.org.apache.spark.sql.execution.datasources.DataSource.lookupDataSource(source, spark._jsparkSession.sessionState().conf())
    except Exception:
        return False
    return True


def require(spark: SparkSession, source: str) -> None:
    if not available(spark, source):
        raise UnsupportedTarget(f"the session has no data source {source}")


