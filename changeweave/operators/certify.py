"""Table certificates: counts and content hashes that two tables must share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeweave.functions.scalars import sha


#: 32-bit parts of a row hash that a certificate sums.
LANES = 4
SLICES = 4096


def sampled(df: DataFrame, keys: list[str], rate: float) -> DataFrame:
    """Rows whose key digest lies below the rate: the same rows in every table and on every run."""
    head = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).cast("binary")), 1, 8), 16, 10).cast("long")
    return df.where(head % 1_000_000 < int(rate * 1_000_000))


def row_hash(cols: list[Column]) -> Column:
    return sha(*cols)


def certificate(df: DataFrame, cols: list[str]) -> DataFrame:
    """Row count and sums of the row hashes' first four 32-bit parts: order doesn't matter, repeated rows count, and sums combine
    map-side. They are taken as 64-bit numbers in ``SLICES`` slices first (good for 2 ** 43 rows), then as decimals of 38 digits."""
    part = lambda i: F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("long")
    rows = df.select(row_hash([F.col(c) for c in cols]).alias("h"))
    slices = rows.groupBy(F.pmod(F.xxhash64("h"), F.lit(SLICES)).alias("slice")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(part(i)).alias(f"h{i}") for i in range(LANES)])
    total = lambda i: F.coalesce(F.sum(F.col(f"h{i}").cast("decimal(28,0)")), F.lit(0)).cast("decimal(38,0)").alias(f"h{i}")
    return slices.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"), *[total(i) for i in range(LANES)])


def compare(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    x, y = certificate(a, cols), certificate(b, cols)
    left, right = x.toDF(*[f"a_{c}" for c in x.columns]), y.toDF(*[f"b_{c}" for c in y.columns])
    equal = F.col("a_n") == F.col("b_n")
    for i in range(LANES):
        equal = equal & (F.col(f"a_h{i}") == F.col(f"b_h{i}"))
    return left.join(right, F.lit(True)).select(F.col("a_n").alias("n_left"), F.col("b_n").alias("n_right"), equal.alias("equal"))  # one row each


def first_rows(df: DataFrame, keys: list[str], cols: list[str], limit: int, rate: float = 1.0) -> DataFrame:
    """The hashes of the first rows in the order of the keys (of all columns without any), of a sample by key if rate is below 1."""
    rows = sampled(df, keys or cols, rate) if rate < 1 else df
    order = keys or cols
    return rows.orderBy(*order).limit(limit).select(*order, row_hash([F.col(c) for c in cols]).alias("row_hash"))


def hash_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """How often each row content occurs, by its hash."""
    return df.groupBy(row_hash([F.col(c) for c in cols]).alias("row_hash")).agg(F.count(F.lit(1)).alias("n"))


def throughput(df: DataFrame, by: str, size: Column, seconds: float | None = None) -> DataFrame:
    """Records and bytes per group, and per second if the run's seconds are given."""
    out = df.groupBy(by).agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
    return out if seconds is None else out.withColumn("records_per_second", F.col("records") / seconds).withColumn("mb_per_second", F.col("bytes") / 1e6 / seconds)


def missing_hashes(rows: DataFrame, landed: DataFrame, digest: str = "row_hash") -> DataFrame:
    """Rows whose hash has not landed yet."""
    return rows.join(landed.select(digest).distinct(), digest, "left_anti")
