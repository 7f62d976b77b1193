"""Raw change messages into changelog rows, and the checks that rows must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def decoded(message: Column, schema: StructType) -> Column:
    """A JSON tuple as struct(values, present, unchanged): a name that the object lacks is unchanged, a JSON null is null."""
    names = F.json_object_keys(message)
    have = F.coalesce(names, F.array().cast("array<string>"))
    every = F.array(*[F.lit(f.name) for f in schema])
    return F.struct(F.from_json(message, schema).alias("values"), F.array_intersect(every, have).alias("present"), F.array_except(every, have).alias("unchanged"))


def committed_only(messages: DataFrame, txn: str = "xid", kind: str = "kind") -> DataFrame:
    """Data messages of transactions that have a commit message."""
    done = messages.where(F.col(kind) == "commit").select(txn).distinct()
    return messages.where(~F.col(kind).isin("begin", "commit")).join(done, txn, "left_semi")


def ddl_messages(messages: DataFrame, prefix: str, name: str = "prefix") -> DataFrame:
    return messages.where(F.col(name) == prefix)


def strict_violation(c: Column, kind: str) -> Column:
    """Why a text doesn't fit a strict type, or null: bigint, decimal(p,s), text, timestamp with years 1 to 9999."""
    if kind == "text":
        return F.when(F.contains(c, F.lit("\x00")), "holds a zero character")
    if kind == "timestamp":
        t = c.try_cast("timestamp_ntz")
        return F.when(c.isNotNull() & t.isNull(), "not a time").when((F.year(t) < 1) | (F.year(t) > 9999), "year out of range")
    return F.when(c.isNotNull() & c.try_cast(kind).isNull(), f"not a {kind}")


def unchanged_violations(df: DataFrame, keys: list[str], op: str = "op", unchanged: str = "unchanged", present: str = "present") -> DataFrame:
    """Rows whose unchanged list breaks its contract: updates only, no keys, nothing that is present, nothing twice."""
    u = F.col(unchanged)
    why = (
        F.when((F.size(u) > 0) & (F.col(op) != "update"), "not an update")
        .when(F.arrays_overlap(u, F.array(*[F.lit(k) for k in keys])), "names a key")
        .when(F.size(F.array_intersect(u, F.col(present))) > 0, "names a present column")
        .when(F.size(F.array_distinct(u)) < F.size(u), "names a column twice")
    )
    return df.withColumn("violation", why).where("violation IS NOT NULL")
