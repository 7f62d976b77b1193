"""Version-guarded upserts: a change is accepted only if its (guard, position) is above all that came before for its key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def decisions(df: DataFrame, keys: list[str], guard: str, pos: str, arrival: str, digest: str, span: int | None = None) -> DataFrame:
    """Adds ``decision``: accept, stale, replay (equal guard, position and content) or conflict (equal, other content).

    Rows of one key meet in one task. With ``span``, windows hold that many numbers of the arrival, and the highest version of
    each range is carried on, so that a hot key is split.
    """
    version = F.struct(F.col(guard).alias("g"), F.col(pos).alias("p"))
    rows = df.withColumn("__v", version).withColumn("__own", F.struct(F.col("__v").alias("v"), (-F.col(arrival)).alias("first"), F.col(digest).alias("d")))
    within = keys
    if span:
        within, rows = [*keys, "__range"], rows.withColumn("__range", F.floor(F.col(arrival) / span))
        past = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        carried = rows.groupBy(*within).agg(F.max("__own").alias("__end")).select(*within, F.max("__end").over(past).alias("__carried"))
        rows = rows.join(carried, within)
    before = Window.partitionBy(*within).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    top = F.max("__own").over(before)
    rows = rows.withColumn("__top", F.greatest(top, F.col("__carried")) if span else top)
    decision = (
        F.when(F.col("__top").isNull() | (F.col("__v") > F.col("__top.v")), "accept")
        .when(F.col("__v") < F.col("__top.v"), "stale")
        .when(F.col("__top.d") == F.col(digest), "replay")
        .otherwise("conflict")
    )
    return rows.withColumn("decision", decision).select(*df.columns, "decision")


def conflicts(decided: DataFrame) -> DataFrame:
    return decided.where("decision = 'conflict'")


def tombstones(df: DataFrame, keys: list[str], guard: str, pos: str, op: str = "op") -> DataFrame:
    """Per key the highest (guard, position) and whether it is a delete: what a later write must beat. Aggregates map-side."""
    top = F.max(F.struct(F.col(guard).alias("guard"), F.col(pos).alias("pos"), (F.col(op) == "delete").alias("deleted")))
    return df.groupBy(*keys).agg(top.alias("t")).select(*keys, "t.guard", "t.pos", "t.deleted")


def unfit(df: DataFrame, keys: list[str], guard: str, pos: str) -> DataFrame:
    """Rows that a guarded upsert must refuse: without guard value, key or position. Adds ``reason``."""
    lacks_key = F.lit(False)
    for k in keys:
        lacks_key = lacks_key | F.col(k).isNull()
    reason = F.when(lacks_key, "no key").when(F.col(guard).isNull(), "no guard value").when(F.col(pos).isNull(), "no position")
    return df.withColumn("reason", reason).where("reason IS NOT NULL")
