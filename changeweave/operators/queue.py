"""A consumer-group queue as pure functions of events, deliveries and the time.

Deliveries: (event_id, grp, status, visible_at, attempts, consumer); status is available, claimed or acked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def visible(events: DataFrame, deliveries: DataFrame, group: str, now: Column) -> DataFrame:
    """Events the group may claim: never delivered to it, or delivered, not acked, and visible again."""
    own = deliveries.where(F.col("grp") == group)
    fresh = events.join(own.select("event_id"), "event_id", "left_anti")
    again = events.join(own.where(F.col("status").isin("available", "claimed") & (F.col("visible_at") <= now)).select("event_id"), "event_id", "left_semi")
    return fresh.unionByName(again)


def claim(events: DataFrame, deliveries: DataFrame, group: str, consumer: str, now: Column, limit: int, seconds: int) -> DataFrame:
    """The oldest visible events, as the delivery rows that claiming them writes."""
    taken = visible(events, deliveries, group, now).orderBy("event_id").limit(limit)
    past = deliveries.where(F.col("grp") == group).select("event_id", "attempts")
    return taken.join(past, "event_id", "left").select(
        "event_id", F.lit(group).alias("grp"), F.lit("claimed").alias("status"), (now + F.expr(f"INTERVAL {seconds} SECONDS")).alias("visible_at"),
        (F.coalesce("attempts", F.lit(0)) + 1).cast("long").alias("attempts"), F.lit(consumer).alias("consumer"),
    )


def ack(deliveries: DataFrame, acks: DataFrame, group: str) -> DataFrame:
    """Deliveries with the group's claimed events of ``acks`` (event_id) set to acked."""
    marks = acks.select("event_id").distinct().withColumn("__ack", F.lit(True))
    met = deliveries.join(marks, "event_id", "left")
    done = F.col("__ack") & (F.col("grp") == group) & (F.col("status") == "claimed")
    return met.withColumn("status", F.when(done, "acked").otherwise(F.col("status"))).drop("__ack")


def replay(deliveries: DataFrame, events: DataFrame, group: str, now: Column, from_pos: Column | None = None, from_ts: Column | None = None) -> DataFrame:
    """The group's deliveries at or after a position and/or a time become available now. Positions compare as numbers."""
    chosen = F.lit(True)
    if from_pos is not None:
        chosen = chosen & (F.col("pos") >= from_pos)
    if from_ts is not None:
        chosen = chosen & (F.col("ts") >= from_ts)
    marks = events.where(chosen).select("event_id", F.lit(True).alias("__again"))
    met = deliveries.join(marks, "event_id", "left")
    again = F.coalesce(F.col("__again"), F.lit(False)) & (F.col("grp") == group)
    return met.withColumn("status", F.when(again, "available").otherwise(F.col("status"))).withColumn("visible_at", F.when(again, now).otherwise(F.col("visible_at"))).drop("__again")


def entries(df: DataFrame, stream: str, payload: list[str]) -> DataFrame:
    """Events as the queue stores them: id, stream, position and payload."""
    return df.select("id", F.lit(stream).alias("stream"), "lsn", F.to_json(F.struct(*payload)).alias("payload"))
