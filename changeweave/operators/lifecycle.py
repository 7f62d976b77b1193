"""Deliveries over time: receipts, outbox, retention, pruning, quotas, versions and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class ConflictError(RuntimeError):
    """One identity, two contents."""


def unseen(batches: DataFrame, receipts: DataFrame, identity: str = "batch_id") -> DataFrame:
    """Batches without a receipt."""
    return batches.join(receipts.select(identity).distinct(), identity, "left_anti")


def replay_verdicts(batches: DataFrame, receipts: DataFrame, identity: str = "batch_id", digest: str = "digest") -> DataFrame:
    """Adds ``verdict``: apply, skip (same id and content) or conflict (same id, other content)."""
    r = receipts.select(identity, F.col(digest).alias("__seen"))
    verdict = F.when(F.col("__seen").isNull(), "apply").when(F.col("__seen") == F.col(digest), "skip").otherwise("conflict")
    return batches.join(r, identity, "left").withColumn("verdict", verdict).drop("__seen")


def outbox_pending(entries: DataFrame, receipts: DataFrame, key: list[str], order: str, destination: str = "destination") -> DataFrame:
    """Entries still to deliver, with their place in each destination's first-in-first-out line."""
    left = entries.join(receipts.select(*key).distinct(), key, "left_anti")
    return left.withColumn("place", F.row_number().over(Window.partitionBy(destination).orderBy(order)).cast("long"))


def orphans(objects: DataFrame, claims: DataFrame, roots: DataFrame, attempts: DataFrame, now: Column, grace: int) -> DataFrame:
    """Objects older than the grace period that no publication or attempt refers to and nobody has claimed."""
    free = objects.join(claims.where(F.col("until") > now).select("object_id"), "object_id", "left_anti")
    return free.where(F.col("created") <= now - F.lit(grace)).join(roots.select("object_id"), "object_id", "left_anti").join(attempts.select("object_id"), "object_id", "left_anti")


def retainable(publications: DataFrame, objects: DataFrame, receipts: DataFrame, checkpoint: DataFrame, claims: DataFrame) -> DataFrame:
    """Objects of publications at or before the checkpoint, all acknowledged, and unclaimed."""
    undelivered = publications.join(receipts.select("publication_id").distinct(), "publication_id", "left_anti").select("object_id").distinct()
    done = publications.join(receipts.select("publication_id").distinct(), "publication_id", "left_semi")
    old = done.join(F.broadcast(checkpoint.select(F.col("pos").alias("__at"))), F.col("pos") <= F.col("__at")).drop("__at")  # one row
    return old.join(objects, "object_id").join(claims.select("object_id"), "object_id", "left_anti").join(undelivered, "object_id", "left_anti")


def prunable(manifests: DataFrame, acks: DataFrame, pending: DataFrame, limit: int) -> DataFrame:
    """The oldest acknowledged manifests with no pending delivery, at most ``limit`` (1 to 10000)."""
    if not 1 <= limit <= 10_000:
        raise ValueError("limit must be from 1 to 10000")
    return manifests.join(acks.select("manifest_id").distinct(), "manifest_id", "left_semi").join(pending.select("manifest_id"), "manifest_id", "left_anti").orderBy("manifest_id").limit(limit)


def prune(manifests: DataFrame, acks: DataFrame, pending: DataFrame, deliveries: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left of manifests, their acknowledgements and their deliveries once ``prunable`` manifests go: all three lose them."""
    gone = prunable(manifests, acks, pending, limit).select("manifest_id")
    return tuple(t.join(gone, "manifest_id", "left_anti") for t in (manifests, acks, deliveries))


def backlog(entries: DataFrame, now: Column, created: str, size: str) -> DataFrame:
    return entries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), (now - F.min(created)).alias("age"))


def over_limit(entries: DataFrame, now: Column, created: str, size: str, most: int, most_bytes: int, most_age: int) -> DataFrame:
    return backlog(entries, now, created, size).withColumn("blocked", (F.col("n") > most) | (F.col("bytes") > most_bytes) | (F.coalesce("age", F.lit(0)) > most_age))


def identity_conflicts(a: DataFrame, b: DataFrame, identity: str, content: list[str]) -> DataFrame:
    """Identities that two records give different contents."""
    both = a.select(identity, *content).unionAll(b.select(identity, *content))
    return both.groupBy(identity).agg(F.countDistinct(F.struct(*content)).alias("n")).where("n <> 1")


def numbered(publications: DataFrame, flow: str, *order: str) -> DataFrame:
    return publications.withColumn("sequence", F.row_number().over(Window.partitionBy(flow).orderBy(*order)).cast("long"))


def registry_state(events: DataFrame, change: str = "change", order: str = "seq") -> DataFrame:
    """Per schema change its state now: a repeated sighting changes nothing, decisions in order of arrival do."""
    decided = F.col("state") != "pending"
    return events.groupBy(change).agg(F.coalesce(F.max_by(F.when(decided, F.col("state")), F.when(decided, F.col(order))), F.lit("pending")).alias("state"), F.min(order).alias("first_seen"))


def least_recently_used(uses: DataFrame, key: str, order: str, keep: int) -> DataFrame:
    """Keys that a cache of ``keep`` entries has evicted: all but the most recently used."""
    last = uses.groupBy(key).agg(F.max(order).alias("last_use"))
    kept = last.orderBy(F.desc("last_use"), key).limit(keep)
    return last.join(kept.select(key), key, "left_anti")


def next_versions(registry: DataFrame, subjects: DataFrame, subject: str = "subject", version: str = "version") -> DataFrame:
    top = registry.groupBy(subject).agg(F.max(version).alias("__v"))
    return subjects.select(subject).distinct().join(top, subject, "left").select(subject, (F.coalesce("__v", F.lit(0)) + 1).cast("long").alias("next_version"))


def nearest_rank(df: DataFrame, col: str, *percents: int, ranges: int = 4096) -> DataFrame:
    """Nearest-rank quantiles: values that occur, in one row.

    Values are counted by range first, then the ranges that hold a rank by value: no task holds all distinct values.
    """
    v = df.where(F.col(col).isNotNull()).select(F.col(col).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    ends = v.agg(F.min("v").cast("double").alias("lo"), F.max("v").cast("double").alias("hi"), F.sum("n").alias("total"))  # one row
    at = F.floor((F.col("v").cast("double") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300)) * (ranges - 1)).cast("int")
    placed = v.join(F.broadcast(ends)).withColumn("part", at)
    parts = placed.groupBy("part").agg(F.sum("n").alias("m"), F.first("total").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most ``ranges`` rows
    wanted = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.greatest(F.ceil(F.col("total") * p / 100.0), F.lit(1)).alias("rank")) for p in percents]))
    held = parts.withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0))).select("part", "m", "before", wanted.alias("w"))
    held = held.where((F.col("w.rank") > F.col("before")) & (F.col("w.rank") <= F.col("before") + F.col("m"))).select("part", "before", "w.p", "w.rank")
    running = Window.partitionBy("part", "p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.select("v", "n", "part").join(F.broadcast(held), "part").withColumn("upto", F.col("before") + F.sum("n").over(running))
    found = inside.where(F.col("upto") >= F.col("rank"))
    return found.agg(*[F.min(F.when(F.col("p") == p, F.col("v"))).alias(f"p{p}") for p in percents])


def trace_violations(trace: DataFrame, flow: str = "flow", order: str = "seq") -> DataFrame:
    """Acknowledgements ahead of the checkpoint, and checkpoints ahead of what was applied."""
    w = Window.partitionBy(flow).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    top = lambda e: F.coalesce(F.max(F.when(F.col("event") == e, F.col("pos"))).over(w), F.lit(-1))
    t = trace.withColumn("applied", top("apply")).withColumn("saved", top("checkpoint"))
    broken = F.when((F.col("event") == "ack") & (F.col("pos") > F.col("saved")), "ack before checkpoint").when((F.col("event") == "checkpoint") & (F.col("pos") > F.col("applied")), "checkpoint before apply")
    return t.withColumn("violation", broken).where("violation IS NOT NULL").select(flow, order, "event", "pos", "violation")


def trace_coverage(trace: DataFrame, actions: list[str], invariants: DataFrame | None = None) -> DataFrame:
    """How often a trace has each action, 0 for those it lacks, and how often each violated invariant; kind tells them apart."""
    spark = trace.sparkSession
    every = spark.createDataFrame([(a,) for a in actions], "name string")
    seen = trace.groupBy(F.col("event").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    out = every.join(seen, "name", "full_outer").select(F.lit("action").alias("kind"), "name", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    if invariants is None:
        return out
    return out.unionByName(invariants.groupBy(F.col("violation").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("violation").alias("kind"), "name", "n"))


def next_candidate(objects: DataFrame, first: Column, *order: str) -> DataFrame:
    """The one object that collection takes next: those for which ``first`` holds before others, then by the order."""
    return objects.orderBy(first.desc_nulls_last(), *order).limit(1)


def latest_by(df: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """Per key the columns of its row of the highest order; aggregates map-side."""
    top = F.max_by(F.struct(order, *columns), order).alias("__top")
    return df.where(F.col(order).isNotNull()).groupBy(key).agg(top).select(key, "__top.*")


def lag(df: DataFrame, key: str, pos: str, acked: Column) -> DataFrame:
    """Per key how far the acknowledged positions are behind the last one; all of it where nothing is acknowledged."""
    return df.groupBy(key).agg((F.max(pos) - F.max(F.when(acked, F.col(pos)).otherwise(F.lit(0)))).alias("lag"))


def quota(df: DataFrame, key: str, size: str, live: Column) -> DataFrame:
    """Per key the bytes that are live and all bytes."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return df.groupBy(key).agg(total(F.when(live, F.col(size))).alias("live_bytes"), total(F.col(size)).alias("all_bytes"))


def active(started: list[DataFrame], ended: DataFrame, identity: str, by: str) -> DataFrame:
    """How many executions of all lists have not ended, per group."""
    both = started[0].select(identity, by)
    for more in started[1:]:
        both = both.unionAll(more.select(identity, by))
    return both.join(ended.select(identity).distinct(), identity, "left_anti").groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def drained(entries: DataFrame, receipts: DataFrame, failed: DataFrame, key: list[str], order: str, destination: str = "destination") -> DataFrame:
    """What one pass over the outbox delivers: per destination the pending entries before its first failing one."""
    left = entries.join(receipts.select(*key).distinct(), key, "left_anti")
    stops = left.join(failed.select(*key).distinct(), key, "left_semi").groupBy(destination).agg(F.min(order).alias("__stop"))
    return left.join(stops, destination, "left").where(F.col("__stop").isNull() | (F.col(order) < F.col("__stop"))).drop("__stop")


#: What is known of a delivery, in order.
STEPS = ("intent", "attempt", "evidence", "receipt")


def delivery_state(log: DataFrame, identity: str = "batch_id", step: str = "step") -> DataFrame:
    """Per delivery what comes next: start (intent only), reconcile (an attempt of unknown outcome: look before trying again),
    record (evidence that it was applied), done; conflict if evidence or receipt differ in their digest."""
    has = lambda s: F.bool_or(F.col(step) == s)
    said = F.size(F.collect_set(F.when(F.col(step).isin("evidence", "receipt"), F.col("digest"))))
    one = log.groupBy(identity).agg(has("attempt").alias("a"), has("evidence").alias("e"), has("receipt").alias("r"), said.alias("n"))
    return one.select(identity, F.when(F.col("n") > 1, "conflict").when(F.col("r"), "done").when(F.col("e"), "record").when(F.col("a"), "reconcile").otherwise("start").alias("next"))


def vacuous(changes: DataFrame, destinations: DataFrame, change: str = "change", tbl: str = "tbl") -> DataFrame:
    """Schema changes that no destination is affected by: they are complete without being applied."""
    return changes.join(destinations.select(tbl).distinct(), tbl, "left_anti").select(change, tbl)


# Lifecycle of a flow: state -> states that may follow.
FLOW_STATES = {"created": ("running", "stopped"), "running": ("paused", "stopping", "failed"), "paused": ("running", "stopping"), "stopping": ("stopped", "failed"), "stopped": ("running",), "failed": ("running", "stopped")}


def may_follow(now: str, then: str) -> bool:
    return then in FLOW_STATES.get(now, ())
