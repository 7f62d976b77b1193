"""Change streams into tables: micro-batches through the same functions as batches, once each."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from changeweave.operators import fold
from changeweave.operators.lifecycle import ConflictError
from changeweave.sources.sinks import Snapshots, fan_out

ACK_POLICIES = ("all", "primary", "materialized")


@dataclass
class UpsertTarget:
    """A current-state table kept by partial folds.

    Every version holds, per key, the partial fold of all batches so far, and the receipts of the batches it has. A
    batch that comes again is skipped by its receipt; one that comes again with other content is a conflict. Receipts
    are staged under the number of the state's next version and count only once that version's marker is there: a crash
    before it leaves neither, and the next attempt overwrites both.
    """

    spark: SparkSession
    path: str
    keys: list[str]
    columns: dict[str, str | None]
    order: str = "seq"
    op: str = "op"
    state: Snapshots = field(init=False)
    receipts: Snapshots = field(init=False)

    def __post_init__(self) -> None:
        self.state, self.receipts = Snapshots(self.spark, f"{self.path}/state"), Snapshots(self.spark, f"{self.path}/receipts")

    def apply(self, df: DataFrame, batch_id: int) -> bool:
        """Whether the batch changed anything; False for a replay."""
        seen = self.receipts.read(self.state.version()) if self.state.version() else None
        digest = df.select(F.sum(F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)"))).first()[0]
        if seen is not None and (old := seen.where(F.col("batch_id") == batch_id).select("digest").first()):
            if old[0] != str(digest):
                raise ConflictError(f"batch {batch_id} came again with other content")
            return False
        now = fold.partial(df, self.keys, self.columns, self.order, self.op)
        if self.state.version():
            now = fold.merged(self.state.read().unionByName(now), self.keys, self.columns)
        receipt = self.spark.range(1).select(F.lit(batch_id).cast("long").alias("batch_id"), F.lit(str(digest)).alias("digest"))
        self.receipts.stage(receipt if seen is None else seen.unionByName(receipt), self.state.version() + 1)
        self.state.publish(now)  # the marker of the state's version makes both count
        return True

    def vacuum(self, keep: int = 2) -> list[int]:
        """Deletes versions that are no longer read, receipts (each version holds all of them) before states."""
        fs = self.receipts._fs()
        for n in range(1, self.state.version() - keep + 1):
            fs.delete(self.receipts._p(f"v{n}"), True)
        return self.state.vacuum(keep)

    def read(self) -> DataFrame:
        return fold.live(self.state.read(), self.keys, self.columns)


def start(stream: DataFrame, apply: Callable[[DataFrame, int], object], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs ``apply`` on every micro-batch. Offsets are logged before it and commits after it: a failed batch comes again."""
    w = stream.writeStream.foreachBatch(lambda df, i: apply(df, i) and None).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def read_changes(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A stream of changelog files; ``files_per_batch`` bounds what one micro-batch takes."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r).parquet(path)


def deliver(df: DataFrame, batch_id: int, primary: Callable[[DataFrame], None], secondary: dict[str, Callable[[DataFrame], None]], outbox: Callable[[DataFrame, int, str], None], policy: str = "all") -> list[str]:
    """One batch to its targets; returning is the acknowledgement.

    all: every target has it. primary: the primary has it, what others failed to take waits in the outbox.
    materialized: it is in the outbox for everyone, and targets are served from there.
    """
    if policy not in ACK_POLICIES:
        raise ValueError(policy)
    if policy == "materialized":
        for name in ["primary", *secondary]:
            outbox(df, batch_id, name)
        return ["primary", *secondary]
    if policy == "all":
        if failed := fan_out(df, {"primary": primary, **secondary}):
            raise next(iter(failed.values()))
        return []
    primary(df)
    failed = fan_out(df, secondary)
    for name in failed:
        outbox(df, batch_id, name)
    return list(failed)


GIVE_UP = ("never", "on_retry_exhaustion")
ON_FAILURE = ("hold", "drop")


def with_retry(f: Callable[[], object], attempts: int = 3, wait: float = 0.05, give_up: str = "on_retry_exhaustion", stop: Callable[[], bool] = lambda: False) -> object:
    """The result of ``f``, tried again after a wait. ``never`` gives up only once ``stop`` says so, and raises then."""
    if give_up not in GIVE_UP:
        raise ValueError(give_up)
    n = 0
    while True:
        try:
            return f()
        except Exception:
            n += 1
            if stop() or (give_up == "on_retry_exhaustion" and n >= attempts):
                raise
            time.sleep(wait)


def after_failure(mode: str, release: Callable[[], object]) -> None:
    """hold keeps the source's position for the next run; drop releases it, and the next run starts with a snapshot."""
    if mode not in ON_FAILURE:
        raise ValueError(mode)
    if mode == "drop":
        release()


def ends_empty(batches: Iterator[tuple[int, str | None]], most_empty: int) -> int:
    """How many batches (rows, position) a run takes until ``most_empty`` heartbeats in all: batches without rows and position.

    An empty batch with a position is progress. 0 sets no limit.
    """
    taken = empty = 0
    for rows, at in batches:
        taken += 1
        if not rows and at is None:
            empty += 1
            if most_empty and empty >= most_empty:
                break
    return taken


class Gate:
    """Stops a flow at a schema change until it is approved. States: pending, approved, rejected, applied."""

    def __init__(self) -> None:
        self.events: dict[str, str] = {}

    def seen(self, change: str) -> None:
        self.events.setdefault(change, "pending")

    def decide(self, change: str, state: str) -> None:
        if self.events.get(change) != "pending" and not (self.events.get(change) == "approved" and state == "applied"):
            raise ValueError(f"{change} is {self.events.get(change)}")
        self.events[change] = state

    def check(self) -> None:
        if blocked := [c for c, s in self.events.items() if s in ("pending", "rejected")]:
            raise GateClosed(blocked[0])


class GateClosed(RuntimeError):
    """A schema change awaits approval, or was rejected."""


def guarded_stream(stream: DataFrame, key: str, guard: str, pos: str, digest: str) -> DataFrame:
    """Decisions of the guard on a stream, with (guard, position, digest) per key as state: key, pos, decision.

    Rows of one key arrive in any order within a micro-batch and are taken by position there.
    """
    rows = stream.select(F.col(key).cast("string").alias("k"), F.col(guard).cast("long").alias("guard"), F.col(pos).cast("long").alias("pos"), F.col(digest).alias("digest"))

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top = tuple(state.get) if state.exists else None
        g = pd.concat(list(frames)).sort_values("pos", kind="stable")
        out = []
        for r in g.itertuples():
            version = (r.guard, r.pos)
            if top is None or version > top[:2]:
                top, said = (r.guard, r.pos, r.digest), "accept"
            elif version < top[:2]:
                said = "stale"
            else:
                said = "replay" if r.digest == top[2] else "conflict"
            out.append(said)
        state.update(top)
        yield pd.DataFrame({"k": g["k"], "pos": g["pos"], "decision": out})

    return rows.groupBy("k").applyInPandasWithState(step, "k string, pos long, decision string", "guard long, pos long, digest string", "append", GroupStateTimeout.NoTimeout)
