"""The fold: a changelog becomes the current state of its keys.

One aggregation, no window. Per key and column it takes the value of the latest row that has the column (an explicit
null counts) together with that row's order, and per key the order of the last change and of the last delete; a
value older than the last delete is gone. All of it combines map-side, so a hot key costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def current_state(df: DataFrame, keys: list[str], columns: dict[str, str | None], order: str = "seq", op: str = "op", since: int | DataFrame | None = None) -> DataFrame:
    """One row per live key: keys, columns and ``last_order``.

    columns: name -> name of the boolean column that says whether the row has it (None: every row but deletes does).
    since: rows up to this order are ignored (a truncate), given as a number or a one-row DataFrame.
    """
    rows = df
    if isinstance(since, DataFrame):
        rows = rows.join(F.broadcast(since.toDF("__since")), F.col("__since").isNull() | (F.col(order) > F.col("__since")))  # one row
    elif since is not None:
        rows = rows.where(F.col(order) > since)
    folded = rows.groupBy(*keys).agg(*fold_columns(columns, order, op))
    return live(folded, keys, columns)


def fold_columns(columns: dict[str, str | None], order: str = "seq", op: str = "op") -> list:
    o, gone = F.col(order), F.col(op) == "delete"
    out = [F.max(o).alias("__last"), F.max(F.when(gone, o)).alias("__gone")]
    for c, present in columns.items():
        at = F.when((~gone) & (F.col(present) if present else F.lit(True)), o)
        out += [F.max_by(c, at).alias(f"__v_{c}"), F.max(at).alias(f"__o_{c}")]
    return out


def live(folded: DataFrame, keys: list[str], columns: dict[str, str | None]) -> DataFrame:
    after = lambda o: F.col("__gone").isNull() | (F.col(o) > F.col("__gone"))
    return folded.where(after("__last")).select(*keys, *[F.when(after(f"__o_{c}"), F.col(f"__v_{c}")).alias(c) for c in columns], F.col("__last").alias("last_order"))


def hydrated(df: DataFrame, keys: list[str], columns: dict[str, str], order: str = "seq", op: str = "op", span: int | None = None) -> DataFrame:
    """Every row with the columns it lacks filled from the latest row of its key that has them, back to the last delete.

    A running window: rows of one key meet in one task. With ``span``, windows hold that many numbers of the order, and what
    stands at their ends (a partial fold of each range, merged along the key) is carried on, so that a hot key is split. Use
    the fold where only the end matters.
    """
    within, rows = keys, df
    if span:
        within, rows = [*keys, "__range"], df.withColumn("__range", F.floor(F.col(order) / span))
        ends = rows.groupBy(*within).agg(*fold_columns(columns, order, op))
        past = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*within, F.max("__gone").over(past).alias("__gone"), *[c for n in columns for c in (F.max_by(f"__v_{n}", f"__o_{n}").over(past).alias(f"__v_{n}"), F.max(f"__o_{n}").over(past).alias(f"__o_{n}"))])
        rows = rows.join(carried, within)
    w = Window.partitionBy(*within).orderBy(order)
    rows = rows.withColumn("__epoch", F.coalesce(F.sum(F.when(F.col(op) == "delete", 1)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    e = Window.partitionBy(*within, "__epoch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    for c, present in columns.items():
        value = F.last(F.when(F.col(present), F.struct(F.col(c).alias("v"))), ignorenulls=True).over(e)
        if span:
            before = (F.col("__epoch") == 0) & F.col(f"__o_{c}").isNotNull() & (F.col("__gone").isNull() | (F.col(f"__o_{c}") > F.col("__gone")))
            value = F.coalesce(value, F.when(before, F.struct(F.col(f"__v_{c}").alias("v"))))
        rows = rows.withColumn(c, F.when(F.col(op) != "delete", value["v"]))
    return rows.select(*df.columns)


def looked_up(df: DataFrame, snapshot: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Columns that a row lacks, taken from the source's row of the key as it is now."""
    s = snapshot.select(*keys, *[F.col(c).alias(f"__s_{c}") for c in columns])
    met = df.join(s, keys, "left")
    return met.select(*[F.when(F.col(columns[c]), F.col(c)).otherwise(F.col(f"__s_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def split_key_changes(df: DataFrame, old: str, new: str, key: str, op: str = "op", order: str = "seq") -> DataFrame:
    """An update that changes its key becomes a delete of the old key and, just after, an insert of the new one. Adds ``part``."""
    changed = (F.col(op) == "update") & ~F.col(old).eqNullSafe(F.col(new))
    piece = lambda k, o, p: F.struct(F.col(k).alias("k"), o.alias("o"), F.lit(p).alias("p"))
    pieces = F.when(changed, F.array(piece(old, F.lit("delete"), 0), piece(new, F.lit("insert"), 1))).otherwise(F.array(piece(new, F.col(op), 0)))
    return df.withColumn("__piece", F.explode(pieces)).withColumn(key, F.col("__piece.k")).withColumn(op, F.col("__piece.o")).withColumn("part", F.col("__piece.p")).drop("__piece", *[c for c in (old, new) if c != key])


def apply_updates(target: DataFrame, updates: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Target rows with the columns that a matching update has; updates without a target row do nothing."""
    u = updates.select(*keys, *[F.col(c).alias(f"__u_{c}") for c in columns], *[F.col(p).alias(f"__p_{c}") for c, p in columns.items()])
    met = target.join(u, keys, "left")
    return met.select(*[F.when(F.col(f"__p_{c}"), F.col(f"__u_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def latest_images(df: DataFrame, keys: list[str], columns: dict[str, str], order: str = "seq") -> DataFrame:
    """One partial image per key: of each column the latest present value (an explicit null counts), and whether any row has it."""
    values = [F.max_by(c, F.when(F.col(p), F.col(order))).alias(c) for c, p in columns.items()]
    return df.groupBy(*keys).agg(*values, *[F.coalesce(F.bool_or(p), F.lit(False)).alias(p) for p in dict.fromkeys(columns.values())])


def apply_deletes(target: DataFrame, deletes: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(deletes.select(*keys).distinct(), keys, "left_anti")


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Matching rows take the columns present in ``rows``; unmatched ones are inserted. A key-only row does nothing to a match."""
    t = target.select(*keys, F.lit(True).alias("__t"), *[F.col(c).alias(f"__t_{c}") for c in columns])
    r = rows.select(*keys, *[F.col(c).alias(f"__r_{c}") for c in columns], *[F.coalesce(F.col(p), F.lit(False)).alias(f"__p_{c}") for c, p in columns.items()])
    return t.join(r, keys, "full_outer").select(*keys, *[F.when(F.col(f"__p_{c}"), F.col(f"__r_{c}")).otherwise(F.col(f"__t_{c}")).alias(c) for c in columns])


def snapshot_plus_stream(snapshot: DataFrame, stream: DataFrame, at: int, order: str = "seq") -> DataFrame:
    """The snapshot's load rows and the stream's rows after its position: nothing lost, nothing twice."""
    return snapshot.unionByName(stream.where(F.col(order) > at), allowMissingColumns=True)


def newest(df: DataFrame, identity: list[str], version: str, *ties: str) -> DataFrame:
    """One row per identity, of the highest version: what a replacing table shows."""
    rows = df.groupBy(*identity).agg(F.max_by(F.struct(*df.columns), F.struct(version, *ties)).alias("__row"))
    return rows.select("__row.*")


def partial(df: DataFrame, keys: list[str], columns: dict[str, str | None], order: str = "seq", op: str = "op") -> DataFrame:
    """The fold of some rows, in a form that merges with the fold of others."""
    return df.groupBy(*keys).agg(*fold_columns(columns, order, op))


def merged(parts: DataFrame, keys: list[str], columns: dict[str, str | None]) -> DataFrame:
    """Partial folds merged per key; any grouping and order of the parts gives the same."""
    out = [F.max("__last").alias("__last"), F.max("__gone").alias("__gone")]
    for c in columns:
        out += [F.max_by(f"__v_{c}", f"__o_{c}").alias(f"__v_{c}"), F.max(f"__o_{c}").alias(f"__o_{c}")]
    return parts.groupBy(*keys).agg(*out)
