"""Rows for warehouse targets: operations by identity, staged objects, column sets and keys compared across types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeweave.functions.scalars import framed, sha, short_hash
from changeweave.operators import fold
from changeweave.operators.decode import strict_violation


def operations(df: DataFrame, keys: list[str], columns: dict[str, str], order: str = "seq", op: str = "op") -> DataFrame:
    """The one statement per key that brings a target up to date: delete, insert (the key began here) or update, with the columns it sets.

    ``sets`` names the columns that an update has a value for; those a target keeps are not in it.
    """
    o = F.col(order)
    first = F.min_by(F.col(op), o)
    folded = df.groupBy(*keys).agg(*fold.fold_columns(columns, order, op), first.alias("__first"))
    gone = F.col("__gone").isNotNull() & (F.col("__gone") == F.col("__last"))
    reborn = F.col("__gone").isNotNull() | F.col("__first").isin("insert", "load")
    has = {c: F.col(f"__o_{c}").isNotNull() & (F.col("__gone").isNull() | (F.col(f"__o_{c}") > F.col("__gone"))) for c in columns}
    sets = F.array_compact(F.array(*[F.when(has[c] & ~gone, c) for c in columns]))
    kind = F.when(gone, "delete").when(reborn, "insert").otherwise("update")
    return folded.select(*keys, kind.alias("op"), F.array_join(sets, ",").alias("sets"), *[F.when(has[c] & ~gone, F.col(f"__v_{c}")).alias(c) for c in columns], F.col("__last").alias("last_order"))


def moved_keys(df: DataFrame, old: str, new: str, op: str = "op") -> DataFrame:
    """Updates that change their key, which targets with immutable keys must refuse or get as delete and insert."""
    return df.where((F.col(op) == "update") & ~F.col(old).eqNullSafe(F.col(new)))


def misfits(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Rows with a text that its strict type doesn't take: adds ``column`` and ``reason``, a row for each."""
    found = F.array_compact(F.array(*[F.when(strict_violation(F.col(c), k).isNotNull(), F.struct(F.lit(c).alias("column"), strict_violation(F.col(c), k).alias("reason"))) for c, k in kinds.items()]))
    return df.withColumn("__m", F.explode(found)).select("*", "__m.column", "__m.reason").drop("__m")


def staged_objects(df: DataFrame, prefix: str, batch: str, order: str, columns: list[str]) -> DataFrame:
    """One immutable object per transaction: its key, made of the content, its JSON lines and how many there are."""
    line = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"])
    one = df.groupBy(batch).agg(F.count(F.lit(1)).alias("n_rows"), F.array_join(lines, "\n").alias("body"))
    return one.select(batch, F.concat_ws("/", F.lit(prefix), F.concat(F.col(batch).cast("string"), F.lit("-"), short_hash(F.col("body")), F.lit(".json"))).alias("object_key"), "n_rows", "body")


def object_writes(objects: DataFrame, stored: DataFrame, key: str = "object_key", digest: str = "digest") -> DataFrame:
    """What a conditional create does with each object: create it, skip it (there already), or conflict (there, with other content)."""
    s = stored.select(key, F.col(digest).alias("__stored"))
    action = F.when(F.col("__stored").isNull(), "create").when(F.col("__stored") == F.col(digest), "skip").otherwise("conflict")
    return objects.join(s, key, "left").withColumn("action", action).drop("__stored")


def column_sets(present: Column, df: DataFrame) -> DataFrame:
    """How many rows have which set of columns: rows of one set load together."""
    return df.groupBy(F.array_join(F.array_sort(present), ",").alias("columns")).agg(F.count(F.lit(1)).alias("n"))


def same_key(a: Column, b: Column) -> Column:
    """Whether two keys are equal whatever their types: as numbers if both are, else as text; nulls are equal to nulls."""
    x, y = a.cast("string"), b.cast("string")
    m, n = x.try_cast("decimal(38,10)"), y.try_cast("decimal(38,10)")
    return F.when(m.isNotNull() & n.isNotNull(), m == n).otherwise(x.eqNullSafe(y))


def mapped_plan(planned: DataFrame, mapping: str, txn: str = "xid") -> DataFrame:
    """Artifacts of mapped rows: ids are bound to the mapping's fingerprint, so that a changed mapping writes other objects."""
    if len(mapping) != 64 or set(mapping) - set("0123456789abcdef"):
        raise ValueError("the fingerprint of a mapping has 64 lower-case hexadecimal digits")
    one = planned.groupBy(txn, "artifact").agg(F.min("ordinal").alias("first_ordinal"), F.count(F.lit(1)).alias("n_rows"))
    return one.withColumn("artifact_id", sha(F.lit(mapping), F.col(txn), F.col("artifact")))


def baseline(schemas: DataFrame, lineage: str) -> DataFrame:
    """The source's schemas as one checkpoint binds them: the last version of every relation, in order, and a fingerprint.

    schemas: namespace, name, version, definition. Version numbers count for the choice only: they don't outlive a process.
    """
    last = schemas.groupBy("namespace", "name").agg(F.max_by("definition", "version").alias("definition"))
    parts = F.array_sort(F.collect_list(F.struct("namespace", "name", "definition")))  # one row per relation of a source
    body = F.array_join(F.transform(parts, lambda p: framed(p["namespace"], p["name"], p["definition"])), "")
    return last.agg(F.count(F.lit(1)).alias("n"), body.alias("body")).select(F.lit(lineage).alias("lineage"), "n", sha(F.lit(lineage), F.col("body")).alias("fingerprint"))
