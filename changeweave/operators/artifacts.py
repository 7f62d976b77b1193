"""Immutable artifacts of a change stream: how rows fall into them, how they are found, published and checked."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, MapType, StructField, StructType

from changeweave.functions.scalars import framed, path_token, sha
from changeweave.functions.scratch import forget, written


def plan(df: DataFrame, txn: str = "xid", order: str = "seq", tbl: str = "tbl", version: str = "version", op: str = "op") -> DataFrame:
    """Adds ``artifact`` (from 0 in each transaction) and ``ordinal``: a new artifact starts at every change of table or
    schema version, and a DDL record is a barrier of its own. Depends on the rows' order only, so replays agree."""
    w = Window.partitionBy(txn).orderBy(order)
    ident = F.struct(F.col(tbl), F.col(version), F.col(op) == "ddl")
    opens = (~ident.eqNullSafe(F.lag(ident).over(w))) | (F.col(op) == "ddl")
    first = F.row_number().over(w)
    rows = df.withColumn("ordinal", (first - 1).cast("long")).withColumn("__opens", F.when(first == 1, 0).otherwise(opens.cast("int")))
    return rows.withColumn("artifact", F.sum("__opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__opens")


def manifest(planned: DataFrame, lineage: str, txn: str = "xid") -> DataFrame:
    """One row per artifact: id, object key, first ordinal, rows. The id depends on lineage, transaction and place."""
    one = planned.groupBy(txn, "artifact").agg(F.min("ordinal").alias("first_ordinal"), F.count(F.lit(1)).alias("n_rows"))
    ident = sha(F.lit(lineage), F.col(txn), F.col("artifact"))
    return one.withColumn("artifact_id", ident).withColumn("object_key", F.concat_ws("/", F.lit(lineage), path_token(F.col(txn).cast("string")), F.substring("artifact_id", 1, 16)))


def misplaced(rows: DataFrame, manifests: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose ordinal is not the artifact's first ordinal plus their offset in it."""
    w = Window.partitionBy(*keys).orderBy("ordinal")
    met = rows.withColumn("offset", (F.row_number().over(w) - 1).cast("long")).join(manifests.select(*keys, "first_ordinal"), keys)
    return met.where(F.col("ordinal") != F.col("first_ordinal") + F.col("offset"))


def chunks(df: DataFrame, within: list[str], order: str, size: Column, most_rows: int, most_bytes: int) -> DataFrame:
    """Adds ``chunk``, from 0: rows in order, a new chunk where one more row would pass either limit.

    A chunk passes the limit of bytes only if it is a single row. Where a chunk begins depends on all before it, so the
    sizes of a group (of a transaction, as a rule) go through Python one after another; other columns don't.
    """
    slim = df.select(*within, order, F.coalesce(size, F.lit(0)).cast("long").alias("__size"))

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order, kind="stable")
        chunk, rows, held, out = 0, 0, 0, []
        for n in g["__size"]:
            if rows and (rows == most_rows or held + n > most_bytes):
                chunk, rows, held = chunk + 1, 0, 0
            rows, held = rows + 1, held + n
            out.append(chunk)
        return g.drop(columns="__size").assign(chunk=out)

    made = slim.groupBy(*within).applyInPandas(walk, StructType([*slim.drop("__size").schema, StructField("chunk", LongType())]))
    return df.join(made, [*within, order])


def bisected(df: DataFrame, txn: str, order: str, size: Column, most: int) -> DataFrame:
    """One row per piece of each transaction, halved by rows until every piece has at most ``most`` bytes or one row.

    Columns: the transaction, ``first`` (row from 0), ``n_rows``, ``bytes`` and ``halvings``, how often the piece's rows were
    halved. Sizes are those of the rows, as prefix sums; a transaction's sums are one array.
    """
    held = F.sum(F.coalesce(size, F.lit(0)).cast("long")).over(Window.partitionBy(txn).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    sums = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col("__held")))), lambda r: r["__held"])
    t = df.select(txn, order, held.alias("__held")).groupBy(txn).agg(F.concat(F.array(F.lit(0).cast("long")), sums).alias("__sums"))
    piece = lambda lo, hi, n: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), n.cast("int").alias("n"))
    weight = lambda p: F.get("__sums", p["hi"]) - F.get("__sums", p["lo"])

    def halved(p: Column) -> Column:
        mid = p["lo"] + F.floor((p["hi"] - p["lo"]) / 2)
        two = F.array(piece(p["lo"], mid, p["n"] + 1), piece(mid, p["hi"], p["n"] + 1))
        return F.when((weight(p) > most) & (p["hi"] - p["lo"] > 1), two).otherwise(F.array(piece(p["lo"], p["hi"], p["n"])))

    n = F.size("__sums") - 1
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(n.cast("double"))).cast("int"))
    pieces = F.aggregate(rounds, F.array(piece(F.lit(0), n, F.lit(0))), lambda ps, _: F.flatten(F.transform(ps, halved)))
    p = F.col("__p")
    return t.withColumn("__p", F.explode(pieces)).select(txn, p["lo"].alias("first"), (p["hi"] - p["lo"]).alias("n_rows"), weight(p).alias("bytes"), p["n"].cast("long").alias("halvings"))


def ancestry(snapshots: DataFrame, head: int) -> DataFrame:
    """The head snapshot and its ancestors: what is absent here was never committed on this line.

    Jumps double from round to round, so a line of n snapshots takes log2(n) rounds, each on written tables. A loop of
    parents ends like a line: each snapshot counts once.
    """
    spark = snapshots.sparkSession
    jump = written(snapshots.select("id", F.col("parent").alias("up")).where("up IS NOT NULL"))
    met = written(snapshots.where(F.col("id") == head).select("id").distinct())
    n = met.count()
    while True:
        further = written(met.union(met.join(jump, "id").select(F.col("up").alias("id"))).distinct())
        twice = written(jump.join(jump.select(F.col("id").alias("up"), F.col("up").alias("upper")), "up").select("id", F.col("upper").alias("up")).distinct())
        for t in (met, jump):
            forget(t)
        met, jump, grown = further, twice, further.count()
        if grown == n:
            return spark.read.parquet(met._changeweave_path).join(snapshots.select("id").distinct(), "id", "left_semi")
        n = grown


def projected_rows(df: DataFrame, columns: list[str], unchanged: Column, pos: str = "pos", ordinal: str = "ordinal", batch: str = "xid") -> DataFrame:
    """Rows as an artifact holds them: position, ordinal, batch and the names of unchanged columns beside the columns."""
    return df.select(F.col(pos).alias("_pos"), F.col(ordinal).alias("_seq"), F.col(batch).alias("_batch_id"), F.to_json(unchanged).alias("_unchanged"), *columns)


def verified(rows: DataFrame, manifests: DataFrame, artifact: str, order: str, columns: list[str]) -> DataFrame:
    """Per artifact whether its rows are those that the manifest (artifact, n_rows, digest) promises: ok, rows, content or missing."""
    row = framed(*[F.col(c) for c in columns])
    seen = rows.groupBy(artifact).agg(F.count(F.lit(1)).alias("__n"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("r")))).alias("__rows"))
    digest = F.sha2(F.array_join(F.col("__rows.r"), "").cast("binary"), 256)
    met = manifests.join(seen, artifact, "left")
    state = F.when(F.col("__n").isNull(), "missing").when(F.col("__n") != F.col("n_rows"), "rows").when(digest != F.col("digest"), "content").otherwise("ok")
    return met.select(artifact, state.alias("state"))


def batch_sizes(df: DataFrame, batch: str, columns: list[str]) -> DataFrame:
    """Estimated bytes per batch: the text of every value, nested ones as JSON, and two bytes for what stands between."""
    kinds = {f.name: f.dataType for f in df.schema}
    one = lambda c: F.octet_length(F.to_json(F.struct(c)) if isinstance(kinds[c], (ArrayType, MapType, StructType)) else F.col(c).cast("string"))
    row = sum((F.coalesce(one(c), F.lit(4)) + 2 for c in columns), F.lit(0))
    return df.groupBy(batch).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(row.cast("long")).alias("bytes"))


def summary_match(snapshots: DataFrame, expected: DataFrame) -> DataFrame:
    """Per expected commit: committed, absent, or conflict where a snapshot agrees on the batch but not on the digest."""
    met = expected.join(snapshots.select("batch_id", F.col("digest").alias("seen")), "batch_id", "left")
    return met.select("batch_id", F.when(F.col("seen").isNull(), "absent").when(F.col("seen") == F.col("digest"), "committed").otherwise("conflict").alias("outcome"))
