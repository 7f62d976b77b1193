"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

Targets: every source gets its share of the total by weight; a source whose share exceeds ``max_epochs`` times
its size is clamped there and the excess is shared again by weight among the rest, until none is above. The fixed
point of those rounds has a closed form: with sources ordered by cap / weight, the first k are clamped and the
others get weight * (total - caps of the k) / (weights of the others), k being the smallest feasible one. It is
computed with window sums over the one row per source.

Sampling: a source with target / size = e + f takes every document e times, plus once more the documents of the
smallest seeded hashes that hold a fraction f of its words (the document at the cut goes to the nearer side).
The cut is found from per-(source, hash bucket) sums, so documents of a hot source meet only within one of
``buckets`` slices of it, and the join back is by (source, bucket), never by the source alone.

Defined cases: a null text has size 0 and takes 0; a null source is a source of its own, ranked last; sources
without words have target 0; a null id hashes as the empty string; repeated rows count each; equal hashes are ordered
by id, then size; a cap may be fractional, and a document is taken at most its ceiling many times; an empty table
gives an empty mix; other columns are ignored, or kept in ``mix_rows``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changeweave.llm.common import WORD_PATTERN, quoted, table

SEED = "mix-1"
MAX_EPOCHS = 3
BUCKETS_HEX = 3  # hex digits: 4096 slices of a source


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: DataFrame | None = None, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """sizes: one row per source (source, source_size); weights: optional (source, weight). Adds weight and target.

    Without weights, sources by code point, null last, weigh 1, 2, 3, repeating. The windows run over one row
    per source in one task: rows of sources, never of documents.
    """
    if weights is None:
        by_name = Window.orderBy(F.col("source").asc_nulls_last())
        s = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
    else:
        w = weights.select(F.col("source").alias("w_source"), "weight")
        s = sizes.join(w, F.col("source").eqNullSafe(F.col("w_source")), "left").drop("w_source").withColumn("weight", F.coalesce("weight", F.lit(0)))
    s = s.withColumn("cap", F.col("source_size") * F.lit(max_epochs))
    s = s.withColumn("ratio", F.when(F.col("weight") > 0, F.col("cap").cast("double") / F.col("weight").cast("double")).otherwise(F.lit(float("inf"))))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy(F.lit(1))
    s = (
        s.withColumn("total", F.sum("source_size").over(all_rows))
        .withColumn("left_words", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.when(F.col("left_weight") > 0, F.col("left_words").cast("double") / F.col("left_weight").cast("double")))
    )
    # the first row, in order of ratio, whose own level no longer exceeds its ratio sets the level for it and all later
    # ones; among equal ratios the levels fall from the first on
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", (-F.col("level")).alias("negated")))
    s = s.withColumn("settled", F.min(fits).over(all_rows))
    uncapped = -F.col("settled.negated") * F.col("weight").cast("double")
    clamped = F.col("settled").isNull() | (F.col("ratio") < F.col("settled.ratio"))
    return s.select("source", "source_size", "weight", F.when(clamped, F.col("cap").cast("double")).otherwise(F.least(uncapped, F.col("cap").cast("double"))).alias("target"))


def mix(docs: DataFrame, weights: DataFrame | None = None, max_epochs: float = MAX_EPOCHS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies (whole repetitions taken), taken (words)."""
    return _taken(docs.select(quoted(id_col).alias("doc_id"), quoted(source_col).alias("source"), word_count(quoted(text_col)).alias("size")), weights, max_epochs, seed)


def _keyed(rows: DataFrame, seed: str) -> DataFrame:
    h = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    # null and every string keep different keys, so that the joins are plain equi-joins
    return rows.withColumn("h", h).withColumn("bucket", F.substring("h", 1, BUCKETS_HEX)).withColumn("skey", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))


def _cuts(slim: DataFrame, weights: DataFrame | None, max_epochs: float) -> DataFrame:
    """Per (skey, bucket): target, source_size, epochs, and what the fraction takes before and up to this bucket."""
    slices = slim.groupBy("skey", "bucket").agg(F.first("source", ignorenulls=True).alias("source"), F.sum("size").alias("words"))
    sizes = slices.groupBy("skey").agg(F.first("source", ignorenulls=True).alias("source"), F.sum("words").alias("source_size"))
    goal = targets(sizes.select("source", "source_size"), weights, max_epochs).withColumn("skey", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    goal = goal.select("skey", "source_size", "target").withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    running = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return slices.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0))).join(goal, "skey").select("skey", "bucket", "before", "source_size", "target", "epochs", "rest")


def _taken(rows: DataFrame, weights: DataFrame | None, max_epochs: float, seed: str) -> DataFrame:
    keyed = _keyed(rows, seed)
    met = keyed.join(_cuts(keyed.select("skey", "bucket", "source", "size"), weights, max_epochs), ["skey", "bucket"])
    within = Window.partitionBy("skey", "bucket").orderBy("h", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    once_more = (F.col("start") + F.col("size") / 2.0 <= F.col("rest")).cast("long")
    out = met.withColumn("start", start).withColumn("copies", F.least(F.col("epochs") + once_more, F.lit(math.ceil(max_epochs)).cast("long")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_rows(docs: DataFrame, weights: DataFrame | None = None, max_epochs: float = MAX_EPOCHS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row as many times as it is taken, with all columns of ``docs`` and ``repetition`` from 1.

    Where ``docs`` has a column ``repetition``, that one is kept and the new one is ``mix_repetition``.
    """
    nth = "repetition"
    while nth in docs.columns:
        nth = f"mix_{nth}"
    plan = mix(docs, weights, max_epochs, seed, id_col, text_col, source_col)
    plan = plan.groupBy(F.col("doc_id").alias("__cw_id"), F.col("source").alias("__cw_source"), F.col("size").alias("__cw_size")).agg(F.max("copies").alias("__cw_copies"))
    own = docs.withColumn("__cw_own", word_count(quoted(text_col)))
    met = own.join(plan, quoted(id_col).eqNullSafe(F.col("__cw_id")) & quoted(source_col).eqNullSafe(F.col("__cw_source")) & (F.col("__cw_own") == F.col("__cw_size")))
    many = met.where("__cw_copies > 0").withColumn("__cw_nth", F.explode(F.sequence(F.lit(1), F.col("__cw_copies").cast("int"))))
    return many.select(*[quoted(c) for c in docs.columns], F.col("__cw_nth").alias(nth))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


#: ``{docs}`` is the relation mixed; it has doc_id, source and text.
MIX_SQL = r"""
WITH t AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM {docs}
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM t GROUP BY source
), w AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight, source_size * 3 AS cap FROM s
), r AS (
  SELECT *, CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE) AS ratio FROM w
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT ratio AS r0, level AS l0 FROM l WHERE level <= ratio ORDER BY ratio, level DESC LIMIT 1
), g AS (
  SELECT source, source_size, CASE WHEN l0 IS NULL OR ratio < r0 THEN CAST(cap AS DOUBLE) ELSE least(l0 * CAST(weight AS DOUBLE), CAST(cap AS DOUBLE)) END AS target
  FROM l LEFT JOIN f ON true
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM g
), c AS (
  SELECT t.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY t.source ORDER BY h, t.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM t JOIN e ON t.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies
FROM (SELECT *, CAST(least(epochs + CASE WHEN start + size / 2.0 <= rest THEN 1 ELSE 0 END, 3) AS BIGINT) AS copies FROM c)
"""
ORACLE = MIX_SQL.replace("{docs}", "documents")
