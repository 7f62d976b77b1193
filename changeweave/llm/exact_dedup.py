"""Exact deduplication by 128-bit content hash, with the bytes compared inside each hash group.

Everything is built-in DataFrame functions. Documents are keyed by the MD5 of their text without blanks.
The group aggregation keys on (hash, text), so two different texts of one hash stay two groups: Spark compares
the key bytes. The aggregation combines map-side, so a text that a third of the rows share costs one row per
map task. Only slim rows (id, hashes, length) meet the groups again; AQE splits that join when a hash is hot.

Defined cases: null text counts as empty; texts of blanks only equal the empty text; a null id sorts before all
others; rows that repeat the id and the text of the row that stays are one document listed more than once, of
which one row is kept; an empty table gives an empty report; other columns are ignored and never clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changeweave.llm.common import BLANKS, quoted, table


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def content_hash(norm: Column) -> Column:
    return F.unhex(F.md5(norm.cast("binary")))


def duplicate_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hasher: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256. ``hasher`` is for tests that force collisions."""
    keyed = (
        docs.select(quoted(id_col).alias("doc_id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
        .select("doc_id", normalised(F.col("text")).alias("norm"), F.length("text").alias("n_chars"))
        .withColumn("hash", hasher(F.col("norm")))
    )
    groups = (
        keyed.groupBy("hash", "norm")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min(F.struct((-F.col("n_chars")).alias("shortness"), "doc_id")).alias("best"))
        .select("hash", F.unhex(F.sha2("norm", 256)).alias("sha"), "group_size", F.col("best.doc_id").alias("keep_id"), (-F.col("best.shortness")).alias("keep_chars"))
    )
    same_row = Window.partitionBy("hash", "sha", "doc_id").orderBy(F.col("n_chars").desc())
    slim = keyed.select("doc_id", "n_chars", "hash", F.unhex(F.sha2("norm", 256)).alias("sha")).withColumn("nth", F.row_number().over(same_row))
    return slim.join(groups, ["hash", "sha"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _row_key(id_col: Column, sha: Column) -> Column:
    """One key of id and normalised text; a null id differs from every text."""
    return F.concat_ws("|", sha, F.coalesce(F.concat(F.lit("="), id_col.cast("string")), F.lit("null")))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. The texts move once more, by id and hash, so no copy group meets in one task.

    Of rows repeating the id and text of the one that stays, the longest original stays, then the first text.
    """
    stays = duplicate_report(docs, id_col, text_col).where("kept").select(_row_key(F.col("doc_id"), F.col("text_sha256")).alias("__cw_key"))
    marked = docs.withColumn("__cw_key", _row_key(quoted(id_col), F.sha2(normalised(quoted(text_col)).cast("binary"), 256)))
    marked = marked.withColumn("__cw_len", F.length(F.coalesce(quoted(text_col), F.lit(""))))
    one = Window.partitionBy("__cw_key").orderBy(F.col("__cw_len").desc(), quoted(text_col))
    met = marked.join(stays, "__cw_key", "left_semi")
    return met.withColumn("__cw_nth", F.row_number().over(one)).where("__cw_nth = 1").select(*[quoted(c) for c in docs.columns])


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_report(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), k AS (
  SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
  FROM t WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""
