"""The corpus pipeline: five stages over documents, each written as Parquet and read again by its caller.

Every stage works on all that its predecessor kept and returns the columns of documents; the mix adds
``repetition``. Near-duplicates are judged on five-word shingles at a similarity of 0.8 or more.

Defined cases, for every stage: an empty table gives an empty one; extra columns are kept, whatever their names (the mix
names its column otherwise if ``repetition`` is taken); null langs, sources and sizes are kept as they are; texts are
judged whole, however long. What each stage makes of null and empty texts, null ids, ties and repeated rows is said at it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from changeweave.llm import decontaminate, exact_dedup, mixing, near_dedup, toxicity
from changeweave.llm.common import table

NEAR_PERCENT = 80


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon model, learned from the labels, predicts toxic go.

    Null and empty texts have no hits and stay unless the labels say otherwise of texts without any; rows with a null id
    are judged like others but not learned from; repeated rows are judged each, alike; a score of exactly 0.5 is toxic.
    """
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for blanks, one row stays: the one of most characters, then of the smallest id.

    Null texts count as empty and are equal; a null id is smaller than all others; of rows that repeat id and text one stays.
    """
    return exact_dedup.drop_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, the document of the smallest id stays.

    Null texts and texts without words are linked with nothing and stay; a similarity of exactly 0.8 is a link; rows that
    repeat an id are one document and stay or go together; null ids link like others and are never the smallest.
    """
    return near_dedup.drop_near_duplicates(docs, percent=NEAR_PERCENT)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of any benchmark item go.

    Null texts and texts without words stay; benchmark rows with null id or text match nothing; equal texts share a verdict.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), min_items=1)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target shares; a document appears as many times as the mix takes it.

    Null and empty texts have no words, and their copies no weight; a null source is a source of its own, ranked last; null
    ids hash alike; equal hashes are ordered by id, then size; repeated rows are taken each.
    """
    return mixing.mix_rows(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("MinHash near-dedup", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed),
]

#: Toxicity is a trained model, which SQL can't express; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
