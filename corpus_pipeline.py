"""The corpus pipeline: what the quality classifier rejects goes, near-duplicates and benchmark leaks go, sources are mixed, tokens are written.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import common, decontaminate, mixing, quality, similar, tokens


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of docs, scores at 0.3 or more.

    Null and empty texts have the score of a text without features; equal texts share their fate; without labels of both
    classes all documents get the labels' rate.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return common.rows_where(docs, quality.OUT, lambda d: quality.classify(d, model), "predicted = 1")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): the one with the smallest id.

    Texts without words are one group; of a group's rows with the same id, or without any, one stays.
    """
    return similar.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less those that hold any whole benchmark window, however long the document is.

    Null, empty and word-less texts hold none and stay; equal texts share their fate; without items all stay.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return common.rows_where(docs, decontaminate.OUT, lambda d: decontaminate.decontaminate(d, items), "n_hit = 0")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, or up to three times.

    A null source is a source; null and empty texts have no words, so that they cost the mix nothing; equal rows are
    taken alike.
    """
    return mixing.mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix in the shared folder, read back: one row per record (doc_id, start, n_tokens, ids_crc32).

    Every document has a record for each time it is taken; null and empty texts have the end id alone.
    """
    return tokens.token_files(spark, docs)


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("decontaminate", uncontaminated), ("mix", mixed), ("tokens", token_files)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = common.stage(function(spark, docs, sf_dir), name)
    return docs
