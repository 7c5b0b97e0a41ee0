"""Streams of documents: files that land in a folder become rows of the same relations, exactly once, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pagemill.operators import detection
from pagemill.sources import pdf


def relations(spark: SparkSession, folder: str, what: str) -> DataFrame:
    """A streaming relation of the files in a folder."""
    return pdf.relation(pdf.read_files(spark, folder, stream=True), what)


def findings(texts: DataFrame, rules=tuple(detection.GENERAL), text_col: str = "text") -> DataFrame:
    """Findings of a stream of texts: a map over rows, so late and early rows are alike."""
    return detection.findings(texts, rules, text_col)


def to_parquet(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs what is there through to Parquet and ends; a later call takes up where it ended."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
