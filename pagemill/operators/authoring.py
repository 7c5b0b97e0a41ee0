"""Documents from blocks of text: wrapped, flowed into pages, written as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators import pages
from pagemill.sources import writer

#: Points from one line to the next by kind of block; others have a paragraph's.
HEIGHTS = {"heading": 24.0, "paragraph": 14.0}


def wrapped(blocks: DataFrame, most: int = 90) -> DataFrame:
    """(doc_id, at, kind, line) of blocks (doc_id, seq, kind, text): lines of up to `most` characters, broken at white space, or within a longer word; at counts a document's lines.

    A null or empty text has no lines. Blocks are wrapped row by row; a document's lines are numbered by block and line.
    """
    pieces = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(rf".{{1,{most}}}(?:\s|$)|\S{{{most}}}"), F.lit(0))
    lines = blocks.select("doc_id", "seq", "kind", F.posexplode(pieces).alias("i", "line")).withColumn("line", F.rtrim("line")).where("line <> ''")
    return lines.withColumn("at", F.col("seq").cast("bigint") * (1 << 32) + F.col("i")).select("doc_id", "at", "kind", "line")


def flowed(blocks: DataFrame, room: float = 700.0, most: int = 90) -> DataFrame:
    """(doc_id, page_index, text): blocks' lines flowed into pages of `room` points."""
    height = F.lit(HEIGHTS["paragraph"])
    for kind, h in HEIGHTS.items():
        height = F.when(F.col("kind") == kind, h).otherwise(height)
    placed = pages.paginate(wrapped(blocks, most).withColumn("h", height), "doc_id", "at", "h", room)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    return placed.groupBy("doc_id", F.col("page").alias("page_index")).agg(text.alias("text"))


def documents(blocks: DataFrame, room: float = 700.0, most: int = 90) -> DataFrame:
    """(doc_id, content): blocks as files."""
    return writer.documents_of(flowed(blocks, room, most))
