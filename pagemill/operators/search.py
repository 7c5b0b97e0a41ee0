"""Literal search over page texts: places, folding, and the boxes of the runs that a match spans."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions import folds
from pagemill.operators import detection

_SPECIAL = re.compile(r"([\\.\[\]{}()*+?^$|\-#&~])")


def _literal(query: str) -> str:
    return _SPECIAL.sub(r"\\\1", query)


def places(text: Column, query: str, ignore_case: bool = False, whole_word: bool = False) -> Column:
    """Where a query stands in a text, as array<int> of code points from 0: left to right, none overlapping.

    whole_word: no letter or digit on either side; a match that fails this is dropped, and the search goes on behind it.
    Places are running sums over the pieces between matches.
    """
    if not query:
        raise ValueError("the query is empty")
    pattern = ("(?iu)" if ignore_case else "") + _literal(query)
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("pieces"))
    word = [c.isalpha() or c.isnumeric() for c in (query[0], query[-1])]
    starts = folds.let(parts, lambda p: _starts(p["found"], p["pieces"], word if whole_word else None))
    return F.when(text.rlike(pattern), starts).otherwise(F.array().cast("array<int>"))


def _starts(found: Column, pieces: Column, word: list[bool] | None) -> Column:
    """Where the matches between pieces start. word: only where no letter stands beside, given whether a match starts or ends with one.

    What stands beside a match is the end of the piece before it and the start of the piece behind it; an empty piece
    means that another match does, or that the text ends.
    """
    n, letter = F.size(found), r"[\p{L}\p{N}]"
    steps = F.zip_with(F.slice(pieces, 1, n), found, lambda a, b: F.struct(F.length(a).alias("a"), F.length(b).alias("b")))
    starts = folds.scan(steps, F.lit(0), lambda at, x: at + x["a"] + x["b"], lambda at, x: at + x["a"], "int")
    if word is None:
        return starts
    first = F.transform(pieces, lambda p, i: F.when(p != "", F.left(p, F.lit(1)).rlike(letter)).otherwise((i > 0) & (i < n) & F.lit(word[0])))
    last = F.transform(pieces, lambda p, i: F.when(p != "", F.right(p, F.lit(1)).rlike(letter)).otherwise((i > 0) & (i < n) & F.lit(word[1])))
    clear = F.zip_with(F.slice(last, 1, n), F.slice(first, 2, n), lambda a, b: ~a & ~b)
    kept = F.filter(F.zip_with(starts, clear, lambda at, ok: F.struct(at.alias("at"), ok.alias("ok"))), lambda x: x["ok"])
    return F.transform(kept, lambda x: x["at"])


def search(pages: DataFrame, query: str, ignore_case: bool = False, whole_word: bool = False, first: int | None = None, last: int | None = None, text_col: str = "text", page_col: str | None = None) -> DataFrame:
    """One row per match: pages' columns less the text, and start. Pages from `first` up to before `last` are searched."""
    if page_col and first is not None:
        pages = pages.where(F.col(page_col) >= first)
    if page_col and last is not None:
        pages = pages.where(F.col(page_col) < last)
    return pages.withColumn("start", F.explode(places(F.col(text_col), query, ignore_case, whole_word))).drop(text_col)


#: Parts of an em: a wider gap between two runs of a line is a space, a larger step of the baseline a new line.
GAP, STEP = 0.25, 0.5


def page_variants(fragments: DataFrame) -> DataFrame:
    """(doc_id, page_index, text): each page's text as drawn, with spaces at wide gaps, and without any spaces, so that what is set in pieces is found too.

    Fragments (doc_id, page_index, frag_index, text, x, y, font_size, width) are gathered by page, which bounds a group;
    equal variants are one row.
    """
    runs = fragments.groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("frag_index", "text", "x", "y", "font_size", "width"))).alias("_r"))

    def joined(gap: str) -> Column:
        def piece(r: Column, i: Column) -> Column:
            before = F.element_at("_r", F.greatest(i, F.lit(1)))
            down = F.abs(r["y"] - before["y"]) > STEP * r["font_size"]
            wide = r["x"] - before["x"] - F.coalesce(before["width"], 0.5 * before["font_size"] * F.length(before["text"])) > GAP * r["font_size"]
            return F.concat(F.when(i == 0, "").when(down, "\n").when(wide, gap).otherwise(""), r["text"])

        return F.array_join(F.transform("_r", piece), "")

    drawn = joined("")
    texts = F.array_distinct(F.array(drawn, joined(" "), F.replace(drawn, F.lit(" "), F.lit(""))))
    return runs.select("doc_id", "page_index", F.explode(texts).alias("text"))


def located(fragments: DataFrame, rules, annotations: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_index, source, rule, match): what rules find in any variant of a page's text, or in its notes, each once per page, white space left out."""
    texts = page_variants(fragments).select("doc_id", "page_index", F.lit("text").alias("source"), "text")
    if annotations is not None:
        texts = texts.unionByName(annotations.where("contents IS NOT NULL").select("doc_id", "page_index", F.lit("note").alias("source"), F.col("contents").alias("text")))
    found = detection.findings(texts, rules)
    return found.select("doc_id", "page_index", "source", "rule", F.regexp_replace("match", r"\s", "").alias("match")).distinct()


def fold(text: str) -> tuple[str, list[int]]:
    """Compatibility decomposition character by character, the minus sign as "-", and for each new character where it comes from."""
    out, back = [], []
    for i, c in enumerate(text):
        for d in "-" if c == "−" else unicodedata.normalize("NFKD", c):
            out.append(d)
            back.append(i)
    return "".join(out), back


@F.pandas_udf(T.StringType())
def folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else fold(t)[0])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())])))
def folded_places(texts: pd.Series, queries: pd.Series) -> pd.Series:
    """Matches of folded queries in folded texts, as spans of the original text."""
    def one(t, q):
        if t is None or not q:
            return []
        (text, back), query, out, at = fold(t), fold(q)[0], [], 0
        while query and (at := text.find(query, at)) >= 0:
            first, last = back[at], back[at + len(query) - 1]
            out.append({"start": first, "length": last - first + 1})
            at += len(query)
        return out

    return pd.Series([one(t, q) for t, q in zip(texts, queries, strict=True)])


def boxes(matches: DataFrame, characters: DataFrame) -> DataFrame:
    """One box per match and run it spans: matches (doc, page, match, start, length) against characters (doc, page, at, run, x0, y0, x1, y1)."""
    spans = matches.select("doc_id", "page_index", "match", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("at"))
    return spans.join(characters, ["doc_id", "page_index", "at"]).groupBy("doc_id", "page_index", "match", "run").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
