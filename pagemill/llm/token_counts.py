"""Token counts by field or section, attributed through the character spans of tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import guarded, without
from pagemill.llm.encode import Encoder, groups
from pagemill.llm.tokens import default_tokenizer

RULES = ("first", "last", "most")
_SECTION = T.StructType([T.StructField(n, T.LongType()) for n in ("section", "start", "end", "n_tokens", "n_crossing")])


def attribute(starts: np.ndarray, ends: np.ndarray, cuts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Interval join of token spans with sections: tokens by section, and how many of them reach into another one.

    cuts: the sections' starts in ascending order, the first 0, then the text's end. The rule says who gets a token that
    crosses a boundary: the section of its first character, of its last, or with most of its characters (the earliest of
    equals). Each token counts once.
    """
    n = len(cuts) - 1
    low = np.clip(np.searchsorted(cuts, starts, "right") - 1, 0, n - 1)
    high = np.clip(np.searchsorted(cuts, np.maximum(ends - 1, starts), "right") - 1, 0, n - 1)
    owner = low if rule == "first" else high.copy()
    cross = low != high
    if rule == "most":
        owner = low.copy()
        for i in np.nonzero(cross)[0]:
            k = np.arange(low[i], high[i] + 1)
            owner[i] = k[np.argmax(np.minimum(cuts[k + 1], ends[i]) - np.maximum(cuts[k], starts[i]))]
    return np.bincount(owner, minlength=n), np.bincount(owner[cross], minlength=n)


def section_cuts(text: str, separator: str = "\n") -> np.ndarray:
    """Sections end after each separator; an empty text is one empty section."""
    cuts, at = [0], text.find(separator)
    while at >= 0:
        at += len(separator)
        if at < len(text):
            cuts.append(at)
        at = text.find(separator, at)
    return np.array([*cuts, len(text)], np.int64)


@guarded("_parts")
def count_tokens(docs: DataFrame, tokenizer: str | None = None, text_col: str = "text", separator: str = "\n", fields: list[str] | None = None, joint: str = "\n", rule: str = "first") -> DataFrame:
    """Adds sections: an array of (section, start, end, n_tokens, n_crossing), spans in characters of the encoded text.

    Without fields, sections are the separator-ended parts of text_col. With fields, the encoded text is those columns as
    strings, each followed by `joint` but the last, and section k is field k with its joint. Each text is encoded once and
    whole: no section is encoded alone, so their counts add up to the document's. A token across a boundary goes to one
    section by `rule` ("first", "last" or "most"; see attribute()) and is counted in that section's n_crossing.
    Nulls are empty texts; an empty text is one section without tokens; rows that repeat each get theirs; an empty table
    gives no rows. An input column called sections is replaced.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    src = without(docs, ["sections"])
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (fields or [text_col])]
    src = src.withColumn("_parts", F.array(*parts))
    path = tokenizer or default_tokenizer()
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("sections", T.ArrayType(_SECTION))])

    def count(batches):
        encoder = Encoder.at(path)
        for batch in batches:
            texts, cuts, out = [], [], []
            for parts in batch.column("_parts").to_pylist():
                text = joint.join(parts)
                texts.append(text)
                if fields is None:
                    cuts.append(section_cuts(text, separator))
                else:
                    size = [len(p) + (len(joint) if k < len(parts) - 1 else 0) for k, p in enumerate(parts)]
                    cuts.append(np.concatenate([[0], np.cumsum(size)]))
            for a, b in groups(texts):
                for (s, e), cut in zip(encoder.offsets(texts[a:b]), cuts[a:b], strict=True):
                    n, crossing = attribute(s, e, cut, rule)
                    out.append([{"section": k, "start": int(cut[k]), "end": int(cut[k + 1]), "n_tokens": int(n[k]), "n_crossing": int(crossing[k])} for k in range(len(n))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.struct([(f.name, pa.int64()) for f in _SECTION])))], schema.fieldNames())

    return src.mapInArrow(count, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document: (doc_id, section, start, end, n_tokens, n_crossing)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("_text", F.col("text")).drop("text")
    out = count_tokens(docs, text_col="_text").select("doc_id", F.explode("sections").alias("s"))
    return out.select("doc_id", "s.section", "s.start", "s.end", "s.n_tokens", "s.n_crossing")
