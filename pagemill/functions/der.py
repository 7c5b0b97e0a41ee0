"""Distinguished encoding: values to bytes, and bytes to a tree of elements as rows."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Universal tags by number.
TAGS = {1: "BOOLEAN", 2: "INTEGER", 3: "BIT STRING", 4: "OCTET STRING", 5: "NULL", 6: "OBJECT IDENTIFIER", 10: "ENUMERATED", 12: "UTF8String", 16: "SEQUENCE", 17: "SET", 19: "PrintableString", 20: "T61String", 22: "IA5String", 23: "UTCTime", 24: "GeneralizedTime", 30: "BMPString"}
_TEXT = {12: "utf-8", 19: "ascii", 20: "latin-1", 22: "ascii", 23: "ascii", 24: "ascii", 30: "utf-16-be"}
DEEPEST = 64


class BadEncoding(ValueError):
    """Not a whole element, or not in its only allowed form."""


def encode(tag: int, body: bytes) -> bytes:
    """One element; tag is the identifier byte (0x30 for a sequence)."""
    n = len(body)
    if n < 128:
        return bytes([tag, n]) + body
    size = n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag, 0x80 | len(size)]) + size + body


def integer(value: int) -> bytes:
    return encode(2, value.to_bytes((value + (value < 0)).bit_length() // 8 + 1, "big", signed=True))


def identifier(dotted: str) -> bytes:
    arcs = [int(a) for a in dotted.split(".")]
    out = bytearray()
    for a in [arcs[0] * 40 + arcs[1], *arcs[2:]]:
        part = [a & 127]
        while a := a >> 7:
            part.append(a & 127 | 128)
        out += bytes(reversed(part))
    return encode(6, bytes(out))


def _shown(tag: int, body: bytes) -> str | None:
    if tag in _TEXT:
        return body.decode(_TEXT[tag], "replace")
    if tag in (2, 10):
        return str(int.from_bytes(body, "big", signed=True))
    if tag == 1:
        return "true" if body != b"\0" else "false"
    if tag == 6 and body:
        arcs, a = [], 0
        for b in body:
            a = a << 7 | b & 127
            if b < 128:
                arcs.append(a)
                a = 0
        first = min(2, arcs[0] // 40) if arcs else 0
        return ".".join(map(str, [first, arcs[0] - 40 * first, *arcs[1:]])) if arcs else None
    return None if tag == 5 else body.hex()


def decode(data: bytes, depth: int = 0):
    """(depth, tag's name, whether constructed, offset, size of the body, value of a primitive) of all elements, each before what it holds."""
    stack = [(0, len(data), depth)]
    while stack:
        at, end, depth = stack.pop()
        if at >= end:
            continue
        if depth > DEEPEST or end - at < 2:
            raise BadEncoding("nested too deeply" if depth > DEEPEST else "ends within an element")
        head, n, body = data[at], data[at + 1], at + 2
        if head & 31 == 31:
            raise BadEncoding("tags of several bytes aren't read")
        if n >= 128:
            size = data[body : body + (n & 127)]
            if n == 128 or len(size) < (n & 127) or size[:1] == b"\0" or int.from_bytes(size, "big") < 128:
                raise BadEncoding("a length that isn't definite and shortest")
            body, n = body + len(size), int.from_bytes(size, "big")
        if body + n > end:
            raise BadEncoding("a body that ends after its parent")
        number, own = head & 31, head & 0xC0 == 0
        name = TAGS.get(number, f"UNIVERSAL {number}") if own else f"[{number}]"
        inside = bool(head & 0x20)
        yield depth, name, inside, at, n, None if inside else _shown(number if own else 4, data[body : body + n])
        stack.append((body + n, end, depth))
        if inside:
            stack.append((body, body + n, depth + 1))


def records(rows: DataFrame, number: str, text: str) -> DataFrame:
    """rows with raw: a sequence of an integer and a text, null for null numbers."""
    @F.pandas_udf(T.BinaryType())
    def made(n: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else encode(0x30, integer(int(a)) + encode(12, (b or "").encode())) for a, b in zip(n, t, strict=True)])

    return rows.withColumn("raw", made(number, text))


def elements(rows: DataFrame, id_col: str, raw_col: str) -> DataFrame:
    """(id, seq, depth, tag, constructed, at, size, value) of encoded values; one that is damaged gives no rows."""
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, seq int, depth int, tag string, constructed boolean, at int, size int, value string"

    def read(batches):
        for batch in batches:
            out = []
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    out += [(key, k, *e) for k, e in enumerate(decode(raw or b""))]
                except BadEncoding:
                    continue
            types = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], [id_col, "seq", "depth", "tag", "constructed", "at", "size", "value"])

    return rows.select(id_col, raw_col).mapInArrow(read, schema)
