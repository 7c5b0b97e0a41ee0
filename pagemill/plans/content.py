"""Queries of document files and their text: conversations are written as files and read back, whole tables each time."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagemill.functions import codecs, paths
from pagemill.operators import objects, pages, reading
from pagemill.plans.structure import _rows
from pagemill.sources import pdf, writer

QUERIES: dict = {}
ORACLES: dict = {}


def _add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


_PAGES = "p AS (SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INT) AS page_index, text FROM conversations)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = objects.dealt(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id")
    return t.select(F.col("conv_id").alias("doc_id"), (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1).alias("page_index"), F.coalesce("text", F.lit("")).alias("text"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a document file."""
    return writer.documents_of(_pages(spark, sf_dir))


_add("sink_write", lambda s, d: files(s, d).select("doc_id", F.expr("substring(content, 1, 5)").cast("string").alias("head"), F.right(F.decode("content", "ISO-8859-1"), F.lit(6)).alias("tail")), "SELECT DISTINCT conv_id AS doc_id, '%PDF-' AS head, '%%EOF' || chr(10) AS tail FROM conversations")
_add("src_open", lambda s, d: pdf.relation(files(s, d), "documents").select("doc_id", "version", "page_count", "error"), "SELECT conv_id AS doc_id, '1.7' AS version, CAST(count(*) AS INT) AS page_count, CAST(NULL AS VARCHAR) AS error FROM conversations GROUP BY conv_id")
_add("src_xref_classic", lambda s, d: pdf.relation(files(s, d), "xref").groupBy("doc_id").agg(F.count_if(F.col("kind") == "offset").alias("used"), F.count_if(F.col("kind") == "free").alias("free")), "SELECT conv_id AS doc_id, 4 + 2 * count(*) AS used, CAST(1 AS BIGINT) AS free FROM conversations GROUP BY conv_id")
_add("src_parse_object", lambda s, d: pdf.relation(files(s, d), "objects").groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "SELECT 'stream' AS kind, count(*) AS n FROM conversations UNION ALL SELECT 'dict', count(*) + 4 * count(DISTINCT conv_id) FROM conversations")
_add("ext_metadata", lambda s, d: pdf.relation(files(s, d), "documents").select("doc_id", "title", "encrypted", F.size("warnings").alias("warnings")), "SELECT DISTINCT conv_id AS doc_id, '' AS title, false AS encrypted, 0 AS warnings FROM conversations")
_add("ext_pages", lambda s, d: pdf.relation(files(s, d), "doc_pages").select("doc_id", "page_index", F.element_at("media_box", 3).alias("width"), "rotate"), f"WITH {_PAGES} SELECT doc_id, page_index, 600.0::DOUBLE AS width, 0 AS rotate FROM p")
_SQUEEZED = "regexp_replace(regexp_replace(text, '\\n+', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
_READ = f"WITH {_PAGES} SELECT doc_id, page_index, {_SQUEEZED} AS text FROM p WHERE length(regexp_replace(text, '\\n', '', 'g')) > 0"
_add("ext_fragments", lambda s, d: pdf.relation(files(s, d), "fragments").groupBy("doc_id", "page_index").agg(F.count(F.lit(1)).alias("n"), F.max("y").alias("top"), F.min("x").alias("x")), f"WITH {_PAGES}, l AS (SELECT doc_id, page_index, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM p) SELECT doc_id, page_index, count(*) AS n, 750.0::DOUBLE - 14.4 * min(k) AS top, 50.0::DOUBLE AS x FROM l WHERE line <> '' GROUP BY ALL")
_add("ext_text", lambda s, d: reading.stream_text(pdf.relation(files(s, d), "fragments")), _READ)
_FRAGMENT = "doc_id long, page_index int, frag_index int, text string, x double, y double, font_size double, width double, angle double"
_LINES = (_FRAGMENT, [(1, 0, 0, "Hello", 50.0, 700.0, 10.0, 25.0, 0.0), (1, 0, 1, "world", 79.0, 700.0, 10.0, 25.0, 0.0), (1, 0, 2, "Next", 50.0, 680.0, 10.0, 20.0, 0.0), (1, 0, 3, ".......", 70.0, 680.0, 10.0, 30.0, 0.0), (1, 0, 4, "7", 100.0, 680.0, 10.0, 5.0, 0.0), (1, 1, 0, "one", 50.0, 700.0, 10.0, None, 0.0)])
_add("ord_operator_text", lambda s, d: reading.stream_text(_rows(s, *_LINES)), "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 0, 'Hello world' || chr(10) || 'Next ....... 7'), (1, 1, 'one')) v(doc_id, page_index, text)")


def column_page() -> list[tuple[str, float, float]]:
    """(text, x, y) of a page of a title, two columns of six lines and a footer, as read; # stands for the document's number."""
    left = [(f"Left column line {k} of running text #", 50.0, 700.0 - 14 * k) for k in range(6)]
    right = [(f"Right column line {k} of running text #", 320.0, 700.0 - 14 * k) for k in range(6)]
    return [("Title across the page that is wide enough to be over both of the two columns here", 50.0, 740.0), *left, *right, ("Footer across the page that is wide enough to be over both of the two columns too", 50.0, 560.0)]


def column_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Such a page for every conversation, drawn as read by odd ones, backwards by even ones."""
    docs = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("doc_id")).distinct()
    drawn = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(x).alias("x"), F.lit(y).alias("y")) for t, x, y in column_page()])
    runs = docs.select("doc_id", F.posexplode(F.when(F.col("doc_id") % 2 == 1, drawn).otherwise(F.reverse(drawn))).alias("frag_index", "r"))
    text = F.replace(F.col("r.text"), F.lit("#"), F.col("doc_id").cast("string"))
    return runs.select("doc_id", F.lit(0).alias("page_index"), "frag_index", text.alias("text"), "r.x", "r.y", F.lit(10.0).alias("font_size"), (F.length("r.text") * 6.0).alias("width"), F.lit(0.0).alias("angle"))


_DOCS = "(SELECT DISTINCT conv_id AS d FROM conversations)"
_COLUMN_TEXT = " || chr(10) || ".join(f"replace('{t}', '#', CAST(d AS VARCHAR))" for t, _, _ in column_page())
_add("ord_layout_text", lambda s, d: reading.layout_text(column_pages(s, d)), f"SELECT CAST(d AS BIGINT) AS doc_id, 0 AS page_index, {_COLUMN_TEXT} AS text, 2 AS columns FROM {_DOCS}")
_add("ord_columns", lambda s, d: reading.layout_text(column_pages(s, d).unionByName(pdf.relation(files(s, d), "fragments").select((-F.col("doc_id") - 1).alias("doc_id"), "page_index", "frag_index", "text", "x", "y", "font_size", "width", "angle"))).select("doc_id", "page_index", "columns"), f"SELECT CAST(d AS BIGINT) AS doc_id, 0 AS page_index, 2 AS columns FROM {_DOCS} UNION ALL SELECT -doc_id - 1, page_index, 1 FROM ({_READ})")
_add("ord_arrange", lambda s, d: reading.layout_text(pdf.relation(files(s, d), "fragments")).select("doc_id", "page_index", F.length("text").cast("long").alias("n")), f"SELECT doc_id, page_index, length(text) AS n FROM ({_READ})")
_add("ext_layout", lambda s, d: reading.layout_text(pdf.relation(files(s, d), "fragments")).select("doc_id", "page_index", "columns"), f"SELECT doc_id, page_index, 1 AS columns FROM ({_READ})")
_add("ord_lines", lambda s, d: reading.lines(pdf.relation(files(s, d), "fragments")).groupBy("doc_id", "page_index").agg(F.countDistinct("line").alias("n_lines")), f"WITH {_PAGES} SELECT doc_id, page_index, CAST(len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) AS BIGINT) AS n_lines FROM p WHERE length(replace(text, chr(10), '')) > 0")
_add("ord_row_order", lambda s, d: reading.row_order(reading.lines(column_pages(s, d))).select("doc_id", "frag_index", "position"), f"WITH f AS (SELECT CAST(d AS BIGINT) AS doc_id, CAST(k AS INT) AS frag_index, CASE WHEN d % 2 = 1 THEN k ELSE 13 - k END AS e FROM {_DOCS}, range(14) b(k)) SELECT doc_id, frag_index, CAST(CASE WHEN e = 0 THEN 0 WHEN e = 13 THEN 13 WHEN e <= 6 THEN 2 * e - 1 ELSE 2 * (e - 6) END AS INT) AS position FROM f")
_add("ord_tagged_text", lambda s, d: reading.tagged_text(_rows(s, _FRAGMENT + ", rank int", [(1, 0, 0, "b", 0.0, 50.0, 10.0, 5.0, 0.0, 2), (1, 0, 1, "a", 0.0, 40.0, 10.0, 5.0, 0.0, 1), (1, 0, 2, "head", 0.0, 90.0, 10.0, 5.0, 0.0, None), (1, 0, 3, "foot", 0.0, 10.0, 10.0, 5.0, 0.0, None)])), "SELECT CAST(1 AS BIGINT) AS doc_id, 0 AS page_index, 'head' || chr(10) || 'a' || chr(10) || 'b' || chr(10) || 'foot' AS text")
_add("ord_scripts", lambda s, d: reading.raised(_rows(s, *_SCRIPTS)).select("doc_id", "frag_index", "shift"), "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 0, 'none'), (1, 1, 'super'), (1, 2, 'sub'), (1, 3, 'none')) v(doc_id, frag_index, shift)")
_SCRIPTS = (_FRAGMENT, [(1, 0, 0, "E = mc", 0.0, 100.0, 12.0, 40.0, 0.0), (1, 0, 1, "2", 40.0, 104.0, 8.0, 4.0, 0.0), (1, 0, 2, "i", 44.0, 97.0, 8.0, 4.0, 0.0), (1, 0, 3, " done", 50.0, 100.0, 12.0, 30.0, 0.0)])
_add("ord_text_runs", lambda s, d: reading.run_order(column_pages(s, d)).select("doc_id", "frag_index", "reading_index"), ORACLES["ord_row_order"].replace("AS position", "AS reading_index"))


def _updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a second revision that turns page 0, and a damaged copy of each (doc_id negative) without its index."""
    def two(batch: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for doc, content in zip(batch.doc_id, batch.content, strict=True):
            p = pdf.Pdf.open(content)
            page = {**p.get(pdf.Ref((6, 0))), "Rotate": 90}
            rows.append((doc, writer.update(content, {6: page})))
            rows.append((-doc - 1, content[: content.rfind(b"xref")].replace(b"startxref", b"")))
        return pd.DataFrame(rows, columns=["doc_id", "content"])

    return files(spark, sf_dir).groupBy("doc_id").applyInPandas(two, "doc_id long, content binary")


_add("src_earlier_revision", lambda s, d: pdf.relation(_updated(s, d).where("doc_id >= 0"), "xref").groupBy("doc_id").agg((F.max("revision") + 1).alias("revisions")), "SELECT DISTINCT conv_id AS doc_id, 2 AS revisions FROM conversations")
_add("sink_save", lambda s, d: pdf.relation(_updated(s, d).where("doc_id >= 0"), "doc_pages").where("rotate = 90").select("doc_id", "page_index"), "SELECT DISTINCT conv_id AS doc_id, 0 AS page_index FROM conversations")
_add("src_repair", lambda s, d: pdf.relation(_updated(s, d).where("doc_id < 0"), "documents").select((-F.col("doc_id") - 1).alias("doc_id"), "page_count", (F.size("warnings") > 0).alias("rebuilt")), "SELECT conv_id AS doc_id, CAST(count(*) AS INT) AS page_count, true AS rebuilt FROM conversations GROUP BY conv_id")


def packed_file() -> bytes:
    """A file whose catalog and pages are in an object stream, under an index stream."""
    inner = {1: {"Type": pdf.Name("Catalog"), "Pages": pdf.Ref((2, 0))}, 2: {"Type": pdf.Name("Pages"), "Kids": [pdf.Ref((3, 0))], "Count": 1}, 3: {"Type": pdf.Name("Page"), "Parent": pdf.Ref((2, 0)), "MediaBox": [0, 0, 10, 10], "Contents": pdf.Ref((5, 0))}}
    bodies = [writer.serialize(v) for v in inner.values()]
    head = b" ".join(b"%d %d" % (n, sum(len(b) + 1 for b in bodies[:k])) for k, n in enumerate(inner)) + b" "
    raw = zlib.compress(head + b"\n".join(bodies))
    out, at = bytearray(b"%PDF-1.5\n"), {}
    for n, v in ((4, pdf.Stream({"Type": pdf.Name("ObjStm"), "N": 3, "First": len(head), "Filter": pdf.Name("FlateDecode")}, raw)), (5, pdf.Stream({"Filter": [pdf.Name("AHx")]}, codecs.hex_encode(b"BT /F 9 Tf 1 2 Td (packed) Tj ET")))):
        at[n] = len(out)
        out += b"%d 0 obj\n" % n + writer.serialize(v) + b"\nendobj\n"
    at[6] = len(out)
    table = b"".join(bytes((k,)) + a.to_bytes(4, "big") + bytes((g,)) for k, a, g in ((0, 0, 0), (2, 4, 0), (2, 4, 1), (2, 4, 2), (1, at[4], 0), (1, at[5], 0), (1, at[6], 0)))
    rows = b"".join(b"\x00" + table[i : i + 6] for i in range(0, len(table), 6))
    index = pdf.Stream({"Type": pdf.Name("XRef"), "W": [1, 4, 1], "Size": 7, "Root": pdf.Ref((1, 0)), "Filter": pdf.Name("FlateDecode"), "DecodeParms": {"Predictor": 12, "Columns": 6}}, zlib.compress(rows))
    out += b"6 0 obj\n" + writer.serialize(index) + b"\nendobj\nstartxref\n%d\n%%%%EOF\n" % at[6]
    return bytes(out)


def _packed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, bytearray(packed_file()))], "doc_id long, content binary")


_add("src_objstm", lambda s, d: reading.stream_text(pdf.relation(_packed(s), "fragments")), "SELECT CAST(1 AS BIGINT) AS doc_id, 0 AS page_index, 'packed' AS text")
_add("src_xref_stream", lambda s, d: pdf.relation(_packed(s), "xref").groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "SELECT * FROM (VALUES ('free', CAST(1 AS BIGINT)), ('compressed', 3), ('offset', 3)) v(kind, n)")


def _bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.encode("text", "UTF-8").alias("raw"))


_add("codec_flate", lambda s, d: _bytes(s, d).select("doc_id", F.sha2(codecs.flate(codecs.deflate("raw")), 256).alias("sha")), "SELECT doc_id, sha256(text) AS sha FROM documents")
_add("codec_chain", lambda s, d: _bytes(s, d).select("doc_id", F.sha2(codecs.chain(F.array(F.lit("AHx"), F.lit("Fl")), F.encode(F.concat(F.hex(codecs.deflate("raw")), F.lit(">")), "UTF-8")), 256).alias("sha")), "SELECT doc_id, sha256(text) AS sha FROM documents")
_CODES = [("a85", codecs.a85_encode, codecs.ascii85), ("rle", codecs.run_length_encode, codecs.run_length), ("lzw", codecs.lzw_encode, codecs.lzw)]


def _round_trip(encode, decode):
    @F.pandas_udf(T.BinaryType())
    def encoded(data: pd.Series) -> pd.Series:
        return data.map(lambda b: encode(bytes(b)))

    return lambda s, d: _bytes(s, d).select("doc_id", F.sha2(decode(encoded("raw")), 256).alias("sha"))


for _n, _e, _d in _CODES:
    _add(f"codec_{_n}", _round_trip(_e, _d), "SELECT doc_id, sha256(text) AS sha FROM documents")
_add("codec_adler32", lambda s, d: _bytes(s, d).select("doc_id", codecs.adler32("raw").alias("sum")))
_add("codec_pdfstring", lambda s, d: s.createDataFrame([(1, bytearray(pdf.string_token(rb"a\(b\)\101\n\\)", 0)[0])), (2, bytearray("﻿é".encode("utf-16-be")))], "id long, raw binary").select("id", F.when(F.hex("raw").startswith("FEFF"), F.decode(F.expr("substring(raw, 3)"), "UTF-16BE")).otherwise(F.decode("raw", "ISO-8859-1")).alias("text")), "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a(b)A' || chr(10) || '\\'), (2, 'é')) v(id, text)")
_add("sink_text", lambda s, d: _pages(s, d).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "text"))), lambda x: x["text"]), "\f").alias("text")), f"WITH {_PAGES} SELECT doc_id, string_agg(text, chr(12) ORDER BY page_index) AS text FROM p GROUP BY doc_id")
_add("sink_report", lambda s, d: pages.paginate(s.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderkey", F.lit(12.0).alias("h")), "o_custkey", "o_orderkey", "h", 60.0).select("o_custkey", "o_orderkey", "page", "y"), "SELECT o_custkey, o_orderkey, CAST(k // 5 AS INT) AS page, (k % 5) * 12.0::DOUBLE AS y FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders)")
_CURVE = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)]


def _curve():
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _CURVE])


_add("fn_path_flatten", lambda s, d: s.range(3).select("id", F.explode(paths.flattened(_curve(), (F.col("id") + 1) / 10.0)).alias("p")).select("id", "p.x", "p.y"))
_add("fn_line_segments", lambda s, d: s.range(1).select(F.explode(paths.segments(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (1, 0), (1, 0), (1, 2))]))).alias("s")).select("s.*"), "SELECT * FROM (VALUES (0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE), (1.0, 0.0, 1.0, 2.0)) v(x0, y0, x1, y1)")
_add("fn_script_split", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.explode(paths.script_runs("text")).alias("r")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("runs"), F.sum("r.length").alias("n")), None)
_add("rdr_facade", lambda s, d: pdf.relation(files(s, d), "documents").join(reading.stream_text(pdf.relation(files(s, d), "fragments")).groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars")), "doc_id").select("doc_id", "page_count", "chars"), f"SELECT doc_id, CAST(n AS INT) AS page_count, CAST(sum(length(text)) AS BIGINT) AS chars FROM ({_READ}) JOIN (SELECT conv_id AS doc_id, count(*) AS n FROM conversations GROUP BY conv_id) USING (doc_id) GROUP BY doc_id, n")
