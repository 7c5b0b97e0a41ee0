"""Queries of form templates, one a customer, and of what is left of the function library: keyed hashes, arrays, maps and JSON, encoded structures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import codecs, der, fonts, geometry, images
from pagemill.operators import authoring, objects
from pagemill.sources import pdf, writer, xfa

QUERIES: dict = {}
ORACLES: dict = {}


def _add(name: str, run, sql: str) -> None:
    QUERIES[name] = run
    ORACLES[name] = sql


_TEMPLATE = """<?xml version="1.0"?><template xmlns="http://www.xfa.org/schema/xfa-template/3.3/"><subform name="form1" layout="tb"><occur min="0" max="-1"/><pageSet><pageArea name="P"><contentArea x="0.5in" y="0.5in" w="7.5in" h="10in"/></pageArea></pageSet>
<field name="First" x="0.5in" w="3in" h="2in"><value><text>%s</text></value></field>
<subform name="money"><field name="Base" h="2in" w="2cm"><value><text>%d</text></value><validate><script>Base &gt; 100</script></validate></field>
<field name="Rate" h="2in"><value><text>3</text></value></field>
<field name="Amount" h="2in"><event activity="initialize"><script contentType="application/x-formcalc">Amount = Base * Rate</script></event></field></subform>
<field name="Full" h="2in"><event activity="initialize"><script>Full = Upper(First) &amp; " " &amp; money.Base</script></event></field>
<field name="Tier" h="2in"><calculate><script>if (Base &gt; 100) then "premium" else "standard" endif</script></calculate></field>
<field name="Size" h="2in"><calculate><script contentType="application/x-javascript">Size.rawValue = First.rawValue.length + 1;</script></calculate><validate><script contentType="application/x-javascript">no.such(</script></validate></field>
<field name="Broken" h="2in"><value><text>as it was</text></value><event activity="initialize"><script>Broken = ((</script></event></field>
<draw name="Note"><value><text>note</text></value></draw></subform></template>"""


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, template, data): a template for every customer, and data that change every third one's base."""
    c = objects.dealt(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name"), "c_custkey")
    data = F.when(F.col("c_custkey") % 3 == 0, F.format_string("<datasets><data><form1><money><Base>%d</Base></money></form1></data></datasets>", F.col("c_custkey") + 1000))
    return c.select(F.col("c_custkey").alias("doc_id"), F.format_string(_TEMPLATE.replace("%", "%"), "c_name", "c_custkey").alias("template"), data.alias("data"))


_PATHS = ("First", "money.Base", "money.Rate", "money.Amount", "Full", "Tier", "Size", "Broken")
_LISTED = "(VALUES " + ", ".join(f"('form1.{p}', {k})" for k, p in enumerate(_PATHS)) + ") v(path, k)"


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xfa.relation(templates(spark, sf_dir), "nodes")


_add("src_xfa_template", lambda s, d: _nodes(s, d).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"), F.max(geometry.points_of(F.col("w"))).alias("w"), F.max("value").alias("value")), """
SELECT c_custkey AS doc_id, kind, CAST(n AS BIGINT) AS n, path, w, CASE kind WHEN 'field' THEN greatest(c_name, CAST(c_custkey AS VARCHAR), '3', 'as it was') WHEN 'draw' THEN 'note' END AS value
FROM customer, (VALUES ('subform', 2, 'form1', CAST(NULL AS DOUBLE)), ('field', 8, 'form1.Broken', 216.0), ('draw', 1, 'form1.Note', NULL), ('pageSet', 1, 'form1', NULL), ('pageArea', 1, 'form1.P', NULL), ('contentArea', 1, 'form1.P', 540.0)) v(kind, n, path, w)""")


def _values(data: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return xfa.relation(templates(spark, sf_dir), "values", data_col="data" if data else None).select("doc_id", "path", "value", "valid")

    return run


def _values_sql(base: str) -> str:
    return f"""SELECT c_custkey AS doc_id, path, CASE k WHEN 0 THEN c_name WHEN 1 THEN CAST(b AS VARCHAR) WHEN 2 THEN '3' WHEN 3 THEN CAST(3 * b AS VARCHAR) WHEN 4 THEN upper(c_name) || ' ' || b
  WHEN 5 THEN CASE WHEN b > 100 THEN 'premium' ELSE 'standard' END WHEN 6 THEN CAST(length(c_name) + 1 AS VARCHAR) ELSE 'as it was' END AS value, k <> 1 OR b > 100 AS valid
FROM (SELECT *, {base} AS b FROM customer), {_LISTED}"""


_add("fn_xfa_events", _values(False), _values_sql("c_custkey"))
_add("ext_xfa", _values(True), _values_sql("CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 1000 ELSE c_custkey END"))
_add("ord_xfa_paginate", lambda s, d: xfa.paginated(_nodes(s, d).where("kind = 'field'"), 720.0), f"SELECT c_custkey AS doc_id, path, CAST(k // 5 AS INT) AS page, (k % 5) * 144.0::DOUBLE AS y FROM customer, {_LISTED}")
_REFS = [("form1.money.Base", None, "form1.money.Base", "root"), ("Base.rawValue", "form1.money", "form1.money.Base", "context"), ("money.Rate", "form1.money", "form1.money.Rate", "subform"), ("$form.form1.Full", None, "form1.Full", "root"), ("elsewhere.Tier", None, "form1.Tier", "leaf"), ("Nothing", "form1", None, None), ("Size", "form1", "form1.Size", "context")]


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.explode(F.array(*[F.struct(F.lit(r).alias("ref"), F.lit(c).cast("string").alias("context")) for r, c, *_ in _REFS]))
    refs = templates(spark, sf_dir).select("doc_id", asked.alias("r")).select("doc_id", "r.ref", "r.context")
    return xfa.resolved(refs, _nodes(spark, sf_dir)).select("doc_id", "ref", "context", "found", "how")


def _text(v: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if v is None else f"'{v}'"


_add("fn_xfa_resolve", _references, "SELECT c_custkey AS doc_id, ref, context, found, how FROM customer, (VALUES " + ", ".join(f"({', '.join(map(_text, r))})" for r in _REFS) + ") v(ref, context, found, how)")

# -- functions ---------------------------------------------------------------------------------------------------------

_KEY = b"key"
_IN, _OUT = (bytes(b ^ p for b in _KEY.ljust(64, b"\0")).hex() for p in (0x36, 0x5C))
_add("cry_hash", lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.sha2("p_name", 256).alias("sha256"), F.length(F.sha2("p_name", 384)).alias("n384"), F.length(F.sha2("p_name", 512)).alias("n512"), F.lower(F.hex(codecs.hmac(F.encode("p_name", "UTF-8"), _KEY))).alias("hmac")),
     f"SELECT p_partkey, sha256(p_name) AS sha256, 96 AS n384, 128 AS n512, sha256(from_hex('{_OUT}') || from_hex(sha256(from_hex('{_IN}') || encode(p_name)))) AS hmac FROM part")
_add("codec_hex", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2(codecs.chain(F.array(F.lit("AHx")), F.encode(F.concat(F.regexp_replace(F.hex(F.encode("text", "UTF-8")), "(.{60})", "$1 \n"), F.lit(" >7"),), "UTF-8")), 256).alias("sha")), "SELECT doc_id, sha256(text) AS sha FROM documents")


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    keys = F.sort_array(F.json_object_keys("props"))
    kept = F.map_filter(F.from_json("props", "map<string,string>"), lambda k, v: F.length(v) > 0)
    return e.select("event_id", F.size(keys).alias("n"), F.array_join(keys, ",").alias("keys"), F.array_join(F.transform(F.sort_array(F.map_keys(kept)), lambda k: F.concat_ws("=", k, F.element_at(kept, k))), "&").alias("pairs"))


_add("fn_array_map_json", _json, "SELECT event_id, CAST(len(json_keys(props)) AS INT) AS n, array_to_string(list_sort(json_keys(props)), ',') AS keys, array_to_string(list_transform(list_filter(list_sort(json_keys(props)), lambda k: length(json_extract_string(props, k)) > 0), lambda k: k || '=' || json_extract_string(props, k)), '&') AS pairs FROM events")
_add("fn_arrow", lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", *[x.alias(f"c{k}") for k, x in enumerate(geometry.arrow_head(F.lit(0.0), F.lit(0.0), F.col("p_size").cast("double"), F.lit(0.0), F.lit(2.0), 30.0))]),
     "SELECT p_partkey, p_size - 2 * cos(radians(30)) AS c0, -2 * sin(radians(30)) AS c1, CAST(p_size AS DOUBLE) AS c2, 0.0::DOUBLE AS c3, p_size - 2 * cos(radians(30)) AS c4, 2 * sin(radians(30)) AS c5 FROM part")


def _der(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus")
    return der.elements(der.records(o, "o_orderkey", "o_orderstatus"), "o_orderkey", "raw").select("o_orderkey", "depth", "tag", "size", "value")


_add("cry_asn1", _der, "SELECT o_orderkey, depth, tag, CAST(CASE tag WHEN 'SEQUENCE' THEN 2 + n + 2 + length(o_orderstatus) WHEN 'INTEGER' THEN n ELSE length(o_orderstatus) END AS INT) AS size, CASE tag WHEN 'INTEGER' THEN CAST(o_orderkey AS VARCHAR) WHEN 'UTF8String' THEN o_orderstatus END AS value FROM (SELECT *, CASE WHEN o_orderkey < 128 THEN 1 WHEN o_orderkey < 32768 THEN 2 WHEN o_orderkey < 8388608 THEN 3 WHEN o_orderkey < 2147483648 THEN 4 ELSE 5 END AS n FROM orders), (VALUES (0, 'SEQUENCE'), (1, 'INTEGER'), (1, 'UTF8String')) v(depth, tag)")


def _parts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return objects.dealt(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", *columns), "p_partkey")


def _pictures(spark: SparkSession, sf_dir: str, compared: bool = False) -> DataFrame:
    """Every part as a small picture in both formats and back: (p_partkey, format, width, height, first, last, alike); alike is null where pictures aren't compared."""
    def run(batches):
        for batch in batches:
            out = []
            for key, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                wide = key % 13 + 1
                frame = images.Frame((np.arange(wide * size * 3) * 7 % 251).astype(np.uint8).reshape(size, wide, 3))
                for kind, to, back in (("png", images.encode_png, images.decode_png), ("bmp", images.encode_bmp, images.decode_bmp)):
                    got = back(to(frame))
                    out.append((key, kind, *got.size[:2], int(got.samples.ravel()[0]), int(got.samples.ravel()[-1]), round(images.alike(frame, got), 9) if compared else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()))], ["p_partkey", "format", "width", "height", "first", "last", "alike"])

    return _parts(spark, sf_dir, "p_size").mapInArrow(run, "p_partkey long, format string, width int, height int, first int, last int, alike double")


def _straight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a ramp drawn askew, straightened: (p_partkey, off), the largest difference from the ramp."""
    def run(batches):
        for batch in batches:
            off = []
            for size in batch.column(1).to_pylist():
                wide = size + 8
                drawn = images.Frame((np.add.outer(2 * np.arange(80), np.arange(80)) % 256).astype(np.uint8)[..., None])
                got = images.straightened(drawn, [(1, 2), (wide, 2), (wide, 12), (1, 12)], wide, 11)
                want = np.add.outer(2 * np.arange(2, 13), np.arange(1, wide + 1)) % 256
                off.append(int(np.abs(got.samples[..., 0].astype(int) - want).max()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(off, pa.int32())], ["p_partkey", "off"])

    return _parts(spark, sf_dir, "p_size").mapInArrow(run, "p_partkey long, off int")


_add("img_perspective", _straight, "SELECT p_partkey, 0 AS off FROM part")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.explode(F.array(F.struct(F.lit(0).alias("seq"), F.lit("heading").alias("kind"), F.concat(F.lit("Document "), F.col("doc_id")).alias("text")), F.struct(F.lit(1).alias("seq"), F.lit("paragraph").alias("kind"), F.col("text")))).alias("b"))
    return t.select("doc_id", "b.*")


_add("aut_document", lambda s, d: pdf.relation(authoring.documents(_blocks(s, d)), "documents").select("doc_id", "page_count"), """
SELECT doc_id, CAST(CASE WHEN n <= 48 THEN 1 ELSE 1 + ceil((n - 48) / 50.0) END AS INT) AS page_count
FROM (SELECT doc_id, len(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '.{1,90}(?:\\s|$)|\\S{90}'), lambda x: rtrim(x, ' ')), lambda x: x <> '')) AS n FROM documents)""".replace("\\\\", "\\"))
_SIZES = "FROM (SELECT p_partkey, CAST(p_partkey % 13 + 1 AS INT) AS width, p_size AS height FROM part), (VALUES ('png'), ('bmp')) v(format)"
_add("src_image_decode", lambda s, d: _pictures(s, d).drop("alike"), f"SELECT p_partkey, format, width, height, 0 AS first, CAST((CAST(width AS BIGINT) * height * 3 - 1) * 7 % 251 AS INT) AS last {_SIZES}")
_add("sink_image_encode", lambda s, d: _pictures(s, d).groupBy("format").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("width") * F.col("height")).alias("pixels")), f"SELECT format, count(*) AS n, CAST(sum(width * height) AS BIGINT) AS pixels {_SIZES} GROUP BY format")
_add("fn_ssim", lambda s, d: _pictures(s, d, True).select("p_partkey", "format", "alike"), f"SELECT p_partkey, format, 1.0::DOUBLE AS alike {_SIZES}")


def _fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's name set in a font program made for it, whose glyphs are its characters in order and as wide as their code and 300: (p_partkey, glyphs, width, family)."""
    def run(batches):
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes = sorted(set(map(ord, text or "")))
                face = fonts.read(fonts.build({c: k + 1 for k, c in enumerate(codes)}, [500, *(300 + c for c in codes)], 2000, f"Part {key}"))
                out.append((key, len(face.glyphs), face.width(text or ""), face.names[1]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.float64(), pa.string()))], ["p_partkey", "glyphs", "width", "family"])

    return _parts(spark, sf_dir, "p_name").mapInArrow(run, "p_partkey long, glyphs int, width double, family string")


_add("src_font_programs", _fonts, "SELECT p_partkey, CAST(len(list_distinct(string_split(p_name, ''))) AS INT) AS glyphs, CAST(list_sum(list_transform(string_split(p_name, ''), lambda c: 300 + unicode(c))) AS DOUBLE) / 2 AS width, 'Part ' || p_partkey AS family FROM part")


def _image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a picture on a page of its own: (doc_id, content)."""
    schema = pa.schema([("doc_id", pa.int64()), ("content", pa.binary())])

    def run(batches):
        for batch in batches:
            made = ((key, writer.image_document([images.Frame(np.full((size, key % 13 + 1, 3), key % 256, np.uint8))], 36.0)) for key, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            yield from pdf.in_batches(made, schema)

    return _parts(spark, sf_dir, "p_size").mapInArrow(run, "doc_id long, content binary")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = pdf.relations(_image_files(spark, sf_dir), ["doc_pages", "ops"])
    box, place = F.col("doc_pages.media_box"), F.struct(*[f"ops.{c}" for c in ("x0", "y0", "x1", "y1")])
    pages = both.where("doc_pages IS NOT NULL OR ops.kind = 'image'").groupBy("doc_id", F.coalesce("doc_pages.page_index", "ops.page_index").alias("page_index"))
    placed = pages.agg(F.collect_list(F.when(F.col("ops").isNotNull(), place)).alias("p"), F.max(F.struct(F.element_at(box, 3).alias("width"), F.element_at(box, 4).alias("height"))).alias("s"))
    return placed.select("doc_id", "page_index", F.explode("p").alias("p"), "s").select("doc_id", "page_index", "p.*", "s.*")


_add("sink_image_to_pdf", _placed, "SELECT p_partkey AS doc_id, 0 AS page_index, 36.0::DOUBLE AS x0, 36.0::DOUBLE AS y0, 36.0::DOUBLE + p_partkey % 13 + 1 AS x1, 36.0::DOUBLE + p_size AS y1, 72.0::DOUBLE + p_partkey % 13 + 1 AS width, 72.0::DOUBLE + p_size AS height FROM part")
