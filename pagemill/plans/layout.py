"""Queries of what lies where on pages: stamps over content, crops, regions and what they touch, garbage; on the painted things and objects of whole tables' files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import geometry as geo
from pagemill.operators import objects, pages
from pagemill.plans import casebook, structure
from pagemill.sources import pdf

QUERIES: dict = {}
ORACLES: dict = {}
_O = f"{casebook._P.rstrip()}, {casebook._OPS}"


def _add(name: str, run, sql: str) -> None:
    QUERIES[name] = run
    ORACLES[name] = sql


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.relation(casebook.cases(spark, sf_dir), "ops")


def _content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Painted things as content rows; the second of a page is a draft's stamp."""
    return _ops(spark, sf_dir).select("doc_id", "page_index", F.col("seq").alias("z"), F.col("op").alias("payload"), F.when(F.col("seq") == 1, "draft").alias("stamp"))


def _stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stamps on every even page, and one on a page that no document has."""
    p = structure._pages(spark, sf_dir)
    two = p.where("page_index % 2 = 0").select("doc_id", "page_index", F.explode(F.array(F.concat(F.lit("a "), F.col("page_index")), F.lit("b"))).alias("payload"))
    return two.unionByName(p.where("page_index = 0").select("doc_id", F.lit(10_000).alias("page_index"), F.lit("lone").alias("payload")))


_C = f"{_O}, c AS (SELECT doc_id, k, seq AS z, op AS payload FROM o), s AS (SELECT doc_id, k, unnest(['a ' || k, 'b']) AS payload FROM p WHERE k % 2 = 0 UNION ALL SELECT doc_id, 10000, 'lone' FROM d), e AS (SELECT doc_id, k, max(z) AS top, min(z) AS low FROM c GROUP BY ALL)"
_add("set_overlay", lambda s, d: pages.overlay(_content(s, d).drop("stamp"), _stamps(s, d)), f"{_C} SELECT doc_id, k AS page_index, z, payload FROM c UNION ALL SELECT s.doc_id, s.k, CAST(coalesce(top, 0) + row_number() OVER (PARTITION BY s.doc_id, s.k ORDER BY payload) AS INT), payload FROM s LEFT JOIN e USING (doc_id, k)")
_add("set_compose", lambda s, d: pages.overlay(_content(s, d).drop("stamp"), _stamps(s, d), below=True), f"{_C} SELECT doc_id, k AS page_index, z, payload FROM c UNION ALL SELECT s.doc_id, s.k, CAST(coalesce(low, 0) - count(*) OVER (PARTITION BY s.doc_id, s.k) - 1 + row_number() OVER (PARTITION BY s.doc_id, s.k ORDER BY payload) AS INT), payload FROM s LEFT JOIN e USING (doc_id, k)")
_add("set_stamp_remove", lambda s, d: pages.remove_stamp(_content(s, d), "draft").select("doc_id", "page_index", "z", "payload"), f"{_O} SELECT doc_id, k AS page_index, seq AS z, op AS payload FROM o WHERE seq <> 1")


def _flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that are to be seen, drawn over what their page has."""
    both = pdf.relations(casebook.cases(spark, sf_dir), ["ops", "annotations"])
    note = F.col("annotations")
    drawn = F.concat_ws(":", F.lpad(note["ordinal"].cast("string"), 9, "0"), note["subtype"])
    rows = both.select("doc_id", F.coalesce("ops.page_index", "annotations.page_index").alias("page_index"), F.col("ops.seq").alias("z"), F.coalesce("ops.op", drawn).alias("payload"), note.isNotNull().alias("stamped"), F.coalesce(note["flags"], F.lit(0)).alias("flags"))
    return pages.overlaid(structure.annotation_mode(rows, "view").drop("flags"))


_add("set_flatten_annots", _flattened, f"{_C}, {casebook._NOTES} SELECT doc_id, k AS page_index, z, payload FROM c UNION ALL SELECT a.doc_id, a.k, CAST(top + row_number() OVER (PARTITION BY a.doc_id, a.k ORDER BY ordinal) AS INT), '00000000' || ordinal || ':' || subtype FROM a JOIN e USING (doc_id, k) WHERE flags & 34 = 0")


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = pdf.relation(casebook.cases(spark, sf_dir), "doc_pages")
    return t.select("doc_id", "page_index", *[F.element_at("crop_box", k + 1).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))], "rotate")


def _crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two of three pages are asked to be cut to: within the page, or beside it."""
    p = structure._pages(spark, sf_dir).where("page_index % 3 < 2")
    off = F.when(F.col("page_index") % 3 == 1, 1000.0).otherwise(0.0)
    return p.select("doc_id", "page_index", (off + 50 + F.col("page_index")).alias("x1"), F.lit(-5.0).alias("y1"), (off + 900.0).alias("x2"), F.lit(400.0).alias("y2"))


_add("set_crop", lambda s, d: pages.crop(_boxes(s, d), _crops(s, d)), f"{casebook._P} SELECT doc_id, k AS page_index, 0 AS rotate, CASE WHEN k % 3 = 0 THEN 50.0::DOUBLE + k ELSE 0 END AS x1, 0.0::DOUBLE AS y1, 600.0::DOUBLE AS x2, CASE WHEN k % 3 = 0 THEN 400.0::DOUBLE ELSE 800 END AS y2 FROM p")


def _fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, turned by a quarter each after the last, placed in a box of 300 by 400."""
    b = _boxes(spark, sf_dir).withColumn("rotate", F.col("page_index") % 4 * 90)
    m = geo.place_page([F.col(c) for c in ("x1", "y1", "x2", "y2")], F.col("rotate"), [F.lit(0.0), F.lit(0.0), F.lit(300.0), F.lit(400.0)])
    return b.select("doc_id", "page_index", *[m[k].alias(k) for k in "ad"])


_add("fn_fit_page", _fitted, f"{casebook._P} SELECT doc_id, k AS page_index, [0.5, 0, -0.5, 0][k % 4 + 1]::DOUBLE AS a, [0.5, 0, -0.5, 0][k % 4 + 1]::DOUBLE AS d FROM p")


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Painted things as fragments: their operators for a text."""
    return _ops(spark, sf_dir).select("doc_id", "page_index", F.col("seq").alias("frag_index"), F.col("op").alias("text"), F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region on every page but each third: over the rectangle's left edge, with a replacement, or over the word."""
    p = structure._pages(spark, sf_dir).where("page_index % 3 < 2")
    first = F.col("page_index") % 3 == 0
    return p.select("doc_id", "page_index", F.lit(40.0).alias("x"), F.when(first, 55.0).otherwise(740.0).alias("y"), F.lit(200.0).alias("w"), F.lit(50.0).alias("h"), F.when(first, "[gone]").alias("replacement"))


_HIT = "f.x0 < r.x + r.w AND f.x1 > r.x AND f.y0 < r.y + r.h AND f.y1 > r.y"
_R = f"{_O}, r AS (SELECT doc_id, k, 40 AS x, CASE WHEN k % 3 = 0 THEN 55 ELSE 740 END AS y, 200 AS w, 50 AS h, CASE WHEN k % 3 = 0 THEN '[gone]' END AS replacement FROM p WHERE k % 3 < 2), h AS (SELECT f.*, r.x, r.w, r.replacement FROM o f JOIN r ON f.doc_id = r.doc_id AND f.k = r.k AND {_HIT})"


def _touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.overlaps(_pieces(spark, sf_dir), _regions(spark, sf_dir))


def _replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _touched(spark, sf_dir).select("doc_id", "page_index", "frag_index", F.coalesce("replacement", F.lit("")).alias("_new"))
    return _pieces(spark, sf_dir).join(new, ["doc_id", "page_index", "frag_index"], "left").select("doc_id", "page_index", "frag_index", F.coalesce("_new", "text").alias("text"))


_add("join_region", lambda s, d: _touched(s, d).select("doc_id", "page_index", "frag_index", "text"), f"{_R} SELECT doc_id, k AS page_index, seq AS frag_index, op AS text FROM h")
_add("red_verify", lambda s, d: _touched(s, d).groupBy("doc_id", "page_index").agg(F.count(F.lit(1)).alias("survivors")), f"{_R} SELECT doc_id, k AS page_index, count(*) AS survivors FROM h GROUP BY ALL")
_add("red_replace", _replaced, f"{_R} SELECT o.doc_id, o.k AS page_index, o.seq AS frag_index, CASE WHEN h.doc_id IS NULL THEN o.op ELSE coalesce(h.replacement, '') END AS text FROM o LEFT JOIN h ON o.doc_id = h.doc_id AND o.k = h.k AND o.seq = h.seq")
_add("flt_extract_within", lambda s, d: _touched(s, d).where((F.col("x") >= F.col("rx")) & (F.col("x") + F.col("width") <= F.col("rx") + F.col("w"))).select("doc_id", "page_index", "frag_index", "text"), f"{_R} SELECT doc_id, k AS page_index, seq AS frag_index, op AS text FROM h WHERE x0 >= x AND x1 <= x + w")


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = _regions(spark, sf_dir).select("doc_id", "page_index", F.col("x").alias("rx"), F.col("y").alias("ry"), "w", "h")
    return _pieces(spark, sf_dir).join(views, ["doc_id", "page_index"]).where(geo.rect_contains(F.col("x"), F.col("y"), F.col("rx"), F.col("ry"), F.col("w"), F.col("h"))).select("doc_id", "page_index", "frag_index")


_add("flt_viewport", _seen, f"{_R} SELECT o.doc_id, o.k AS page_index, o.seq AS frag_index FROM o JOIN r ON o.doc_id = r.doc_id AND o.k = r.k AND o.x0 BETWEEN r.x AND r.x + r.w AND o.y0 BETWEEN r.y AND r.y + r.h")


def _garbage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that neither the catalog nor the information leads to."""
    rows = objects.settled(pdf.relation(casebook.cases(spark, sf_dir), "objects"))
    value = F.col("value")
    roots = rows.where((F.get_json_object(value, "$.Type") == "/Catalog") | F.get_json_object(value, "$.Title").isNotNull()).select("doc_id", "obj_no")
    edges = rows.select("doc_id", F.col("obj_no").alias("src"), F.explode("refs").alias("dst"))
    return objects.garbage(rows.select("doc_id", "obj_no"), edges, roots)


_add("agg_gc", _garbage, f"{casebook._P} SELECT doc_id, 1 AS obj_no FROM d WHERE doc_id % 2 = 0")
