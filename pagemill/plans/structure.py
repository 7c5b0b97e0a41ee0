"""Queries of page sequences, objects, trees and joins, over the driver's tables read as documents.

conversations stand in for paged documents (conv_id the document, turn the page), orders and customers for objects and
references, and rows given here for what the tables have nothing like.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions import numbering as num
from pagemill.operators import objects, pages, trees

QUERIES: dict = {}
ORACLES: dict = {}

_PAGES = "p AS (SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INT) AS page_index, role, length(text) AS n FROM conversations)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    return t.select(F.col("conv_id").alias("doc_id"), at.alias("page_index"), "role", F.length("text").cast("long").alias("n"))


def _add(name: str, run, sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def _over_pages(name: str, run, sql: str) -> None:
    _add(name, lambda spark, sf_dir: run(_pages(spark, sf_dir)), f"WITH {_PAGES} {sql}")


def _rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _sql_rows(schema: str, rows: list[tuple]) -> str:
    """A DuckDB subquery of the same rows."""
    types = {"long": "BIGINT", "int": "INT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    names = [c.split() for c in schema.split(", ")]
    quote = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)
    cast = ", ".join(f"CAST(c{k} AS {types[t]}) AS {n}" for k, (n, t) in enumerate(names))
    return f"(SELECT {cast} FROM (VALUES {body}) v({', '.join(f'c{k}' for k in range(len(names)))}))"


_over_pages("flt_page_range", lambda p: pages.page_range(p, 1, 2), "SELECT doc_id, CAST(page_index - 1 AS INT) AS page_index, role, n FROM p WHERE page_index BETWEEN 1 AND 2")
_over_pages("flt_page_delete", lambda p: pages.delete_pages(p, [0, 2, 99]), "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_index) - 1 AS INT) AS page_index, role, n FROM p WHERE page_index NOT IN (0, 2, 99)")
_over_pages("flt_rotate", lambda p: pages.rotate_pages(p.withColumn("rotate", (F.col("page_index") % 4 * 90)), 270, [0, 1]), "SELECT *, CAST(CASE WHEN page_index IN (0, 1) THEN (page_index % 4 * 90 + 270) % 360 ELSE page_index % 4 * 90 END AS INT) AS rotate FROM p")
_over_pages("src_page_index", lambda p: p.where("page_index = 3"), "SELECT * FROM p WHERE page_index = 3")
_over_pages("set_split", lambda p: pages.split(p), "SELECT doc_id, 0 AS page_index, role, n, doc_id || '-' || page_index AS part, page_index AS source_page FROM p")
_over_pages("set_merge", lambda p: pages.merge(p, [5, 1, 3], -1), "SELECT CAST(-1 AS BIGINT) AS doc_id, CAST(row_number() OVER (ORDER BY list_position([5, 1, 3], doc_id), page_index) - 1 AS BIGINT) AS page_index, doc_id AS source_doc, page_index AS source_page, role, n FROM p WHERE doc_id IN (5, 1, 3)")
_over_pages("set_outline_rebase", lambda p: pages.rebase_outline(p.where("page_index = 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, -1).otherwise(F.col("page_index")).cast("int").alias("page_index"), "role"), pages.document_offsets(p.withColumn("_at", F.col("doc_id")))), "SELECT doc_id, role, CAST(CASE WHEN doc_id % 3 = 0 THEN -1 ELSE before END AS BIGINT) AS page_index FROM (SELECT *, count(*) OVER (ORDER BY doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p) WHERE page_index = 0")
_PICKS = ("pos int, doc_id long, page_index int", [(0, 2, 1), (1, 1, 0), (2, 2, 1), (3, 7, 0), (4, 1, 1)])
_add("set_assemble", lambda s, d: pages.assemble(_pages(s, d), _rows(s, *_PICKS), -1), f"WITH {_PAGES}, k AS (SELECT * FROM {_sql_rows(*_PICKS)}), f AS (SELECT doc_id, row_number() OVER (ORDER BY min(pos)) - 1 AS copy FROM k GROUP BY doc_id) SELECT CAST(-1 AS BIGINT) AS doc_id, pos AS page_index, k.doc_id AS source_doc, k.page_index AS source_page, CAST(copy AS INT) AS copy, role, n FROM k JOIN p ON p.doc_id = k.doc_id AND p.page_index = k.page_index JOIN f ON f.doc_id = k.doc_id")


def _backwards(p: DataFrame) -> DataFrame:
    return pages.reorder(p, pages.page_counts(p).select("doc_id", F.reverse(F.sequence(F.lit(0), (F.col("page_count") - 1).cast("int"))).alias("order")))


_over_pages("ord_reorder", _backwards, "SELECT doc_id, CAST(count(*) OVER (PARTITION BY doc_id) - 1 - page_index AS INT) AS page_index, role, n FROM p")
_over_pages("ord_nup", lambda p: pages.n_up(p, 2, 3, 842.0, 595.0, 20.0, 10.0), "SELECT *, CAST(page_index // 6 AS BIGINT) AS sheet, CAST(page_index % 6 AS INT) AS slot, 20.0::DOUBLE + (page_index % 3) * ((842.0::DOUBLE - 40 - 20) / 3 + 10) AS x, 575.0::DOUBLE - (page_index % 6 // 3 + 1) * ((595.0::DOUBLE - 40 - 10) / 2) - (page_index % 6 // 3) * 10 AS y, (842.0::DOUBLE - 40 - 20) / 3 AS cell_width, (595.0::DOUBLE - 40 - 10) / 2 AS cell_height FROM p")
_over_pages("ord_booklet", lambda p: pages.booklet(p), "SELECT a.doc_id, a.page_index, a.role, a.n, CAST(b.side AS BIGINT) AS side, b.place FROM (SELECT *, (count(*) OVER (PARTITION BY doc_id) + 3) // 4 * 4 AS padded FROM p) a, LATERAL (SELECT s AS sheet, unnest([2 * s, 2 * s, 2 * s + 1, 2 * s + 1]) AS side, unnest([0, 1, 0, 1]) AS place, unnest([a.padded - 2 * s, 1 + 2 * s, 2 + 2 * s, a.padded - 1 - 2 * s]) AS page FROM range(0, a.padded // 4) r(s)) b WHERE b.page = a.page_index + 1")
_over_pages("ord_bates", lambda p: p.select("doc_id", "page_index", *[num.label(num.page_value(F.col("page_index"), 98, mode), "B-", "-Z", 3).alias(mode) for mode in ("number", "skip", "renumber")]), "SELECT doc_id, page_index, 'B-' || lpad(CAST(98 + page_index AS VARCHAR), CAST(greatest(3, length(CAST(98 + page_index AS VARCHAR))) AS INT), '0') || '-Z' AS number, CASE WHEN page_index > 0 THEN 'B-' || lpad(CAST(98 + page_index AS VARCHAR), CAST(greatest(3, length(CAST(98 + page_index AS VARCHAR))) AS INT), '0') || '-Z' END AS skip, CASE WHEN page_index > 0 THEN 'B-' || lpad(CAST(97 + page_index AS VARCHAR), CAST(greatest(3, length(CAST(97 + page_index AS VARCHAR))) AS INT), '0') || '-Z' END AS renumber FROM p")
_over_pages("ord_paginate", lambda p: pages.paginate(p.withColumn("at", F.col("page_index").cast("long")).withColumn("h", F.lit(30.0)), "doc_id", "at", "h", 100.0).select("doc_id", "at", "page", "y"), "SELECT doc_id, CAST(page_index AS BIGINT) AS at, CAST(page_index // 3 AS INT) AS page, (page_index % 3) * 30.0::DOUBLE AS y FROM p")
_over_pages("aut_table", lambda p: pages.paginate(p.withColumn("at", F.col("page_index").cast("long")).withColumn("h", F.lit(30.0)), "doc_id", "at", "h", 100.0, repeat=40.0).groupBy("doc_id").agg((F.max("page") + 1).alias("pages")), "SELECT doc_id, CAST(CASE WHEN count(*) <= 3 THEN 1 ELSE 1 + ceil((count(*) - 3) / 2.0) END AS INT) AS pages FROM p GROUP BY doc_id")
_over_pages("aut_headerfooter", lambda p: pages.header_footer(p.select("doc_id", "page_index", "role"), {"top-left": F.col("role"), "top-center": F.lit(""), "bottom-right": num.template("{page}/{total}", F.col("page_index") + 1, F.lit(9))}), "SELECT doc_id, page_index, role, 'top-left' AS slot, role AS text FROM p UNION ALL SELECT doc_id, page_index, role, 'bottom-right', CAST(page_index + 1 AS VARCHAR) || '/9' FROM p")
_over_pages("set_pipeline", lambda p: p.transform(lambda x: pages.delete_pages(x, [0])).transform(lambda x: pages.page_range(x, 0, 2)), "SELECT doc_id, CAST(page_index - 1 AS INT) AS page_index, role, n FROM p WHERE page_index BETWEEN 1 AND 2")


# -- objects -----------------------------------------------------------------------------------------------------------


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.lit(1).cast("long").alias("doc_id"), F.col("o_custkey").alias("obj_no"), F.col("o_orderkey").alias("revision"), (F.col("o_orderkey") % 2 == 0).alias("is_xrefstm"), F.when(F.col("o_orderstatus") == "F", "free").otherwise("offset").alias("kind"))
    return objects.merge_index(o)


_INDEX = "SELECT CAST(1 AS BIGINT) AS doc_id, o_custkey AS obj_no, o_orderkey AS revision, o_orderkey % 2 = 0 AS is_xrefstm, CASE WHEN o_orderstatus = 'F' THEN 'free' ELSE 'offset' END AS kind FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1"
_add("src_xref_merge", _latest, _INDEX)
_add("sink_incremental", lambda s, d: objects.live(_latest(s, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n")), f"SELECT kind, count(*) AS n FROM ({_INDEX}) WHERE kind <> 'free' GROUP BY kind")
_add("join_resolve", lambda s, d: objects.resolve(s.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") + 5).alias("o_orderkey"), "l_partkey"), s.read.parquet(f"{d}/orders.parquet"), ["o_orderkey"], ["o_custkey"]), "SELECT l_orderkey + 5 AS o_orderkey, l_partkey, o_custkey FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey + 5")


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    fields = c.select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("n"), F.col("c_custkey") % 500).alias("name"), F.col("c_custkey").alias("ordinal"), F.when(F.col("c_custkey") % 7 == 0, "button").otherwise("text").alias("type"), F.lit("old").alias("value"))
    values = c.select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("n"), F.col("c_custkey")).alias("name"), F.col("c_mktsegment").alias("value"))
    return objects.fill_form(fields, values)[0]


_add("join_form_fill", _filled, "WITH f AS (SELECT 'n' || c_custkey % 500 AS name, c_custkey AS ordinal, CASE WHEN c_custkey % 7 = 0 THEN 'button' ELSE 'text' END AS type FROM customer), l AS (SELECT name, max(ordinal) AS ordinal FROM f WHERE type <> 'button' GROUP BY name) SELECT CAST(1 AS BIGINT) AS doc_id, f.name, f.ordinal, type, coalesce(v.c_mktsegment, 'old') AS value FROM f LEFT JOIN l ON l.name = f.name AND l.ordinal = f.ordinal LEFT JOIN customer v ON l.name = 'n' || v.c_custkey AND v.c_custkey <= 600")
_add("join_form_unknown", lambda s, d: objects.fill_form(_rows(s, "doc_id long, name string, ordinal int, type string, value string", [(1, "a", 0, "text", ""), (1, "b", 1, "button", "")]), _rows(s, "doc_id long, name string, value string", [(1, "a", "x"), (1, "b", "y"), (1, "c", "z")]))[1], "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'b', 'y'), (1, 'c', 'z')) v(doc_id, name, value)")
_DATA = ("doc_id long, ordinal int, path string, value string", [(1, 0, "form.a", "1"), (1, 1, "form.a", "2"), (1, 2, "x.b", "3"), (1, 3, "y.b", "4"), (1, 4, "c", "5"), (1, 5, "z.c", "6")])
_FIELDS = ("doc_id long, ref string, name string", [(1, "$record.form.a", "a"), (1, "$.b", "b"), (1, "q.c", "c"), (1, "none", "none")])
_add("join_xfa_data", lambda s, d: objects.bind_data(_rows(s, *_FIELDS), _rows(s, *_DATA)), "SELECT * FROM (VALUES (CAST(1 AS BIGINT), '$record.form.a', 'a', '2'), (1, '$.b', 'b', '3'), (1, 'q.c', 'c', '5'), (1, 'none', 'none', NULL)) v(doc_id, ref, name, value)")
_add("join_outline_dest", lambda s, d: objects.named_targets(_rows(s, "doc_id long, dest string, title string", [(1, "a", "A"), (1, "zz", "Z")]), _rows(s, "doc_id long, dest string, page_index int", [(1, "a", 3)])), "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a', 'A', 3), (1, 'zz', 'Z', -1)) v(doc_id, dest, title, page_index)")
_add("join_tag_rank", lambda s, d: objects.tag_ranks(_rows(s, "doc_id long, page_index int, frag_index int, text string, mcid int", [(1, 0, 0, "aaaa", 1), (1, 0, 1, "bbbb", 2), (1, 0, 2, "c", None), (1, 1, 0, "dd", 1), (1, 1, 1, "ee", None)]), _rows(s, "doc_id long, page_index int, mcid int, rank int", [(1, 0, 1, 7), (1, 0, 2, 3), (1, 1, 1, 1)])).select("doc_id", "page_index", "frag_index", "rank"), "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 0, 0, 7), (1, 0, 1, 3), (1, 0, 2, NULL), (1, 1, 0, NULL), (1, 1, 1, NULL)) v(doc_id, page_index, frag_index, rank)")


def overlaps(frags: DataFrame, rects: DataFrame) -> DataFrame:
    """Fragments and the rectangles that they touch: a range condition within equal pages."""
    r = rects.select("doc_id", "page_index", F.col("x").alias("rx"), F.col("y").alias("ry"), "w", "h", "replacement")
    hit = (F.col("x") < F.col("rx") + F.col("w")) & (F.col("x") + F.col("width") > F.col("rx")) & (F.col("y") < F.col("ry") + F.col("h")) & (F.col("y") + F.col("height") > F.col("ry"))
    return frags.join(r, ["doc_id", "page_index"]).where(hit)


_CMAP = ("code int, unicode string", [(104, "H"), (105, "I"), (32, " ")])
_add("join_cmap", lambda s, d: _rows(s, "doc_id long, codes array<int>", [(1, [104, 105]), (2, [105, 999])]).select("doc_id", F.posexplode("codes").alias("i", "code")).join(F.broadcast(_rows(s, *_CMAP)), "code", "left").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("unicode", F.lit("?")).alias("u")))), lambda x: x["u"]), "").alias("text")), "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'HI'), (2, 'I?')) v(doc_id, text)")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


_add("agg_dedup", lambda s, d: objects.dedup_once(_texts(s, d), objects.content_key(F.col("text")), "doc_id").select("doc_id", "keeper"), "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keeper FROM documents")
_OBJECTS = ("doc_id long, obj_no int, value string, refs array<int>", [(1, 1, "root", [2, 3]), (1, 2, "x", [4]), (1, 3, "x", [5]), (1, 4, "leaf", []), (1, 5, "leaf", []), (1, 6, "lost", [7]), (1, 7, "lost2", [6]), (2, 1, "root", [2]), (2, 2, "leaf", [])])
_EDGES = [(1, 1, 2), (1, 1, 3), (1, 2, 4), (1, 3, 5), (1, 6, 7), (1, 7, 6), (2, 1, 2)]
_add("agg_dedup_fixpoint", lambda s, d: objects.dedup_objects(_rows(s, *_OBJECTS)).select("doc_id", "obj_no", "keeper"), "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 1, 1), (1, 2, 2), (1, 3, 2), (1, 4, 4), (1, 5, 4), (1, 6, 6), (1, 7, 7), (2, 1, 1), (2, 2, 2)) v(doc_id, obj_no, keeper)")
_add("agg_compress", lambda s, d: objects.compression_report(_rows(s, *_OBJECTS).select("doc_id", "obj_no", "value"), _rows(s, "doc_id long, src int, dst int", _EDGES), _rows(s, "doc_id long, obj_no int", [(1, 1), (2, 1)])), "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(7 AS BIGINT), CAST(2 AS BIGINT), CAST(2 AS BIGINT), CAST(3 AS BIGINT)), (2, 2, 0, 0, 2)) v(doc_id, objects, unreachable, duplicates, kept)")


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus <> 'F'").select((F.col("o_custkey") % 10).alias("doc_id"), F.col("o_orderkey").alias("obj_no"))
    e = o.select("doc_id", F.col("obj_no").alias("src"), (F.col("obj_no") + 10).alias("dst"))
    return objects.densify(o, e)[1]


_add("agg_densify", _dense, "WITH o AS (SELECT o_custkey % 10 AS doc_id, o_orderkey AS obj_no, row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus <> 'F') SELECT a.doc_id, CAST(a.k AS INT) AS src, CAST(coalesce(b.k, 0) AS INT) AS dst FROM o a LEFT JOIN o b ON b.doc_id = a.doc_id AND b.obj_no = a.obj_no + 10")
_add("agg_median", lambda s, d: objects.upper_median(s.read.parquet(f"{d}/lineitem.parquet"), ["l_suppkey"], "l_quantity"), "SELECT l_suppkey, l_quantity AS median FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) = count(*) OVER (PARTITION BY l_suppkey) // 2 + 1")


def annotation_mode(annots: DataFrame, mode: str) -> DataFrame:
    """Annotations that a mode shows: "view" not the hidden (2) or no-view (32), "print" those with the print flag (4) that aren't hidden, "forms" the viewed widgets, "none" none."""
    f = F.col("flags")
    seen = (f.bitwiseAND(2) == 0) & (f.bitwiseAND(32) == 0)
    return annots.where({"view": seen, "print": (f.bitwiseAND(4) != 0) & (f.bitwiseAND(2) == 0), "forms": seen & (F.col("subtype") == "Widget"), "none": F.lit(False)}[mode])




def visible_layers(layers: DataFrame, overrides: dict[str, bool], printing: bool = False) -> DataFrame:
    """Adds visible: an override by name, else the print state when printing, else the default."""
    said = F.lit(None).cast("boolean")
    for name, on in overrides.items():
        said = F.when(F.col("name") == name, F.lit(on)).otherwise(said)
    return layers.withColumn("visible", F.coalesce(said, F.col("printed") if printing else F.lit(None).cast("boolean"), F.col("base"), F.lit(True)))



# -- trees -------------------------------------------------------------------------------------------------------------

_NODES = ("doc_id long, node_id int, parent_id int, ordinal int, is_page boolean, rotate int", [(1, 1, None, 0, False, 90), (1, 2, 1, 0, True, None), (1, 3, 1, 1, False, None), (1, 4, 3, 0, True, 180), (1, 5, 3, 1, True, None), (1, 6, 1, 2, True, 0)])
_add("src_page_stream", lambda s, d: trees.page_tree(_rows(s, *_NODES)), "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 0, 2, 90), (1, 1, 4, 180), (1, 2, 5, 90), (1, 3, 6, 0)) v(doc_id, page_index, node_id, rotate)")
