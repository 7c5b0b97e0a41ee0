"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.llm.common import free_name, running_total, stage, without

WORD = r"[^\x20\x09-\x0D]+"
KEY_BITS = 60
#: Slices of a source's shuffled order, and of the queue's virtual time, whose sums are added up before rows are looked at.
COARSE_BITS, FINE_BITS, TIME_SLICES = 8, 18, 16384
OUT = ["size", "source_size", "target", "copies"]


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(id_col: Column, seed: str) -> Column:
    """60 bits that look random, the same in every run: MD5 of the seed and the id."""
    text = F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Adds rank, weight and target to sources (column source and size): shares of all sizes by weight, filled up to `most` times a source's size.

    Sources are ranked by code point, null last, and weigh weights[0], weights[1], ... in turn. Sorted by the share at
    which each is full, the first source that the rest of the budget doesn't fill decides the level of all after it.
    One row a source: the sources, not the documents, are sorted in one task.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    cap = (F.col("size") * most).cast("double")
    t = ranked.withColumn("weight", weight).withColumn("cap", cap).withColumn("full", F.col("cap") / F.col("weight"))
    by = Window.orderBy("full", "rank")
    everything = Window.partitionBy()
    t = t.withColumn("_all", F.sum("size").over(everything).cast("double"))
    t = t.withColumn("_above", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("_rest", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("_level", (F.col("_all") - F.col("_above")) / F.col("_rest"))
    t = t.withColumn("_at", F.min(F.when(F.col("_level") * F.col("weight") <= F.col("cap"), F.struct("full", "rank", "_level"))).over(everything))
    here = F.struct("full", "rank") < F.struct("_at.full", "_at.rank")
    t = t.withColumn("target", F.when(F.coalesce(here, F.lit(False)), F.col("cap")).otherwise(F.coalesce(F.col("weight") * F.col("_at._level"), F.col("cap"))))
    return t.select("source", "rank", F.col("size").alias("source_size"), "target")


def _slice(finish: Column) -> Column:
    """Slices of virtual time: even up to 2, then even in its logarithm. Never decreases."""
    late = F.floor(F.log2(F.greatest(finish, F.lit(2.0)) / 2) * TIME_SLICES)
    return (F.floor(F.least(finish, F.lit(2.0)) * TIME_SLICES) + late).cast("long")


def plan(docs: DataFrame, id_col: str, source_col: str, size: Column, weights=(5, 2, 1), most: int = 3, seed: str = "") -> DataFrame:
    """How often the mix takes each kind of document: (id, source, size, n, source_size, target, copies), n rows being alike in the first three.

    Every source queues its shuffled documents over and over, up to `most` times; a copy's virtual finish time is the
    source's words up to it over the source's target. All copies in the order of their finish times, up to the total of
    all sizes, are the mix. Words up to a document are sums over slices of the shuffled order; the cut is found from sums
    over slices of virtual time, and only the slice it falls into is sorted.
    """
    slim = stage(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), size.alias("size"))
                 .groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("words", F.col("size") * F.col("n")), "sizes")
    sources = targets(slim.groupBy("source").agg(F.sum("words").alias("size")), weights, most)
    key = shuffle_key(F.col("id"), seed)
    units = slim.withColumn("key", key)
    units = running_total(units, ["source"], ["key", "id", "size"], "words", F.shiftright("key", KEY_BITS - COARSE_BITS), F.shiftright("key", KEY_BITS - FINE_BITS), "upto")
    s = sources.select(F.col("source").alias("_source"), "rank", "source_size", "target")
    units = stage(units.join(s, units["source"].eqNullSafe(s["_source"])).drop("_source"), "units")

    def finish(e: Column) -> Column:
        return F.when(F.col("target") > 0, (e * F.col("source_size") + F.col("upto")).cast("double") / F.col("target")).otherwise(F.lit(0.0))

    copies = units.select("*", F.explode(F.array(*[F.lit(e).cast("long") for e in range(most)])).alias("e"))
    copies = copies.withColumn("finish", finish(F.col("e"))).withColumn("slice", _slice(F.col("finish")))
    place = ["finish", "rank", "key", "id", "size", "e"]
    budget = int(slim.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0])
    sums = copies.groupBy("slice").agg(F.sum("words").alias("words"))
    sums = sums.withColumn("upto", F.sum("words").over(Window.orderBy("slice")))
    over = sums.where(F.col("upto") > budget).agg(F.min(F.struct("slice", "upto", "words")).alias("x")).first()["x"]
    taken = F.lit(most)
    if over is not None:
        left = budget - (over["upto"] - over["words"])
        order = Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)
        fits = copies.where(F.col("slice") == over["slice"]).withColumn("_sum", F.sum("words").over(order)).where(F.col("_sum") <= left)
        last = fits.agg(F.max(F.struct(*place)).alias("x")).first()["x"]
        types = copies.schema
        cut_at = last and F.struct(*[F.lit(last[c]).cast(types[c].dataType).alias(c) for c in place])
        taken = F.lit(0)
        for e in range(most):
            at = finish(F.lit(e).cast("long"))
            mine = F.struct(at.alias("finish"), "rank", "key", "id", "size", F.lit(e).cast("long").alias("e"))
            cut = (_slice(at) < over["slice"]) | ((_slice(at) == over["slice"]) & (mine <= cut_at if last else F.lit(False)))
            taken = taken + F.when(cut, 1).otherwise(0)
    return units.select("id", "source", "size", "n", "source_size", "target", taken.cast("long").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=(5, 2, 1), most: int = 3, seed: str = "") -> DataFrame:
    """The mix itself: each document of docs as many times as it is taken, with the columns of docs.

    Null texts have size 0, a null source is a source (ranked last), repeated rows are taken alike, and an empty table
    mixes to an empty one. Extra columns pass through whatever their names. See plan() for the method.
    """
    size = free_name(docs, "_size")
    sized = docs.withColumn(size, size_of(F.col(f"`{text_col}`")))
    p = plan(docs, id_col, source_col, size_of(F.col(f"`{text_col}`")), weights, most, seed)
    p = p.where("copies > 0").select(F.col("id").alias("_mix_id"), F.col("source").alias("_mix_source"), F.col("size").alias("_mix_size"), F.col("copies").alias("_mix_copies"))
    on = sized[id_col].eqNullSafe(p["_mix_id"]) & sized[source_col].eqNullSafe(p["_mix_source"]) & (sized[size] == p["_mix_size"])
    taken = sized.join(p, on).withColumn("_mix_e", F.explode(F.sequence(F.lit(1), F.col("_mix_copies"))))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns])


def mixed_sizes(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=(5, 2, 1), most: int = 3, seed: str = "") -> DataFrame:
    """One row per row of docs: its id, size, source_size, target and copies."""
    p = plan(docs, id_col, source_col, size_of(F.col(f"`{text_col}`")), weights, most, seed)
    each = p.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return without(each.withColumnRenamed("id", id_col), ["_row", "n", "source"])


def query(spark, sf_dir: str) -> DataFrame:
    out = mixed_sizes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
WITH doc AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS key
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM doc GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM src),
weighed AS (SELECT *, CAST([5, 2, 1][(rank - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(source_size * 3 AS DOUBLE) AS cap FROM ranked),
level AS (
  SELECT *, cap / weight AS fill, CAST((SELECT sum(source_size) FROM src) AS DOUBLE) AS total FROM weighed),
filled AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY fill, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY fill, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam FROM level),
lev AS (SELECT fill, rank, lam FROM filled WHERE lam * weight <= cap ORDER BY fill, rank LIMIT 1),
goal AS (
  SELECT f.source, f.rank, f.source_size, CASE WHEN (f.fill, f.rank) < (a.fill, a.rank) THEN f.cap ELSE f.weight * a.lam END AS target
  FROM filled f, lev a),
queue AS (
  SELECT d.*, g.rank, g.source_size, g.target,
    sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    row_number() OVER () AS r
  FROM doc d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source),
copy AS (
  SELECT *, CASE WHEN target > 0 THEN CAST(e * source_size + upto AS DOUBLE) / target ELSE 0 END AS finish
  FROM (SELECT *, unnest([0, 1, 2]) AS e FROM queue)),
run AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, key, doc_id, size, e RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sofar FROM copy)
SELECT doc_id, size, source_size, target, CAST(size * count(*) FILTER (WHERE sofar <= (SELECT sum(size) FROM doc)) AS BIGINT) AS taken
FROM run GROUP BY r, doc_id, size, source_size, target
"""
