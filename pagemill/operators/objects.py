"""Objects, references and their index: merging revisions, resolving, deduplicating, reachability, renumbering."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


_own: dict[str, str] = {}


def settled(df: DataFrame) -> DataFrame:
    """df written to the folder in spark.checkpoint.dir (a temporary one where that is unset, on one machine alone) and read back: loops cut their lineage here."""
    spark = df.sparkSession
    try:
        top = spark.conf.get("spark.checkpoint.dir")
    except Exception:  # an unset key without a default raises
        top = None
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="pagemill-"))
    path = f"{top.rstrip('/')}/pagemill/loop-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys into as many tasks as a shuffle has (four a core at least), however few files, row groups or bytes its rows come from: for rows that are small but take Python long."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def merge_index(xref: DataFrame) -> DataFrame:
    """The entry that counts for each (doc, object): the newest revision's, its hybrid section before its table; free entries shadow older ones.

    One grouped maximum, combined before the shuffle.
    """
    rank = F.struct("revision", F.col("is_xrefstm").cast("int"))
    rest = F.struct(*[c for c in xref.columns if c not in ("doc_id", "obj_no")])
    return xref.groupBy("doc_id", "obj_no").agg(F.max_by(rest, rank).alias("_e")).select("doc_id", "obj_no", "_e.*")


def live(merged: DataFrame) -> DataFrame:
    return merged.where("kind <> 'free'")


def resolve(rows: DataFrame, objects: DataFrame, keys: list[str], wanted: list[str]) -> DataFrame:
    """Dereferences by equal keys, one hop: rows without a target get nulls, as an unknown reference reads null."""
    return rows.join(objects.select(*keys, *wanted), keys, "left")


def fill_form(fields: DataFrame, values: DataFrame, key: str = "name") -> tuple[DataFrame, DataFrame]:
    """(fields with their new value, values of unknown names). Of fields that share a name the last (by ordinal) takes the value; buttons take none; "" clears."""
    leaf = fields.where(F.coalesce(F.col("type") != "button", F.lit(True)))
    last = leaf.groupBy("doc_id", key).agg(F.max("ordinal").alias("ordinal"))
    chosen = last.join(values.select("doc_id", key, F.col("value").alias("_new"), F.lit(True).alias("_set")), ["doc_id", key])
    out = fields.join(chosen, ["doc_id", key, "ordinal"], "left").withColumn("value", F.when(F.col("_set"), F.col("_new")).otherwise(F.col("value"))).drop("_new", "_set")
    return out, values.join(last.select("doc_id", key), ["doc_id", key], "left_anti")


def first_page_of(pages_annots: DataFrame, widgets: DataFrame) -> DataFrame:
    """Each widget with the first page that lists it (doc_id, page_index, annots array<int>)."""
    listed = pages_annots.select("doc_id", "page_index", F.explode("annots").alias("obj_no")).groupBy("doc_id", "obj_no").agg(F.min("page_index").alias("page_index"))
    return widgets.join(listed, ["doc_id", "obj_no"], "left")


def bind_data(fields: DataFrame, data: DataFrame) -> DataFrame:
    """Template fields (doc_id, ref, name) with data values (doc_id, ordinal, path, value).

    "$record.", "$data." and "$." before a reference go. A value binds by its whole path (the last of equals), else by its
    leaf name: the first of equals, unless some whole path is just that name.
    """
    ref = F.regexp_replace("ref", r"^\$(?:record\.|data\.|\.)", "")
    path = data.groupBy("doc_id", "path").agg(F.max_by("value", "ordinal").alias("_by_path"))
    leaf = data.groupBy("doc_id", F.element_at(F.split("path", r"\."), -1).alias("_leaf")).agg(F.min_by("value", "ordinal").alias("_first"))
    whole = path.select("doc_id", F.col("path").alias("_leaf"), F.col("_by_path").alias("_whole"), F.lit(True).alias("_has"))
    leaf = leaf.join(whole, ["doc_id", "_leaf"], "left").select("doc_id", "_leaf", F.when(F.col("_has"), F.col("_whole")).otherwise(F.col("_first")).alias("_by_leaf"), F.lit(True).alias("_found"))
    out = fields.withColumn("_path", ref).join(path.select("doc_id", F.col("path").alias("_path"), "_by_path", F.lit(True).alias("_hit")), ["doc_id", "_path"], "left")
    out = out.withColumn("_leaf", F.coalesce("name", F.element_at(F.split("_path", r"\."), -1))).join(leaf, ["doc_id", "_leaf"], "left")
    return out.withColumn("value", F.when(F.col("_hit"), F.col("_by_path")).otherwise(F.col("_by_leaf"))).drop("_path", "_leaf", "_by_path", "_hit", "_by_leaf", "_found")


def named_targets(outline: DataFrame, names: DataFrame) -> DataFrame:
    """Bookmarks with the page their destination name stands for; -1 without one."""
    return outline.join(names.select("doc_id", "dest", F.col("page_index").alias("_p")), ["doc_id", "dest"], "left").withColumn("page_index", F.coalesce("_p", F.lit(-1))).drop("_p")


def tag_ranks(fragments: DataFrame, ranks: DataFrame, least: float = 0.8) -> DataFrame:
    """Fragments with the reading rank of their mark; a page whose ranked fragments hold under `least` of its (trimmed) characters has none."""
    page = Window.partitionBy("doc_id", "page_index")
    out = fragments.join(ranks.select("doc_id", "page_index", "mcid", F.col("rank").alias("_rank")), ["doc_id", "page_index", "mcid"], "left")
    n = F.length(F.trim("text"))
    share = F.sum(F.when(F.col("_rank").isNotNull(), n).otherwise(0)).over(page) / F.sum(n).over(page)
    return out.withColumn("_share", share).withColumn("rank", F.when(F.col("_share") >= least, F.col("_rank"))).drop("_rank", "_share")


def content_key(value: Column) -> Column:
    """The key under which equal contents meet: SHA-256 of the canonical bytes, with their length before them."""
    return F.sha2(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), 256)


def dedup_once(rows: DataFrame, key: Column, ordinal: str, group: list[str] | None = None) -> DataFrame:
    """Adds keeper: the smallest ordinal with the same content. One hash aggregate and one join; no group is sorted."""
    by = group or []
    first = rows.groupBy(*by, key.alias("_k")).agg(F.min(ordinal).alias("keeper"))
    return rows.withColumn("_k", key).join(first, [*by, "_k"]).drop("_k")


def dedup_objects(objects: DataFrame, most: int = 100) -> DataFrame:
    """Merges equal objects until nothing changes: (doc_id, obj_no, value, refs array<int>, keeper).

    Two objects are equal if their value is and their references, read through the keepers found so far, are. Merging
    makes further objects equal, so it is done again until no keeper moves; each round's table is written, not recomputed.
    """
    now = settled(objects.select("doc_id", "obj_no", "value", "refs", F.col("obj_no").alias("keeper")))
    for _ in range(most):
        to = now.select("doc_id", F.col("obj_no").alias("_ref"), F.col("keeper").alias("_to"))
        refs = now.select("doc_id", "obj_no", F.posexplode("refs").alias("_i", "_ref")).join(to, ["doc_id", "_ref"], "left").groupBy("doc_id", "obj_no").agg(F.array_sort(F.collect_list(F.struct("_i", F.coalesce("_to", "_ref")))).cast("string").alias("_refs"))
        seen = now.drop("keeper").join(refs, ["doc_id", "obj_no"], "left")
        key = content_key(F.concat_ws("|", F.coalesce("value", F.lit("\x00")), F.coalesce("_refs", F.lit(""))))
        after = settled(dedup_once(seen, key, "obj_no", ["doc_id"]).select("doc_id", "obj_no", "value", "refs", "keeper"))
        moved = after.join(now.select("doc_id", "obj_no", F.col("keeper").alias("_was")), ["doc_id", "obj_no"]).where("keeper <> _was").isEmpty()
        now = after
        if moved:
            return now
    raise RuntimeError(f"not settled in {most} rounds")


def reachable(edges: DataFrame, roots: DataFrame, most: int = 64) -> DataFrame:
    """(doc_id, obj_no) that roots lead to over (doc_id, src, dst).

    Each round joins only what the last one found, and found rows are written once. After every fourth round objects
    with a single reference get one that leads twice as far as their last one, so that a chain of n objects takes about
    4 log2(n) rounds and no more than n log2(n) references; `most` counts those doublings.
    """
    fronts = [settled(roots.select("doc_id", "obj_no").distinct())]
    edges, jumps = edges.select("doc_id", "src", "dst").where("src <> dst"), None
    for n in range(1, most * 4):
        step = fronts[-1].select("doc_id", F.col("obj_no").alias("src")).join(edges, ["doc_id", "src"]).select("doc_id", F.col("dst").alias("obj_no")).distinct()
        found = _united(fronts)
        front = settled(step.join(found, ["doc_id", "obj_no"], "left_anti"))
        if front.isEmpty():
            return found
        fronts.append(front)
        if n % 4 == 0:
            if jumps is None:
                single = edges.distinct().groupBy("doc_id", "src").agg(F.min("dst").alias("dst"), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
                jumps = settled(single)
            on = jumps.select("doc_id", F.col("src").alias("dst"), F.col("dst").alias("_on"))
            jumps = settled(jumps.join(on, ["doc_id", "dst"]).select("doc_id", "src", F.col("_on").alias("dst")).where("src <> dst"))
            edges = edges.unionByName(jumps)
            fronts = [settled(_united(fronts[:-1])), front]
    raise RuntimeError(f"not closed in {most * 4} rounds")


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def garbage(objects: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Objects that no root leads to."""
    return objects.join(reachable(edges, roots), ["doc_id", "obj_no"], "left_anti")


def numbered(rows: DataFrame, group: str, order: str, out: str) -> DataFrame:
    """Adds out: 1 to n in each group by order, which must be unique in it. A group of any size is dealt to slices by ranges, numbered slice by slice."""
    sliced = settled(rows.repartitionByRange(F.col(group), F.col(order)).withColumn("_slice", F.spark_partition_id()))
    counts = sliced.groupBy(group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(group, "_slice").orderBy(order))
    return sliced.withColumn(out, within).join(counts, [group, "_slice"]).withColumn(out, (F.col(out) + F.col("_before")).cast("int")).drop("_slice", "_before")


def densify(objects: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects numbered 1 to n per document in their order (adds new_no), and references in the new numbers; a reference to nothing goes to 0."""
    dense = numbered(objects, "doc_id", "obj_no", "new_no")
    to = settled(dense.select("doc_id", "obj_no", "new_no"))
    out = edges.join(to.withColumnsRenamed({"obj_no": "src", "new_no": "new_src"}), ["doc_id", "src"]).join(to.withColumnsRenamed({"obj_no": "dst", "new_no": "new_dst"}), ["doc_id", "dst"], "left")
    return dense, out.select("doc_id", F.col("new_src").alias("src"), F.coalesce("new_dst", F.lit(0)).alias("dst"))


def compression_report(objects: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Per document: objects, unreachable ones, duplicates among the rest, and what is left."""
    kept = objects.join(reachable(edges, roots), ["doc_id", "obj_no"])
    refs = edges.groupBy("doc_id", F.col("src").alias("obj_no")).agg(F.sort_array(F.collect_list(F.col("dst").cast("int"))).alias("refs"))
    merged = dedup_objects(kept.join(refs, ["doc_id", "obj_no"], "left").select("doc_id", "obj_no", "value", F.coalesce("refs", F.array().cast("array<int>")).alias("refs")))
    after = merged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("reachable"), F.count_if(F.col("keeper") == F.col("obj_no")).alias("kept"))
    return objects.groupBy("doc_id").agg(F.count(F.lit(1)).alias("objects")).join(after, "doc_id", "left").select("doc_id", "objects", (F.col("objects") - F.coalesce("reachable", F.lit(0))).alias("unreachable"), (F.coalesce("reachable", F.lit(0)) - F.coalesce("kept", F.lit(0))).alias("duplicates"), F.coalesce("kept", F.lit(0)).alias("kept"))


def upper_median(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """sorted[n div 2] of each group: the upper of the two middle values, never a mean of them. Two counts and a filter; no array of a group."""
    w = Window.partitionBy(*group).orderBy(value)
    ranked = rows.select(*group, value, F.row_number().over(w).alias("_r"), F.count(F.lit(1)).over(Window.partitionBy(*group)).alias("_n"))
    return ranked.where(F.col("_r") == F.floor(F.col("_n") / 2) + 1).select(*group, F.col(value).alias("median"))
