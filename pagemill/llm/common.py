"""What several operators of this subpackage share: tables in the shared folder, names, components, prefix sums."""

from __future__ import annotations

import functools
import inspect
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DIR_KEY = "spark.checkpoint.dir"
#: Nodes with more than this many edges, and more than 1/HUBS of all, are joined by broadcast.
LEAST_HUB, HUBS = 100, 1024
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see: spark.checkpoint.dir, or, where that is unset (tests), one of our own."""
    try:
        found = spark.conf.get(DIR_KEY)
    except Exception:  # an unset key without a default raises
        found = None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{DIR_KEY} must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="pagemill-"))
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/pagemill/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Deletes the files of a table made by stage(), once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/pagemill/" in parent:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df hasn't (Spark compares names without case)."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted += "_"
    return wanted


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df less any column that an operator is about to add: the operator's own value replaces a clashing input column."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def rows_where(docs: DataFrame, own: Sequence[str], mark: Callable[[DataFrame], DataFrame], condition: str) -> DataFrame:
    """The rows of docs for which condition holds after mark(docs) has added its own columns; docs' columns as they were.

    Columns of docs named like one of own are set aside under other names meanwhile.
    """
    taken = {n.lower() for n in own}
    aside = {c: free_name(docs, f"_aside{i}") if c.lower() in taken else c for i, c in enumerate(docs.columns)}
    marked = mark(docs.select(*[F.col(f"`{c}`").alias(aside[c]) for c in docs.columns]))
    return marked.where(condition).select(*[F.col(f"`{aside[c]}`").alias(c) for c in docs.columns])


def guarded(*own: str):
    """For an operator over a DataFrame: input columns named like its own working columns get other names while it runs.

    Parameters that end in _col, and keep, are column names and follow; so does the result.
    """
    taken = {n.lower() for n in own}

    def wrap(operator):
        said = inspect.signature(operator)

        @functools.wraps(operator)
        def call(df: DataFrame, *args, **settings) -> DataFrame:
            aside = {c: free_name(df, f"aside{i}") for i, c in enumerate(df.columns) if c.lower() in taken}
            if not aside:
                return operator(df, *args, **settings)
            bound = said.bind(df.select(*[F.col(f"`{c}`").alias(aside.get(c, c)) for c in df.columns]), *args, **settings)
            for name, value in bound.arguments.items():
                if name.endswith("_col"):
                    bound.arguments[name] = aside.get(value, value)
                elif name == "keep" and value is not None:
                    bound.arguments[name] = [aside.get(c, c) for c in value]
            out, back = operator(*bound.args, **bound.kwargs), {v: k for k, v in aside.items()}
            return out.select(*[F.col(f"`{c}`").alias(back.get(c, c)) for c in out.columns])

        return call

    return wrap


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b) of any one orderable type.

    Alternating large-star and small-star rounds: each node's neighbours are hung on the smallest node it knows,
    so that after a few rounds every component is a star round its smallest node. Every round is a grouped minimum
    (combined before the shuffle) and a join with it; the result is written to the shared folder. In that join the edges
    of hubs, nodes with more than 1/HUBS of all edges and more than LEAST_HUB, go by broadcast: there are fewer than
    HUBS of these whatever the graph. Returns (node, root) for every node with an edge to another one, root being the
    smallest node of its component. Null ends are ignored; no edges give no rows.
    """
    now = stage(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen, many = None, now.count()
    for _ in range(max_rounds):
        # Large star: the larger end of an edge moves on to the smallest neighbour of the smaller end, if that has a smaller one.
        low = now.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        hubs = now.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(LEAST_HUB, many // HUBS)).select("v", F.lit(True).alias("hub"))
        marked = now.join(F.broadcast(hubs), "v", "left")
        cold = marked.where("hub is null").join(low, "v", "left")
        hot = marked.where("hub").join(F.broadcast(low.join(F.broadcast(hubs), "v", "left_semi")), "v", "left")
        large = cold.select("u", F.coalesce("m", "v").alias("v")).union(hot.select("u", F.coalesce("m", "v").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        after = stage(small, "edges")
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_staged(now)
        now, many = after, mark[0]
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def running_total(df: DataFrame, group: list[str], order: list[str], value: str, coarse: Column, fine: Column, out: str) -> DataFrame:
    """Adds out: the inclusive running sum of value within group by order, without one task per group.

    coarse and fine (bigint) cut each group's order into slices and slices of slices: both must not decrease along it.
    Sums of slices are added up first; only rows of one fine slice meet in one sorted window.
    """
    c, f = free_name(df, "_coarse"), free_name(df, "_fine")
    df = df.withColumn(c, coarse).withColumn(f, fine)
    slices = df.groupBy(*group, c, f).agg(F.sum(value).alias("_s"))
    whole = slices.groupBy(*group, c).agg(F.sum("_s").alias("_s"))
    before = Window.partitionBy(*group).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(*group, c, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_above"))
    inside = Window.partitionBy(*group, c).orderBy(f).rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(*group, c, f, F.coalesce(F.sum("_s").over(inside), F.lit(0)).alias("_left"))
    base = _null_safe(slices, whole, [*group, c]).select(*group, c, f, (F.col("_above") + F.col("_left")).alias("_base"))
    rows = Window.partitionBy(*group, c, f).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn(out, F.sum(value).over(rows))
    return _null_safe(df, base, [*group, c, f]).withColumn(out, F.col(out) + F.col("_base")).drop(c, f, "_base")


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys, null equal to null, with left's keys kept."""
    renamed = right.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], *[x for x in right.columns if x not in keys])
    on = [left[k].eqNullSafe(renamed[f"_r{i}"]) for i, k in enumerate(keys)]
    joined = left.join(renamed, on)
    return joined.drop(*[f"_r{i}" for i in range(len(keys))])
