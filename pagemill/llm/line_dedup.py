"""Line dedup by winnowing over line hashes, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.llm.common import guarded, stage, without

WORD = r"[^\x20\x09-\x0D]+"
OUT = ["clean_text", "n_lines", "n_removed", "n_words_removed", "removed"]


def n_words(line: Column) -> Column:
    """Words of a line between white space (space and \\x09-\\x0D); of most lines, from their single spaces alone."""
    odd = line.contains("  ")
    for c in "\t\x0b\f\r":
        odd = odd | line.contains(c)
    single = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1 - line.startswith(" ").cast("int") - line.endswith(" ").cast("int")
    return F.when(line == "", 0).when(odd, F.regexp_count(line, F.lit(WORD))).otherwise(single)


def _same(a: Column, b: Column) -> Column:
    """How many elements two arrays start with that are equal, one by one."""
    equal = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(equal, False)
    return F.when(at > 0, at - 1).otherwise(F.size(equal)).cast("int")


def repeated_lines(lines: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """Lines to delete as runs (d, lo, hi) of lines (d, p, h, n): d the document in its order, p the line, h its hash, n > 0 its words.

    A gram is the fewest lines from one on that have `words` words. In each window of grams that start within `words`
    words, the one with the smallest hash is a fingerprint: two equal runs of lines of twice as many words share one,
    however the documents differ before and after. All later occurrences of a fingerprint are held against its first one
    in document order and extended both ways line by line. Where that ends within what there is to look at, another
    occurrence before may go on: every longer extension is a key, and an occurrence goes as far as its longest key that
    an occurrence before has too. What is within an extension is deleted. An occurrence that equals the first one all
    the way has no key, nor do lengths that the first one covers: whoever shares those shares them with the first one.
    So no occurrences are paired among themselves, and a key's group is a count and a minimum.

    Fingerprints of one run start at most `words` words apart, so an extension has the lines to look at that start fewer
    than `words` words before, and fewer than 2 * words words after its own line.

    Both sides of every join here grow with the corpus: they are merged at any size, never broadcast, and what a hot
    fingerprint gathers adaptive execution may split.

    Returns the runs, and the lines numbered by q, which lo and hi refer to.
    """
    doc = Window.partitionBy("d").orderBy("p")
    upto = doc.rowsBetween(Window.unboundedPreceding, 0)
    t = lines.withColumn("q", F.row_number().over(doc)).withColumn("off", F.sum("n").over(upto) - F.col("n"))
    on, back = (Window.partitionBy("d").orderBy("off").rangeBetween(*r) for r in ((0, words - 1), (1 - words, 0)))
    t = t.withColumn("gram", F.collect_list("h").over(on)).withColumn("total", F.sum("n").over(on))
    t = t.withColumn("g", F.when(F.col("total") >= words, F.xxhash64("gram"))).withColumn("long", F.size("gram")).drop("gram", "total")
    t = t.withColumn("best", F.min(F.when(F.col("g").isNotNull(), F.struct("g", "q"))).over(on)["q"])
    # A line is chosen if it is the best of a window that starts at it or up to `words` words before.
    t = t.withColumn("chosen", F.array_contains(F.collect_set("best").over(back), F.col("q")))
    t = stage(t.select("d", "p", "q", "h", "n", "off", F.when(F.col("chosen"), F.col("g")).alias("g"), "long"), "lines")

    prints = t.where("g is not null").select("d", "q", "g", "long")
    first = prints.groupBy("g").agg(F.min(F.struct("d", "q")).alias("at"), F.count(F.lit(1)).alias("many")).where("many > 1").select(F.col("g").alias("g1"), "at")
    # Only lines round fingerprints that recur, and only in the documents that have them, are looked at again.
    known = stage(prints.join(first.hint("merge"), prints["g"] == first["g1"]).select("d", "q", "g", "long", "at"), "recurring")
    near = t.select("d", "q", "h", "off").join(known.select("d").distinct().hint("merge"), "d", "left_semi")
    by = Window.partitionBy("d").orderBy("off")
    near = near.withColumn("on", F.collect_list("h").over(by.rangeBetween(0, 2 * words - 1))).withColumn("before", F.reverse(F.collect_list("h").over(by.rangeBetween(1 - words, -1))))
    none = F.array().cast("array<bigint>")
    near = near.select("d", "q", F.concat(F.array("h"), F.coalesce(F.lead("on").over(by), none)).alias("after"), "before")
    known = stage(known.join(near.hint("merge"), ["d", "q"]), "context")
    here = F.struct("d", "q") == F.col("at")
    source = known.where(here).select(F.col("g").alias("g1"), F.col("after").alias("after1"), F.col("before").alias("before1"))
    pairs = known.where(~here).join(source.hint("merge"), F.col("g") == F.col("g1"))
    pairs = pairs.withColumn("right", _same(F.col("after"), F.col("after1"))).where(F.col("right") >= F.col("long"))
    pairs = pairs.withColumn("left", _same(F.col("before"), F.col("before1")))
    # What the first occurrence does not cover, of lines that lie further out than its.
    ends = [F.when(F.col(c) < F.size(x), F.col(x)).alias(x) for c, x in (("right", "after"), ("left", "before"))]
    pairs = stage(pairs.select("d", "q", "g", "right", "left", *ends), "first")

    def longer(side: str, lines: str, sign: int) -> Column:
        key = lambda k: F.struct((sign * k).alias("far"), F.xxhash64(F.lit(sign), F.slice(lines, F.lit(1), k)).alias("k"))
        return F.when(F.col(lines).isNotNull(), F.transform(F.sequence(F.col(side) + 1, F.size(lines)), key)).otherwise(F.array().cast("array<struct<far:int,k:bigint>>"))

    keys = pairs.where("after is not null or before is not null").select("d", "q", "g", F.explode(F.concat(longer("right", "after", 1), longer("left", "before", -1))).alias("x")).select("d", "q", "g", "x.far", "x.k")
    often = keys.groupBy("g", "far", "k").agg(F.min(F.struct("d", "q")).alias("at"), F.count(F.lit(1)).alias("many")).where("many > 1").drop("many")
    found = keys.join(often.hint("merge"), ["g", "far", "k"]).where(F.struct("d", "q") != F.col("at"))
    whole = pairs.select("d", "q", "right", "left").unionByName(found.select("d", "q", F.greatest("far", F.lit(0)).alias("right"), F.greatest(-F.col("far"), F.lit(0)).alias("left")))
    whole = whole.groupBy("d", "q").agg(F.max("right").alias("right"), F.max("left").alias("left"))
    return whole.select("d", (F.col("q") - F.col("left")).alias("lo"), (F.col("q") + F.col("right") - 1).alias("hi")), t


@guarded("_d", "d2")
def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 25, keep: list[str] | None = None) -> DataFrame:
    """Adds clean_text, n_lines, n_removed, n_words_removed and removed (the deleted lines' numbers, from 0, ascending).

    Lines end at "\\n". Runs of lines that a document before has too (or the same document, further up) are deleted if a
    fingerprint finds them: all of 2 * `words` words or more, and none under `words` words, so that headings, short
    formulas and licence lines stay. Documents are in the order of their ids (null first), then of a hash of the text;
    the first occurrence of a run stays. Lines without words join no run, but go with one that they lie within.

    Null texts have no lines and stay null; an empty text has one empty line; rows with the same id and text are one
    document and get equal results; an empty table gives no rows. Input columns named like an output column are
    replaced. keep: the input columns to return (all, if None).
    """
    src = docs if text_col in OUT else without(docs, OUT)
    names = [c for c in src.columns if (keep is None or c in keep) and c not in OUT]
    text = F.col(f"`{text_col}`")
    key = F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("h"))
    split = F.split(text, "\n", -1)
    count = n_words(F.col("line"))
    lines = docs.where(text.isNotNull()).select(key.alias("d"), F.posexplode(split).alias("p", "line")).select("d", "p", F.xxhash64("line").alias("h"), count.cast("long").alias("n")).where("n > 0")
    # Equal rows are one document. All windows go by d, which the lines are dealt by once.
    lines = lines.repartition("d").groupBy("d", "p").agg(F.any_value("h").alias("h"), F.any_value("n").alias("n"))
    runs, numbered = repeated_lines(lines, words)
    gone = runs.select("d", F.explode(F.sequence("lo", "hi")).alias("q"), "hi").groupBy("d", "q").agg(F.max("hi").alias("hi"))
    # A line goes with the lines without words up to the next line of its run.
    after = F.lead("p").over(Window.partitionBy("d").orderBy("q"))
    placed = numbered.select("d", "q", "p", "n").join(gone.select("d").distinct().hint("merge"), "d", "left_semi").withColumn("end", after)
    placed = placed.join(gone.hint("merge"), ["d", "q"]).withColumn("line", F.explode(F.sequence("p", F.when(F.col("q") < F.col("hi"), F.col("end") - 1).otherwise(F.col("p")))))
    gone = placed.groupBy(F.col("d").alias("d2")).agg(F.array_sort(F.collect_list("line")).alias("removed"), F.sum(F.when(F.col("line") == F.col("p"), F.col("n")).otherwise(0)).alias("n_words_removed"))
    gone = stage(gone, "repeated")
    out = src.withColumn("_d", key)
    out = out.join(gone.hint("merge"), out["_d"] == gone["d2"], "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    rest = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("removed"))
    clean = F.when(F.col("removed").isNull(), text).otherwise(F.array_join(F.transform(rest, lambda i: F.element_at(split, i + 1)), "\n"))
    breaks = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    return out.select(*[F.col(f"`{c}`") for c in names], clean.alias("clean_text"), breaks.cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), F.coalesce("n_words_removed", F.lit(0)).alias("n_words_removed"), removed.alias("removed"))


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep=["doc_id"])
    return out.select("doc_id", "n_lines", "n_removed", "n_words_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"), F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("clean_sha256"))
