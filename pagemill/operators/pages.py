"""Algebra of page sequences: relations of (doc, page_index, ...) rows whose order is page_index, from 0.

Windows go by document. A document is a bounded group (its pages), a corpus is not: nothing here sorts or numbers across
documents but merge(), which adds up page counts of the merged documents only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions import folds
from pagemill.operators.objects import settled

DOC, PAGE = "doc_id", "page_index"


def numbered(pages: DataFrame, doc: str = DOC, page: str = PAGE) -> DataFrame:
    """Pages numbered anew from 0 in their order."""
    return pages.withColumn(page, F.row_number().over(Window.partitionBy(doc).orderBy(page)) - 1)


def page_counts(pages: DataFrame, doc: str = DOC) -> DataFrame:
    return pages.groupBy(doc).agg(F.count(F.lit(1)).alias("page_count"))


def page_range(pages: DataFrame, start: int, count: int, strict: bool = False, doc: str = DOC, page: str = PAGE) -> DataFrame:
    """A slice of each document, numbered anew. strict: documents that end before it raise when the rows are read; else they give what they have."""
    if start < 0 or count < 1:
        raise ValueError("start is 0 or more, count 1 or more")
    if strict:
        n = F.count(F.lit(1)).over(Window.partitionBy(doc))
        pages = pages.withColumn("_n", n).where(F.when(F.col("_n") >= start + count, True).otherwise(F.raise_error(F.lit("page range exceeds a document")).isNull())).drop("_n")
    return pages.where(F.col(page).between(start, start + count - 1)).withColumn(page, F.col(page) - start)


def delete_pages(pages: DataFrame, indices: Sequence[int], doc: str = DOC, page: str = PAGE) -> DataFrame:
    """Pages less those of some indices (others than a document has are passed over), numbered anew."""
    return numbered(pages.where(~F.col(page).isin(*indices)) if indices else pages, doc, page)


def rotate_pages(pages: DataFrame, degrees: int, indices: Sequence[int] | None = None, rotate: str = "rotate", page: str = PAGE) -> DataFrame:
    """Adds a multiple of 90 degrees to the rotation of some pages, or of all."""
    if degrees not in (0, 90, 180, 270):
        raise ValueError("degrees is 0, 90, 180 or 270")
    turned = F.pmod(F.col(rotate) + degrees, F.lit(360))
    return pages.withColumn(rotate, turned if indices is None else F.when(F.col(page).isin(*indices), turned).otherwise(F.col(rotate)))


def reorder(pages: DataFrame, orders: DataFrame, doc: str = DOC, page: str = PAGE) -> DataFrame:
    """Pages in the order that `orders` (doc, array<int> order) has for their document: position k shows page order[k]; repeats are allowed.

    Documents without an order are left out; one whose order isn't as long as it has pages raises when the rows are read.
    """
    sized = orders.join(page_counts(pages, doc), doc)
    fits = F.when(F.size("order") == F.col("page_count"), F.col("order")).otherwise(F.raise_error(F.lit("an order is as long as its document")).cast("array<int>"))
    at = sized.select(doc, F.posexplode(fits).alias("_pos", page))
    return pages.join(at, [doc, page]).withColumn(page, F.col("_pos")).drop("_pos")


def merge(pages: DataFrame, documents: Sequence, target, doc: str = DOC, page: str = PAGE) -> DataFrame:
    """The pages of some documents, one document after another, as one: adds source_doc and source_page."""
    listed = F.array(*[F.lit(d) for d in documents])
    mine = pages.where(F.col(doc).isin(*documents)).withColumn("_at", F.array_position(listed, F.col(doc)))
    offsets = document_offsets(mine, doc)
    return mine.join(offsets, [doc, "_at"]).select(F.lit(target).cast(pages.schema[doc].dataType).alias(doc), (F.col(page) + F.col("offset")).alias(page), F.col(doc).alias("source_doc"), F.col(page).alias("source_page"), *[c for c in pages.columns if c not in (doc, page)])


def document_offsets(pages: DataFrame, doc: str = DOC, at: str = "_at") -> DataFrame:
    """How many pages stand before each document in the order of `at`: one row a document.

    Documents are dealt to slices by ranges of `at`, which are sorted each by itself; only the slices' sums, one row each,
    are added up in one task.
    """
    counts = pages.groupBy(doc, at).agg(F.count(F.lit(1)).alias("n"))
    sliced = settled(counts.repartitionByRange(F.col(at)).withColumn("_slice", F.spark_partition_id()))
    within = Window.partitionBy("_slice").orderBy(at, doc).rowsBetween(Window.unboundedPreceding, -1)
    above = sliced.groupBy("_slice").agg(F.sum("n").alias("_sum"))
    above = above.select("_slice", F.coalesce(F.sum("_sum").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_above"))
    before = F.coalesce(F.sum("n").over(within), F.lit(0))
    return sliced.withColumn("_before", before).join(above, "_slice").select(doc, at, (F.col("_before") + F.col("_above")).alias("offset"))


def rebase_outline(outline: DataFrame, offsets: DataFrame, doc: str = DOC, page: str = PAGE) -> DataFrame:
    """Bookmark targets moved by their document's offset; unresolved ones (-1) stay."""
    return outline.join(offsets.select(doc, "offset"), doc).withColumn(page, F.when(F.col(page) >= 0, F.col(page) + F.col("offset")).otherwise(-1)).drop("offset")


def assemble(pages: DataFrame, picks: DataFrame, target, doc: str = DOC, page: str = PAGE) -> DataFrame:
    """Pages as picked (pos, doc, page), repeats included, as one document; copy numbers the distinct documents by first use."""
    first = picks.groupBy(doc).agg(F.min("pos").alias("_first"))
    ranked = first.withColumn("copy", F.row_number().over(Window.orderBy("_first")) - 1).drop("_first")
    out = picks.join(pages, [doc, page]).join(ranked, doc)
    return out.select(F.lit(target).cast(pages.schema[doc].dataType).alias(doc), F.col("pos").alias(page), F.col(doc).alias("source_doc"), F.col(page).alias("source_page"), "copy", *[c for c in pages.columns if c not in (doc, page)])


def split(pages: DataFrame, doc: str = DOC, page: str = PAGE) -> DataFrame:
    """Every page a document of its own: part is its id, source_page where it was."""
    return pages.withColumn("part", F.concat_ws("-", F.col(doc).cast("string"), F.col(page).cast("string"))).withColumn("source_page", F.col(page)).withColumn(page, F.lit(0))


def n_up(pages: DataFrame, rows: int, columns: int, width: float, height: float, margin: float = 0.0, gutter: float = 0.0, by_column: bool = False, page: str = PAGE) -> DataFrame:
    """Where each page lands on sheets of rows x columns cells: adds sheet, slot, x, y, cell_width, cell_height (y from below)."""
    if rows < 1 or columns < 1 or margin < 0 or gutter < 0:
        raise ValueError("rows and columns are 1 or more, margin and gutter 0 or more")
    w = (width - 2 * margin - (columns - 1) * gutter) / columns
    h = (height - 2 * margin - (rows - 1) * gutter) / rows
    if w <= 0 or h <= 0:
        raise ValueError("no room for a cell")
    n = rows * columns
    slot = F.pmod(F.col(page), F.lit(n))
    row, column = (slot % rows, F.floor(slot / rows)) if by_column else (F.floor(slot / columns), slot % columns)
    return pages.select("*", F.floor(F.col(page) / n).alias("sheet"), slot.alias("slot"), (F.lit(margin) + column * (w + gutter)).alias("x"), (F.lit(height - margin) - (row + 1) * h - row * gutter).alias("y"), F.lit(w).alias("cell_width"), F.lit(h).alias("cell_height"))


def booklet(pages: DataFrame, doc: str = DOC, page: str = PAGE) -> DataFrame:
    """Saddle stitch: adds side (two a sheet, in print order) and place (0 left, 1 right). Pages are padded to a multiple of four with blanks, which are no rows."""
    n = F.count(F.lit(1)).over(Window.partitionBy(doc))
    padded = (F.floor((n + 3) / 4) * 4).alias("padded")
    number = F.col(page) + 1
    p = pages.select("*", padded)
    front = F.col(page) < F.col("padded") / 2
    near = F.when(front, number).otherwise(F.col("padded") + 1 - number)
    side = near - 1
    odd = near % 2 == 1
    place = F.when(front, F.when(odd, 1).otherwise(0)).otherwise(F.when(odd, 0).otherwise(1))
    return p.select(*pages.columns, side.cast("bigint").alias("side"), place.alias("place"))


def paginate(rows: DataFrame, group: str, order: str, height: str, room: float, repeat: float = 0.0) -> DataFrame:
    """Flows rows of a group into pages of `room`: a row that doesn't fit what is left starts a page, below a header of `repeat` on every page but the first.

    Adds page and y (from the top). A row higher than a page has one of its own. The fold runs over each group's array of
    heights, in order: overflow resets the sum, which no window frame can say.
    """
    items = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(height).cast("double").alias("h")))).alias("_i"))
    def step(acc, x):
        top = F.when(acc["page"] > 0, F.lit(float(repeat))).otherwise(0.0)
        over = (acc["y"] + x["h"] > room) & (acc["y"] > top)
        y = F.when(over, F.lit(float(repeat))).otherwise(acc["y"])
        return F.struct(F.when(over, acc["page"] + 1).otherwise(acc["page"]).alias("page"), (y + x["h"]).alias("y"))

    def told(acc, x):
        at = step(acc, x)
        return F.struct(x["o"].cast("bigint").alias("o"), at["page"].alias("page"), (at["y"] - x["h"]).alias("y"))

    start = F.struct(F.lit(0).alias("page"), F.lit(0.0).alias("y"))
    out = folds.scan(F.col("_i"), start, step, told, "struct<o:bigint,page:int,y:double>")
    placed = items.select(group, F.explode(out).alias("_p")).select(group, F.col("_p.o").alias(order), F.col("_p.page").alias("page"), F.col("_p.y").alias("y"))
    return rows.join(placed, [group, order])


def header_footer(pages: DataFrame, slots: dict[str, Column]) -> DataFrame:
    """One row per page and slot (of top/bottom and left/center/right) with its text; empty texts give no row."""
    listed = F.array(*[F.struct(F.lit(name).alias("slot"), text.alias("text")) for name, text in slots.items()])
    return pages.select("*", F.explode(F.filter(listed, lambda s: F.length(s["text"]) > 0)).alias("_s")).select(*pages.columns, "_s.slot", "_s.text")


def overlay(content: DataFrame, stamps: DataFrame, below: bool = False, doc: str = DOC, page: str = PAGE) -> DataFrame:
    """Stamps (doc, page, payload) as content rows (doc, page, z, payload), before or after what each page has."""
    rows = content.select(doc, page, "z", "payload", F.lit(False).alias("stamped")).unionByName(stamps.select(doc, page, F.lit(None).cast("int").alias("z"), "payload", F.lit(True).alias("stamped")))
    return overlaid(rows, below, doc, page)


def overlaid(rows: DataFrame, below: bool = False, doc: str = DOC, page: str = PAGE) -> DataFrame:
    """Content and stamps in one relation (doc, page, z, payload, stamped; stamps without z) as content rows. One shuffle; a page is a bounded group."""
    whole = Window.partitionBy(doc, page)
    edge = F.when(F.col(doc).isNotNull() & F.col(page).isNotNull(), (F.min("z") if below else F.max("z")).over(whole))
    seq = F.row_number().over(Window.partitionBy(doc, page, "stamped").orderBy("payload"))
    n = F.count_if("stamped").over(whole).cast("int")
    placed = rows.select(doc, page, "z", "payload", "stamped", F.coalesce(edge, F.lit(0)).alias("_e"), seq.alias("_s"), n.alias("_n"))
    z = F.col("_e") - F.col("_n") - 1 + F.col("_s") if below else F.col("_e") + F.col("_s")
    return placed.select(doc, page, F.when(F.col("stamped"), z).otherwise(F.col("z")).alias("z"), "payload")


def remove_stamp(content: DataFrame, stamp: str, column: str = "stamp") -> DataFrame:
    """Content less a named stamp's rows."""
    return content.where(~F.col(column).eqNullSafe(F.lit(stamp)))


def crop(pages: DataFrame, crops: DataFrame, doc: str = DOC, page: str = PAGE) -> DataFrame:
    """Crop boxes (x1, y1, x2, y2) cut to what `crops` asks for, where it asks; a crop that misses its page keeps the page's box."""
    asked = crops.select(doc, page, *[F.col(c).alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")])
    out = pages.join(asked, [doc, page], "left")
    x1, y1, x2, y2 = F.greatest("x1", "_x1"), F.greatest("y1", "_y1"), F.least("x2", "_x2"), F.least("y2", "_y2")
    hit = F.coalesce(F.col("_x1").isNotNull() & (x2 > x1) & (y2 > y1), F.lit(False))
    for name, value in (("x1", x1), ("y1", y1), ("x2", x2), ("y2", y2)):
        out = out.withColumn(f"{name}_new", F.when(hit, value).otherwise(F.col(name)))
    return out.drop("x1", "y1", "x2", "y2", "_x1", "_y1", "_x2", "_y2").withColumnsRenamed({f"{c}_new": c for c in ("x1", "y1", "x2", "y2")})
