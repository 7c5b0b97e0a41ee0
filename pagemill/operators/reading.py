"""Reading order: positioned fragments to lines, columns and text.

Stream order is a pure window computation. Lines and columns depend on what was placed before (running means, nearest
line, shrinking common gaps), so they run per page in Python over Arrow batches; a page is a bounded group.
"""

from __future__ import annotations

import math
from collections import namedtuple
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from pagemill.operators.objects import dealt

KEYS = ["doc_id", "page_index"]
AT_ONCE = 4096  # rows that Python makes before they go on
# Shares of the text size, or plain counts, that decide what is a line, a gap, a column.
TURN, LINE, GAP = 2.0, 0.5, 0.3
GUTTER_EM, LEAST_GUTTER, MOST_COLUMNS, COLUMN_EM = 1.0, 4.0, 3, 10.0
FILL, FILL_SHARE, MEDIAN_CHARS, INDENT = 0.7, 0.5, 20, 0.25
LEADERS = ".…·_-"
_LEADER = r"^[.…·_\-]{3,}$"


def _along(x: Column, y: Column, angle: Column) -> Column:
    return x * F.cos(F.radians(angle)) + y * F.sin(F.radians(angle))


def _across(x: Column, y: Column, angle: Column) -> Column:
    return y * F.cos(F.radians(angle)) - x * F.sin(F.radians(angle))


def stream_text(fragments: DataFrame) -> DataFrame:
    """(doc_id, page_index, text) in drawing order.

    A new line where the baseline moves by more than half the larger size, or the direction turns; a space where a gap is
    over 0.3 of the size before it, or a dot leader touches a word. All of it from the fragment before, by `lag`.
    """
    w = Window.partitionBy(*KEYS).orderBy("frag_index")
    width = F.coalesce("width", F.length("text") * F.col("font_size") * 0.6)
    f = fragments.withColumn("_w", width)
    p = {c: F.lag(c).over(w) for c in ("x", "y", "font_size", "angle", "text", "_w")}
    f = f.select("*", *[v.alias(f"p_{c}") for c, v in p.items()])
    turn = F.abs(F.pmod(F.col("angle") - F.col("p_angle") + 180, F.lit(360.0)) - 180)
    drop = F.abs(_across(F.col("x"), F.col("y"), F.col("p_angle")) - _across(F.col("p_x"), F.col("p_y"), F.col("p_angle")))
    gap = _along(F.col("x"), F.col("y"), F.col("p_angle")) - _along(F.col("p_x"), F.col("p_y"), F.col("p_angle")) - F.col("p__w")
    last, first = F.right("p_text", F.lit(1)), F.left("text", F.lit(1))
    apart = ~last.rlike(r"\s") & ~first.rlike(r"\s") & ((F.col("text").rlike(_LEADER) & ~last.isin(*LEADERS)) | (F.col("p_text").rlike(_LEADER) & ~first.isin(*LEADERS)))
    apart = apart & (F.length("text") > 0) & (F.length("p_text") > 0)
    sep = F.when(F.col("p_x").isNull(), "").when((turn >= TURN) | (drop > F.greatest("font_size", "p_font_size") * LINE), "\n").when((gap > F.col("p_font_size") * GAP) | apart, " ").otherwise("")
    f = f.select(*KEYS, "frag_index", F.concat(sep, "text").alias("_t"))
    out = f.groupBy(*KEYS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frag_index", "_t"))), lambda s: s["_t"]), "").alias("text"))
    return out.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))


def row_order(lines: DataFrame) -> DataFrame:
    """Fragments of lines (line_y, along) numbered as read: lines from above, fragments along the baseline; frag_index decides equals."""
    w = Window.partitionBy(*KEYS).orderBy(F.desc("line_y"), "line", "along", "frag_index")
    return lines.withColumn("position", F.row_number().over(w) - 1)


@dataclass
class Line:
    """A line being gathered, with the sums for its mean baseline and size."""

    angle: float
    items: list = field(default_factory=list)
    across: float = 0.0
    size: float = 0.0

    def add(self, f) -> None:
        self.items.append(f)
        self.across += across(f, self.angle)
        self.size += f.font_size


def along(f, angle: float) -> float:
    return f.x * math.cos(math.radians(angle)) + f.y * math.sin(math.radians(angle))


def across(f, angle: float) -> float:
    return f.y * math.cos(math.radians(angle)) - f.x * math.sin(math.radians(angle))


def _turned(a: float, b: float) -> bool:
    return abs(math.remainder(a - b, 360.0)) >= TURN


def gather(fragments) -> list[Line]:
    """Lines in order of arrival: each fragment joins the nearest line of its direction whose mean baseline is within half the larger size, or opens one."""
    lines: list[Line] = []
    for f in fragments:
        best, least = None, math.inf
        for line in lines:
            n = len(line.items)
            if not _turned(f.angle, line.angle):
                d = abs(across(f, line.angle) - line.across / n)
                if d <= max(line.size / n, f.font_size) * LINE and d < least:
                    best, least = line, d
        if best is None:
            lines.append(best := Line(f.angle))
        best.add(f)
    return lines


def _extent(f) -> float:
    return len(f.text) * f.font_size * 0.5 if f.width is None or math.isnan(f.width) else f.width


def _free(line: Line, low: float, high: float, least: float) -> list[tuple[float, float]]:
    """The gaps of at least `least` that a line leaves between two edges."""
    out, at = [], low
    for a, b in sorted((f.x, f.x + _extent(f)) for f in line.items):
        if a - at >= least:
            out.append((at, a))
        at = max(at, b)
    return out + [(at, high)] if high - at >= least else out


def _shared(a: list, b: list, least: float) -> list[tuple[float, float]]:
    both = ((max(p[0], q[0]), min(p[1], q[1])) for p in a for q in b)
    return [g for g in both if g[1] - g[0] >= least]


@dataclass
class Band:
    lines: list[Line]
    cuts: list[float]  # x positions between its columns; none for rows


def _prose(lines: list[Line], gutters: list, size: float) -> bool:
    """Whether every column between the gutters looks like running text."""
    middles = [(a + b) / 2 for a, b in gutters]
    columns: list[list[tuple[float, float, int]]] = [[] for _ in range(len(gutters) + 1)]
    for line in lines:
        parts: dict[int, list] = {}
        for f in line.items:
            parts.setdefault(sum(f.x + _extent(f) / 2 > m for m in middles), []).append(f)
        for c, fs in parts.items():
            chars = sum(len(f.text.strip()) for f in fs)
            if chars:
                columns[c].append((min(f.x for f in fs), max(f.x + _extent(f) for f in fs), chars))
    for parts in columns:
        if len(parts) < 2:
            return False
        low, high = min(p[0] for p in parts), max(p[1] for p in parts)
        width = high - low
        full = sum(p[1] - p[0] >= FILL * width and p[0] - low <= INDENT * width for p in parts)
        if width < COLUMN_EM * size or full < FILL_SHARE * len(parts) or sorted(p[2] for p in parts)[len(parts) // 2] < MEDIAN_CHARS:
            return False
    return True


def bands(lines: list[Line]) -> list[Band]:
    """Horizontal lines from above in bands that share white space: those whose columns read as prose are columns, the rest rows."""
    flat = sorted((x for x in lines if not _turned(x.angle, 0.0)), key=lambda x: -x.items[0].y)
    if len(flat) < 4:
        return [Band(flat, [])]
    sizes = sorted(x.size / len(x.items) for x in flat)
    size = sizes[len(sizes) // 2]
    least = max(LEAST_GUTTER, GUTTER_EM * size)
    low, high = min(f.x for x in flat for f in x.items), max(f.x + _extent(f) for x in flat for f in x.items)

    def inner(gaps):
        return [g for g in gaps if g[0] > low and g[1] < high]

    def close(part, gaps):
        kept = sorted(g for g in gaps if sum(min(f.x for f in x.items) < g[0] for x in part) >= 2 and sum(max(f.x + _extent(f) for f in x.items) > g[1] for x in part) >= 2)
        columns = len(part) >= 2 and 0 < len(kept) < MOST_COLUMNS and _prose(part, kept, size)
        return Band(part, [(a + b) / 2 for a, b in kept] if columns else [])

    out, part, common = [], [flat[0]], inner(_free(flat[0], low, high, least))
    for line in flat[1:]:
        free = _free(line, low, high, least)
        shared = inner(_shared(common, free, least))
        # A line within one column frees the other's width up to the page's edge: that is no interior gap, but no conflict either.
        if shared:
            part.append(line)
            common = shared
        else:
            out.append(close(part, common))
            part, common = [line], inner(free)
    out.append(close(part, common))
    merged: list[Band] = []
    for b in out:
        if merged and not b.cuts and not merged[-1].cuts:
            merged[-1].lines += b.lines
        else:
            merged.append(b)
    return merged


def arrange(lines: list[Line]) -> list[list]:
    """Lines' fragments in reading order: bands from above, columns from the left, lines from above; turned lines by their height."""
    layout = bands(lines)
    loose = sorted((x for x in lines if _turned(x.angle, 0.0)), key=lambda x: -x.items[0].y)
    out = []

    def put(fs, angle):
        out.append(sorted(fs, key=lambda f: (along(f, angle), f.frag_index)))

    for b in layout:
        top = max((f.y for x in b.lines for f in x.items), default=math.inf)
        while loose and loose[0].items[0].y > top:
            x = loose.pop(0)
            put(x.items, x.angle)
        columns: list[list[list]] = [[] for _ in range(len(b.cuts) + 1)]
        for line in b.lines:
            parts: dict[int, list] = {}
            for f in line.items:
                parts.setdefault(sum(f.x > c for c in b.cuts), []).append(f)
            for c, fs in parts.items():
                columns[c].append(fs)
        for column in columns:
            for fs in sorted(column, key=lambda fs: -fs[0].y):
                put(fs, 0.0)
    for x in loose:
        put(x.items, x.angle)
    return out


def written(ordered: list[list]) -> str:
    """Text of arranged lines: a space at a gap of over 0.3 of the size before it, or between a leader and a word, unless there is one."""
    def leader(t):
        return len(t) >= 3 and all(c in LEADERS for c in t)

    lines = []
    for fs in ordered:
        text, angle = fs[0].text, fs[0].angle
        for p, f in zip(fs, fs[1:], strict=False):
            width = len(p.text) * p.font_size * 0.6 if p.width is None or math.isnan(p.width) else p.width
            gap = along(f, angle) - along(p, angle) - width
            touch = p.text and f.text and ((leader(f.text) and p.text[-1] not in LEADERS) or (leader(p.text) and f.text[0] not in LEADERS))
            if (gap > p.font_size * GAP or touch) and not p.text.endswith(" ") and not f.text.startswith(" "):
                text += " "
            text += f.text
        lines.append(text)
    return "\n".join(lines).strip()


def _per_page(fragments: DataFrame, schema: str, make) -> DataFrame:
    rest = ["frag_index", "text", "x", "y", "font_size", "width", "angle"]
    kind = namedtuple("Piece", [*KEYS, *rest])
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    pages = dealt(fragments.select(*KEYS, *rest), *KEYS).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("_f"))

    def run(batches):
        for batch in batches:
            rows = []
            for doc, page, pieces in zip(*batch.columns, strict=True):
                columns = [pieces.values.field(k) for k in range(len(rest))]
                columns = [c.to_numpy(zero_copy_only=False).tolist() if pa.types.is_floating(c.type) else c.to_pylist() for c in columns]  # null numbers as NaN
                rows += make([kind(doc.as_py(), page.as_py(), *r) for r in zip(*columns, strict=True)])
                if len(rows) >= AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    return pages.mapInArrow(run, schema)


def lines(fragments: DataFrame) -> DataFrame:
    """Each fragment's line: (doc_id, page_index, frag_index, line, line_y, along), lines numbered by arrival."""
    def make(fs):
        return [(f.doc_id, f.page_index, f.frag_index, k, x.items[0].y, along(f, x.angle)) for k, x in enumerate(gather(fs)) for f in x.items]

    return _per_page(fragments, "doc_id long, page_index int, frag_index int, line int, line_y double, along double", make)


def layout_text(fragments: DataFrame) -> DataFrame:
    """(doc_id, page_index, text, columns) in layout order: columns where the page has them, else rows. columns: the most of any band."""
    def make(fs):
        found = gather(fs)
        return [(fs[0].doc_id, fs[0].page_index, written(arrange(found)), max(len(b.cuts) + 1 for b in bands(found)))]

    return _per_page(fragments, "doc_id long, page_index int, text string, columns int", make)


def tagged_text(fragments: DataFrame) -> DataFrame:
    """(doc_id, page_index, text) of fragments with a rank (see objects.tag_ranks): ranked ones in their order; others above or below them, as rows."""
    page = Window.partitionBy(*KEYS)
    top = F.max(F.when(F.col("rank").isNotNull(), F.col("y"))).over(page)
    part = F.when(F.col("rank").isNotNull(), 1).when(F.col("y") > F.coalesce(top, F.lit(float("-inf"))), 0).otherwise(2)
    key = F.struct(part.alias("part"), F.coalesce("rank", F.lit(0)).alias("rank"), F.when(part != 1, -F.col("y")).otherwise(0.0).alias("down"), "frag_index", "text")
    rows = fragments.select(*KEYS, key.alias("k"))
    return rows.groupBy(*KEYS).agg(F.array_join(F.transform(F.array_sort(F.collect_list("k")), lambda k: k["text"]), "\n").alias("text"))


def run_order(runs: DataFrame, bucket: float = 2.0) -> DataFrame:
    """Display runs with reading_index: by baseline (in steps of `bucket`) from above, then x, then drawing order. A total order, so every run of it is the same."""
    w = Window.partitionBy(*KEYS).orderBy(F.desc(F.floor(F.col("y") / bucket)), "x", "frag_index")
    return runs.withColumn("reading_index", F.row_number().over(w) - 1)


def raised(fragments: DataFrame) -> DataFrame:
    """Adds shift ("super", "sub" or "none"): small text (0.85 of its line's largest size or less) off the baseline by over a tenth of that size."""
    found = lines(fragments)
    f = fragments.drop("shift").join(found, [*KEYS, "frag_index"])
    line = Window.partitionBy(*KEYS, "line")
    main = F.max("font_size").over(line)
    base = F.avg(F.when(F.col("font_size") > 0.85 * F.col("_main"), F.col("y"))).over(line)
    f = f.withColumn("_main", main).withColumn("_base", base)
    small = F.col("font_size") <= 0.85 * F.col("_main")
    shift = F.when(small & (F.col("y") - F.col("_base") > 0.1 * F.col("_main")), "super").when(small & (F.col("_base") - F.col("y") > 0.1 * F.col("_main")), "sub").otherwise("none")
    return f.withColumn("shift", shift).drop("_main", "_base", "line", "line_y", "along")
