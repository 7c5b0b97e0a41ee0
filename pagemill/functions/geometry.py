"""Plane geometry, colours and measurements as Column expressions over structs of doubles."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def matrix(a, b, c, d, e, f) -> Column:
    """The affine map (x, y) -> (a x + c y + e, b x + d y + f)."""
    named = zip("abcdef", (a, b, c, d, e, f), strict=True)
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(n) for n, v in named])


def compose(m: Column, n: Column) -> Column:
    """First m, then n."""
    return matrix(m["a"] * n["a"] + m["b"] * n["c"], m["a"] * n["b"] + m["b"] * n["d"], m["c"] * n["a"] + m["d"] * n["c"], m["c"] * n["b"] + m["d"] * n["d"],
                  m["e"] * n["a"] + m["f"] * n["c"] + n["e"], m["e"] * n["b"] + m["f"] * n["d"] + n["f"])


def apply_matrix(m: Column, x: Column, y: Column) -> Column:
    return F.struct((m["a"] * x + m["c"] * y + m["e"]).alias("x"), (m["b"] * x + m["d"] * y + m["f"]).alias("y"))


def invert(m: Column) -> Column:
    """The inverse, or null for a map without one."""
    det = m["a"] * m["d"] - m["b"] * m["c"]
    k = F.when(det != 0, det)
    inner = matrix(m["d"] / k, -m["b"] / k, -m["c"] / k, m["a"] / k, (m["c"] * m["f"] - m["d"] * m["e"]) / k, (m["b"] * m["e"] - m["a"] * m["f"]) / k)
    return F.when(det != 0, inner)


def rect_contains(x: Column, y: Column, left: Column, bottom: Column, width: Column, height: Column) -> Column:
    """Edges belong to the rectangle."""
    return x.between(left, left + width) & y.between(bottom, bottom + height)


def rect_intersect(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """What two (x, y, width, height) share as a struct, null if nothing."""
    left, low = F.greatest(a[0], b[0]), F.greatest(a[1], b[1])
    right, top = F.least(a[0] + a[2], b[0] + b[2]), F.least(a[1] + a[3], b[1] + b[3])
    return F.when((right > left) & (top > low), F.struct(left.alias("x"), low.alias("y"), (right - left).alias("width"), (top - low).alias("height")))


def rect_inflate(x: Column, y: Column, width: Column, height: Column, by: Column) -> Column:
    return F.struct((x - by).alias("x"), (y - by).alias("y"), (width + 2 * by).alias("width"), (height + 2 * by).alias("height"))


def path_area(points: Column) -> Column:
    """Signed area of a closed array<struct<x, y>>: positive if it runs counter-clockwise."""
    following = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    return F.aggregate(F.zip_with(points, following, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda s, c: s + c) / 2


def path_contains(points: Column, x: Column, y: Column, even_odd: bool = False) -> Column:
    """Whether a point is inside a closed path, by the non-zero or the even-odd rule."""
    following = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))

    def crossing(p: Column, q: Column) -> Column:
        side = (q["x"] - p["x"]) * (y - p["y"]) - (x - p["x"]) * (q["y"] - p["y"])
        return F.when((p["y"] <= y) & (q["y"] > y) & (side > 0), 1).when((p["y"] > y) & (q["y"] <= y) & (side < 0), -1).otherwise(0)

    turns = F.zip_with(points, following, crossing)
    if even_odd:
        return F.aggregate(turns, F.lit(0), lambda s, c: s + F.abs(c)) % 2 == 1
    return F.aggregate(turns, F.lit(0), lambda s, c: s + c) != 0


def fit(box_w: Column, box_h: Column, width: Column, height: Column) -> Column:
    """The largest scale at which width x height fits the box, and the offsets that centre it there."""
    scale = F.least(box_w / width, box_h / height)
    return F.struct(scale.alias("scale"), ((box_w - width * scale) / 2).alias("dx"), ((box_h - height * scale) / 2).alias("dy"))


def place_page(crop: Sequence[Column], rotate: Column, cell: Sequence[Column]) -> Column:
    """The map that shows a crop box (x1, y1, x2, y2), upright by its clockwise rotation, centred in a cell (x, y, width, height)."""
    x1, y1 = F.least(crop[0], crop[2]), F.least(crop[1], crop[3])
    w, h = F.abs(crop[2] - crop[0]), F.abs(crop[3] - crop[1])
    turn = F.pmod(rotate, F.lit(360))
    side = turn.isin(90, 270)
    shown = fit(cell[2], cell[3], F.when(side, h).otherwise(w), F.when(side, w).otherwise(h))
    upright = F.when(turn == 90, matrix(0, -1, 1, 0, -y1, x1 + w)).when(turn == 180, matrix(-1, 0, 0, -1, x1 + w, y1 + h)).when(turn == 270, matrix(0, 1, -1, 0, y1 + h, -x1)).otherwise(matrix(1, 0, 0, 1, -x1, -y1))
    return compose(upright, matrix(shown["scale"], 0, 0, shown["scale"], cell[0] + shown["dx"], cell[1] + shown["dy"]))


def hex_rgb(text: Column) -> Column:
    """#rgb, #rrggbb or the same without #, as a struct of numbers from 0 to 255; null for anything else."""
    bare = F.regexp_replace(text, "^#", "")
    bare = F.when(bare.rlike("^[0-9A-Fa-f]{3}$"), F.regexp_replace(bare, "(.)", "$1$1")).when(bare.rlike("^[0-9A-Fa-f]{6}$"), bare)
    return F.when(bare.isNotNull(), F.struct(*[F.conv(F.substring(bare, k, 2), 16, 10).cast("int").alias(n) for k, n in ((1, "r"), (3, "g"), (5, "b"))]))


def argb(a: Column, r: Column, g: Column, b: Column) -> Column:
    """One number from four of 0 to 255."""
    return ((a.cast("bigint") * 256 + r) * 256 + g) * 256 + b


def cmyk_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    """Plain conversion of shares of 0 to 1: each colour less its ink and black."""
    return F.struct(*[((1 - F.least(F.lit(1.0), ink)) * (1 - F.least(F.lit(1.0), k))).alias(n) for n, ink in (("r", c), ("g", m), ("b", y))])


# Points in a unit.
POINTS = {"in": 72.0, "mm": 72 / 25.4, "cm": 72 / 2.54, "pt": 1.0, "pc": 12.0, "mp": 0.001}
_LENGTH = r"^\s*([+-]?[0-9]*\.?[0-9]+)\s*([A-Za-z%]*)\s*$"


def points_of(text: Column, em: float = 12.0, whole: float = 100.0) -> Column:
    """A length like "2.5in" in points; em and % are taken of the sizes given; no unit means inches; null if it is no length."""
    size, unit = F.regexp_extract(text, _LENGTH, 1), F.lower(F.regexp_extract(text, _LENGTH, 2))
    factor = F.when(unit == "", POINTS["in"]).when(unit == "em", em).when(unit == "%", whole / 100)
    for name, points in POINTS.items():
        factor = factor.when(unit == name, points)
    return F.when(text.rlike(_LENGTH), size.try_cast("double") * factor)


def scaled(value: Column, chain: Sequence[tuple[float, str, int]]) -> Column:
    """A measured value with its unit chain, as text: each (factor, unit, decimals) but the last takes whole units, the last what is left."""
    parts, rest = [], value
    for k, (factor, unit, decimals) in enumerate(chain):
        rest = rest * factor
        if k < len(chain) - 1:
            parts.append(F.concat(F.floor(rest).cast("string"), F.lit(f" {unit}")))
            rest = rest - F.floor(rest)
        else:
            parts.append(F.concat(F.format_string(f"%.{decimals}f", rest), F.lit(f" {unit}")))
    return F.concat_ws(" ", *parts)


def font_style(name: Column) -> Column:
    """Family, weight and slant from a font's name: a six-letter subset prefix goes, style words are looked for after it."""
    bare = F.regexp_replace(name, "^[A-Z]{6}\\+", "")
    low = F.lower(bare)
    weight = F.when(low.rlike("black|heavy"), 900).when(low.rlike("extrabold|ultrabold"), 800).when(low.rlike("semibold|demi"), 600).when(low.rlike("bold"), 700).when(low.rlike("medium"), 500).when(low.rlike("light"), 300).when(low.rlike("thin|hairline"), 100).otherwise(400)
    family = F.regexp_replace(F.regexp_replace(bare, "[-,].*$", ""), "(?i)(MT|PS)$", "")
    return F.struct(family.alias("family"), weight.alias("weight"), low.rlike("italic|oblique").alias("slanted"))


def parse_date(text: Column) -> Column:
    """A document date "D:YYYYMMDDHHmmSS+hh'mm'" as a UTC timestamp; parts from the right may be missing; null if it is none."""
    p = re.sub(r"\s", "", r"""^(?:D:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:([-+Z])(?:(\d{2})'?(?:(\d{2})'?)?)?)?$""")
    g = lambda k, empty: F.coalesce(F.nullif(F.regexp_extract(text, p, k), F.lit("")), F.lit(empty))
    local = F.try_to_timestamp(F.concat(g(1, ""), g(2, "01"), g(3, "01"), g(4, "00"), g(5, "00"), g(6, "00")), F.lit("yyyyMMddHHmmss"))
    shift = (g(8, "0").cast("int") * 60 + g(9, "0").cast("int")) * F.when(g(7, "Z") == "-", 1).otherwise(-1)
    return F.when(text.rlike(p), F.timestamp_add("MINUTE", shift, local) if hasattr(F, "timestamp_add") else local + F.make_dt_interval(mins=shift))


def arrow_head(x0: Column, y0: Column, x1: Column, y1: Column, length: Column, spread: float = 30.0) -> list[Column]:
    """x and y of an arrow's head at (x1, y1): one wing, the tip, the other wing, `spread` degrees off the line."""
    back, half = F.atan2(y0 - y1, x0 - x1), math.radians(spread)
    a, b = back + half, back - half
    return [x1 + length * F.cos(a), y1 + length * F.sin(a), x1, y1, x1 + length * F.cos(b), y1 + length * F.sin(b)]
