"""Curves, segments, scripts of text: small generators as Column expressions or Arrow UDFs."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


def bezier_points(points: list[tuple[float, float]], tolerance: float = 0.1) -> list[tuple[float, float]]:
    """A cubic curve as a polyline: halved until its control points are within `tolerance` of the chord."""
    out, todo = [points[0]], [(points, 0)]
    while todo:
        (a, b, c, d), depth = todo.pop()
        ux, uy = 3 * b[0] - 2 * a[0] - d[0], 3 * b[1] - 2 * a[1] - d[1]
        vx, vy = 3 * c[0] - 2 * d[0] - a[0], 3 * c[1] - 2 * d[1] - a[1]
        if max(ux * ux, vx * vx) + max(uy * uy, vy * vy) <= 16 * tolerance**2 or depth >= 16:
            out.append(d)
            continue
        mid = lambda p, q: ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2)
        ab, bc, cd = mid(a, b), mid(b, c), mid(c, d)
        abc, bcd = mid(ab, bc), mid(bc, cd)
        m = mid(abc, bcd)
        todo += [((m, bcd, cd, d), depth + 1), ((a, ab, abc, m), depth + 1)]
    return out


@F.pandas_udf(T.ArrayType(POINT))
def flattened(controls: pd.Series, tolerance: pd.Series) -> pd.Series:
    """Arrays of four control points to polylines."""
    return pd.Series([[{"x": x, "y": y} for x, y in bezier_points([(p["x"], p["y"]) for p in c], t)] for c, t in zip(controls, tolerance, strict=True)])


def segments(points: Column) -> Column:
    """The straight pieces of a polyline as array<struct<x0, y0, x1, y1>>, those of no length left out."""
    n = F.size(points)
    pairs = F.zip_with(F.slice(points, 1, F.greatest(n - 1, F.lit(0))), F.slice(points, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")))
    return F.filter(pairs, lambda s: (s["x0"] != s["x1"]) | (s["y0"] != s["y1"]))


def script_of(c: str) -> str:
    """A character's script by the first word of its name; "Common" for what isn't a letter or mark."""
    if unicodedata.category(c)[0] not in "LM":
        return "Common"
    name = unicodedata.name(c, "").split(" ")[0].capitalize()
    return name if name and name not in ("Combining", "Modifier", "Feminine", "Masculine") else "Common"


class _Codes(dict):
    """Characters' scripts as single characters, for str.translate: "\\0" is Common, the others stand in `names`."""

    def __init__(self):
        super().__init__()
        self.names, self.of = ["Common"], {"Common": 0}

    def __missing__(self, c: int) -> str:
        script = script_of(chr(c))
        if script not in self.of:
            self.of[script] = len(self.names)
            self.names.append(script)
        self[c] = chr(self.of[script])
        return self[c]


_CODES = _Codes()


@lru_cache(1024)
def _run_of(code: str):
    return re.compile(f"[\0{re.escape(code)}]*")


def _runs(text: str | None) -> list[dict]:
    codes = (text or "").translate(_CODES)
    runs, at, lead = [], 0, len(codes) - len(codes.lstrip("\0"))
    while at < len(codes):
        code = codes[max(at, lead)] if lead < len(codes) else "\0"
        end = _run_of(code).match(codes, at).end()
        runs.append({"start": at, "length": end - at, "script": _CODES.names[ord(code)]})
        at = end
    return runs


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("script", T.StringType())])))
def script_runs(texts: pd.Series) -> pd.Series:
    """Runs of one script; common characters go with the run before them (leading ones with the one after)."""
    return texts.map(_runs)
