"""Page numbers, numbered labels and stamp templates."""

from __future__ import annotations

import datetime as dt
from pathlib import PurePosixPath

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a Roman numeral's parts are worth.
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def roman(n: Column) -> Column:
    """Upper-case Roman numerals, with as many M as it takes; numbers below 1 stay Arabic."""
    rest, parts = n, []
    for worth, sign in ROMAN:
        parts.append(F.repeat(F.lit(sign), F.floor(rest / worth).cast("int")))
        rest = rest % worth
    return F.when(n <= 0, n.cast("string")).otherwise(F.concat(*parts))


def letters(n: Column) -> Column:
    """A to Z, AA, AB, ...: base 26 without a zero; numbers below 1 stay Arabic."""
    start = F.struct(n.cast("bigint").alias("n"), F.lit("").alias("s"))

    def step(acc, _):
        k = acc["n"] - 1
        return F.when(acc["n"] > 0, F.struct(F.call_function("div", k, F.lit(26)).alias("n"), F.concat(F.char(F.pmod(k, F.lit(26)) + 65), acc["s"]).alias("s"))).otherwise(acc)

    return F.when(n <= 0, n.cast("string")).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda acc: acc["s"]))


STYLES = {"arabic": lambda n: n.cast("string"), "roman": lambda n: F.lower(roman(n)), "ROMAN": roman, "alpha": lambda n: F.lower(letters(n)), "ALPHA": letters}


def padded(text: Column, width: int) -> Column:
    """Zeros to the left up to a width; longer text is not cut."""
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def page_value(index: Column, start: int = 1, first: str = "number") -> Column:
    """The number of a zero-based page. first: "number" counts the first page, "skip" leaves it out but counts it, "renumber" starts after it."""
    if first not in ("number", "skip", "renumber"):
        raise ValueError(f"unknown first-page mode {first!r}")
    if first == "number":
        return index + start
    return F.when(index > 0, index + start - int(first == "renumber"))


def label(value: Column, prefix: str = "", suffix: str = "", width: int = 0, style: str = "arabic") -> Column:
    """Prefix, number, suffix; only Arabic numbers are padded."""
    core = STYLES[style](value)
    return F.concat(F.lit(prefix), padded(core, width) if style == "arabic" and width else core, F.lit(suffix))


# .NET-style date letters and Spark's, where they differ.
_DATE_LETTERS = {"t": "a", "f": "S", "z": "x"}


def _date(stamp: Column, pattern: str) -> Column:
    return F.coalesce(F.date_format(stamp, "".join(_DATE_LETTERS.get(c, c) for c in pattern)), F.lit(""))


def template(text: str, page: Column, total: Column, path: Column | None = None, number: Column | None = None, stamp: Column | None = None) -> Column:
    """A template with {page[:style]}, {total}, {filename}, {filepath}, {number}, {date|time|datetime[:format]} as one concat.

    "{{" and "}}" are braces; unknown tokens stay as they are; an unclosed brace and what follows is literal. The template
    is read once, here; only its parts are evaluated by row.
    """
    path = F.lit(None).cast("string") if path is None else path
    parts: list[Column] = []
    literal, i = "", 0
    defaults = {"date": "yyyy-MM-dd", "time": "HH:mm", "datetime": "yyyy-MM-dd HH:mm"}
    while i < len(text):
        pair = text[i : i + 2]
        if pair in ("{{", "}}"):
            literal, i = literal + pair[0], i + 2
            continue
        if text[i] != "{":
            literal, i = literal + text[i], i + 1
            continue
        close = text.find("}", i + 1)
        if close < 0:
            literal += text[i:]
            break
        token, i = text[i + 1 : close], close + 1
        name, _, arg = token.partition(":")
        known = {
            "page": lambda: STYLES.get(arg, STYLES["arabic"])(page), "total": lambda: total.cast("string"),
            "filename": lambda: F.coalesce(F.element_at(F.split(path, r"[/\\]"), -1), F.lit("")), "filepath": lambda: F.coalesce(path, F.lit("")),
            "number": lambda: F.lit("") if number is None else F.coalesce(number, F.lit("")),
        }
        if name in defaults:
            part = F.lit("") if stamp is None else _date(stamp, arg or defaults[name])  # noqa: B023
        elif name in known:
            part = known[name]()
        else:
            literal += "{" + token + "}"
            continue
        parts += [F.lit(literal), part]
        literal = ""
    return F.concat(*parts, F.lit(literal))


def template_text(text: str, page: int, total: int, path: str | None = None, number: str | None = None, stamp: dt.datetime | None = None) -> str:
    """template() for one page, for tests and small tools: tokens page, total, filename, filepath, number only."""
    out = text.replace("{page}", str(page)).replace("{total}", str(total)).replace("{number}", number or "").replace("{filepath}", path or "")
    return out.replace("{filename}", PurePosixPath(path).name if path else "")
