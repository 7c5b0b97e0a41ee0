"""JavaScript's global, Math and string functions as Column expressions, with the quirks that form scripts rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.formcalc import number_text, to_number

NAN = float("nan")


def to_int(x: Column) -> Column:
    """parseInt: truncated towards zero; NaN stays NaN."""
    return F.when(F.isnan(x), F.lit(NAN)).otherwise(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double"))


trunc = to_int
parse_float = to_number
string_of = number_text


def is_nan(text: Column) -> Column:
    return F.isnan(to_number(text))


def boolean_of(text: Column) -> Column:
    return F.coalesce(F.length(text) > 0, F.lit(False))


def js_round(x: Column) -> Column:
    """Half away from zero."""
    return F.round(x, 0)


def js_sqrt(x: Column) -> Column:
    return F.when(x < 0, F.lit(NAN)).otherwise(F.sqrt(F.abs(x)))


def js_substr(s: Column, start: Column, count: Column | None = None) -> Column:
    """From a place counted from 0; a negative one counts from the end."""
    at = F.when(start < 0, F.greatest(F.length(s) + start, F.lit(0))).otherwise(F.least(start, F.length(s)))
    n = F.length(s) - at if count is None else F.greatest(F.least(count, F.length(s) - at), F.lit(0))
    return F.substring(s, (at + 1).cast("int"), n.cast("int"))


def js_substring(s: Column, a: Column, b: Column | None = None) -> Column:
    """Between two places counted from 0, kept within s and swapped if need be."""
    def inside(x: Column) -> Column:
        return F.least(F.greatest(x, F.lit(0)), F.length(s))

    a, b = inside(a), F.length(s) if b is None else inside(b)
    return F.substring(s, (F.least(a, b) + 1).cast("int"), F.abs(b - a).cast("int"))


def char_at(s: Column, at: Column) -> Column:
    """The character at a place counted from 0, "" outside s."""
    return F.when((at >= 0) & (at < F.length(s)), F.substring(s, (at + 1).cast("int"), F.lit(1))).otherwise("")


def index_of(s: Column, part: Column) -> Column:
    """Counted from 0; -1 if it isn't there."""
    return F.instr(s, part) - 1


def replace_first(s: Column, old: Column, new: Column) -> Column:
    """The first occurrence only; nothing is a pattern."""
    at = F.instr(s, old)
    return F.when((at > 0) & (F.length(old) > 0), F.concat(F.substring(s, F.lit(1), at - 1), new, F.substring(s, at + F.length(old), F.length(s)))).otherwise(s)


def split_first(s: Column, by: Column) -> Column:
    """What stands before the first separator (all of s, if there is none)."""
    at = F.instr(s, by)
    return F.when((at > 0) & (F.length(by) > 0), F.substring(s, F.lit(1), at - 1)).otherwise(s)
