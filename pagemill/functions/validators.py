"""Checksum validators over candidate strings, as Column expressions that stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def digits_only(value: Column) -> Column:
    """The digits alone, whatever separates them; null if there are none."""
    bare = F.regexp_replace(value, "[^0-9]", "")
    return F.when(bare != "", bare)


def compact(value: Column) -> Column:
    return F.replace(value, F.lit(" "), F.lit(""))


def _digit(text: Column, at: Column) -> Column:
    return F.ascii(F.substring(text, at, F.lit(1))) - 48


def luhn(value: Column) -> Column:
    """Mod-10: every second digit from the right doubled, its digits added."""
    return F.coalesce(F.call_function("luhn_check", digits_only(value)), F.lit(False))


def dihedral() -> tuple[list[list[int]], list[list[int]]]:
    """The Verhoeff tables by their rule: the group of a pentagon's ten symmetries, and the powers of one permutation."""
    group = [[0] * 10 for _ in range(10)]
    for a in range(10):
        for b in range(10):
            turn = (a % 5 + b % 5) % 5 if a < 5 else (a % 5 - b % 5) % 5
            group[a][b] = turn + 5 * ((a >= 5) != (b >= 5))
    base = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]  # fixed value of the scheme
    powers = [list(range(10))]
    for _ in range(7):
        powers.append([base[x] for x in powers[-1]])
    return group, powers


def verhoeff(value: Column) -> Column:
    """Folds the digits from the right through the group table, each permuted by its place."""
    group, powers = dihedral()
    d = F.array(*[F.lit(x) for row in group for x in row])
    p = F.array(*[F.lit(x) for row in powers for x in row])
    text = F.reverse(digits_only(value))
    steps = F.sequence(F.lit(0), F.length(text) - 1)
    fold = F.aggregate(steps, F.lit(0), lambda c, i: F.element_at(d, c * 10 + F.element_at(p, F.pmod(i, F.lit(8)) * 10 + _digit(text, i + 1) + 1) + 1))
    return F.coalesce(fold == 0, F.lit(False))


def iban(value: Column) -> Column:
    """ISO 13616: first four characters to the end, letters as 10 to 35, remainder 1 by 97; 15 to 34 characters."""
    text = compact(value)
    turned = F.concat(F.substring(text, 5, 34), F.substring(text, 1, 4))
    codes = F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.ascii(F.substring(turned, i, F.lit(1))))
    fold = F.aggregate(codes, F.lit(0), lambda r, c: F.when(c >= 65, (r * 100 + c - 55) % 97).otherwise((r * 10 + c - 48) % 97))
    return F.coalesce(F.when(F.length(text).between(15, 34) & text.rlike("^[0-9A-Z]+$"), fold == 1), F.lit(False))


def aba(value: Column) -> Column:
    """Nine digits whose sum, weighted 3, 7, 1 in turn, is a multiple of ten."""
    text = digits_only(value)
    total = sum((F.lit((3, 7, 1)[i % 3]) * _digit(text, F.lit(i + 1)) for i in range(9)), F.lit(0))
    return F.coalesce((F.length(text) == 9) & (total % 10 == 0), F.lit(False))


def npi(value: Column) -> Column:
    """Ten digits that pass mod-10 after the prefix 80840."""
    text = digits_only(value)
    return F.coalesce((F.length(text) == 10) & F.call_function("luhn_check", F.concat(F.lit("80840"), text)), F.lit(False))


def itin(value: Column) -> Column:
    """Nine digits, the first a 9, the fourth and fifth in a range that is issued."""
    text = digits_only(value)
    group = F.substring(text, 4, 2).cast("int")
    issued = group.between(50, 65) | group.between(70, 88) | group.between(90, 92) | group.between(94, 99)
    return F.coalesce((F.length(text) == 9) & text.startswith("9") & issued, F.lit(False))


def countries() -> list[str]:
    """ISO 3166-1 two-letter codes as the JVM lists them, and XK."""
    jvm = SparkSession.active()._jvm
    return sorted({*jvm.java.util.Locale.getISOCountries(), "XK"})


def bic(value: Column) -> Column:
    """8 or 11 characters: six letters, of which the last two are a country, then letters or digits."""
    text = compact(value)
    return F.coalesce(text.rlike("^[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?$") & F.substring(text, 5, 2).isin(countries()), F.lit(False))
