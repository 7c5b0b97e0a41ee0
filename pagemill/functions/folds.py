"""Folds over arrays that keep what they pass, in time linear in the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body names it, within lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(items: Column, start: Column, step: Callable[[Column, Column], Column], told: Callable[[Column, Column], Column], kind: str) -> Column:
    """told(state before, item) for each item, the state going from start by step(state, item); kind is told's type.

    Appending to an array copies it, so results are gathered in chunks, and chunks in a list of chunks.
    """
    return let(items, lambda xs: _scan(xs, start, step, told, kind))


def _scan(items: Column, start: Column, step, told, kind: str) -> Column:
    none, n = F.array().cast(f"array<{kind}>"), F.ceil(F.size(items) / _CHUNK).cast("int")

    def one(acc: Column, x: Column) -> Column:
        return F.struct(step(acc["s"], x).alias("s"), F.array_append(acc["o"], told(acc["s"], x)).alias("o"))

    def chunk(acc: Column, c: Column) -> Column:
        done = F.aggregate(F.slice(items, c * _CHUNK + 1, _CHUNK), F.struct(acc["s"].alias("s"), none.alias("o")), one)
        return F.struct(done["s"].alias("s"), F.array_append(acc["o"], done["o"]).alias("o"))

    first = F.struct(start.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("o"))
    return F.when(n > 0, F.flatten(F.aggregate(F.sequence(F.lit(0), n - 1), first, chunk, lambda acc: acc["o"]))).otherwise(F.when(n == 0, none))
