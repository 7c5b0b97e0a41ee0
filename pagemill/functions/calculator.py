"""Document functions of numbers: calculator programs (compiled to one Column), exponential, stitched and sampled ones."""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"%[^\r\n]*|[{}]|[^\s{}%]+")


class ProgramError(ValueError):
    """A program whose stack depends on the data, or that isn't closed."""


def parse(source: str) -> list:
    """Numbers, operator names, and lists for procedures."""
    stack: list[list] = [[]]
    for token in _TOKEN.findall(source):
        if token.startswith("%"):
            continue
        if token == "{":
            stack.append([])
        elif token == "}":
            if len(stack) == 1:
                raise ProgramError("unmatched }")
            done = stack.pop()
            stack[-1].append(done)
        else:
            try:
                stack[-1].append(float(token))
            except ValueError:
                stack[-1].append(token)
    if len(stack) != 1 or not stack[0] or not isinstance(stack[0][0], list):
        raise ProgramError("a program is one procedure")
    return stack[0][0]


def _whole(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("bigint")


def _guarded(f):
    """Division-like operators give 0 for a zero divisor."""
    return lambda a, b: F.when(b == 0, 0.0).otherwise(f(a, F.when(b != 0, b)).cast("double"))


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def _degrees(a: Column, b: Column) -> Column:
    angle = F.degrees(F.atan2(a, b))
    return F.when(angle < 0, angle + 360.0).otherwise(angle)


_TWO = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": _guarded(lambda a, b: a / b),
    "idiv": lambda a, b: F.when(_whole(b) == 0, 0.0).otherwise(_whole(_whole(a) / F.when(_whole(b) != 0, _whole(b))).cast("double")),
    "mod": lambda a, b: F.when(_whole(b) == 0, 0.0).otherwise((_whole(a) % F.when(_whole(b) != 0, _whole(b))).cast("double")),
    "atan": _degrees, "exp": lambda a, b: F.pow(a, b),
    "eq": lambda a, b: _flag(a == b), "ne": lambda a, b: _flag(a != b), "gt": lambda a, b: _flag(a > b), "ge": lambda a, b: _flag(a >= b), "lt": lambda a, b: _flag(a < b), "le": lambda a, b: _flag(a <= b),
    "and": lambda a, b: _whole(a).bitwiseAND(_whole(b)).cast("double"), "or": lambda a, b: _whole(a).bitwiseOR(_whole(b)).cast("double"), "xor": lambda a, b: _whole(a).bitwiseXOR(_whole(b)).cast("double"),
}
_ONE = {
    "neg": lambda a: -a, "abs": F.abs, "sqrt": lambda a: F.sqrt(F.greatest(a, F.lit(0.0))), "sin": lambda a: F.sin(F.radians(a)), "cos": lambda a: F.cos(F.radians(a)),
    "ln": lambda a: F.when(a <= 0, 0.0).otherwise(F.log(F.when(a > 0, a))), "log": lambda a: F.when(a <= 0, 0.0).otherwise(F.log10(F.when(a > 0, a))),
    "ceiling": lambda a: F.ceil(a).cast("double"), "floor": lambda a: F.floor(a).cast("double"), "round": lambda a: F.round(a, 0), "truncate": lambda a: _whole(a).cast("double"), "cvi": lambda a: _whole(a).cast("double"), "cvr": lambda a: a,
    "not": lambda a: F.when(a == 0, 1.0).when(a == 1, 0.0).otherwise(F.bitwise_not(_whole(a)).cast("double")),
}


def calculator(source: str, inputs: Sequence[Column], limits: Sequence[tuple[float, float]], domain: Sequence[tuple[float, float]] | None = None) -> list[Column]:
    """The outputs of a stack program over input columns, each kept within its limits: one Column per output.

    The program runs here, over expressions: operators that move the stack need literal counts, and both sides of a
    conditional must leave equally many values. Operators with too few operands do nothing; a zero divisor, the root of a
    negative and the logarithm of what isn't positive give 0; angles are in degrees.
    """
    stack: list[tuple[Column, float | None]] = []

    def number(default: int | None = None) -> int:
        _, known = stack.pop()
        if known is None:
            raise ProgramError("a stack operator's count depends on the data")
        return int(known)

    def run(block: list, held: list[list]) -> None:
        nonlocal stack
        for item in block:
            if isinstance(item, list):
                held.append(item)
            elif isinstance(item, float):
                stack.append((F.lit(item), item))
            elif item in ("true", "false"):
                stack.append((F.lit(float(item == "true")), float(item == "true")))
            elif item in _TWO or item == "bitshift":
                if len(stack) >= 2:
                    if item == "bitshift":
                        by = number()
                        a = _whole(stack.pop()[0])
                        stack.append(((F.shiftleft(a, by) if by >= 0 else F.shiftright(a, -by)).cast("double"), None))
                    else:
                        (b, _), (a, _) = stack.pop(), stack.pop()
                        stack.append((_TWO[item](a, b), None))
            elif item in _ONE:
                if stack:
                    a, known = stack.pop()
                    stack.append((_ONE[item](a), -known if item == "neg" and known is not None else None))
            elif item == "pop":
                del stack[-1:]
            elif item == "exch":
                stack[-2:] = stack[-2:][::-1]
            elif item == "dup":
                stack += stack[-1:]
            elif item == "copy" and stack:
                n = number()
                if 0 < n <= len(stack):
                    stack += stack[-n:]
            elif item == "index" and stack:
                n = number()
                stack.append(stack[-1 - n] if 0 <= n < len(stack) else (F.lit(0.0), 0.0))
            elif item == "roll" and len(stack) >= 2:
                j, n = number(), number()
                if 0 < n <= len(stack):
                    top = stack[-n:]
                    stack[-n:] = top[-(j % n) :] + top[: n - j % n] if j % n else top
            elif item == "if" and held and stack:
                branch(stack.pop()[0], held.pop(), [])
            elif item == "ifelse" and len(held) >= 2 and stack:
                other = held.pop()
                branch(stack.pop()[0], held.pop(), other)

    def branch(condition: Column, yes: list, no: list) -> None:
        nonlocal stack
        before = stack
        stack = list(before)
        run(yes, [])
        one, stack = stack, list(before)
        run(no, [])
        if len(one) != len(stack):
            raise ProgramError("the sides of a conditional leave different numbers of values")
        stack = [a if a is b else (F.when(condition != 0, a[0]).otherwise(b[0]), None) for a, b in zip(one, stack, strict=True)]

    for k, c in enumerate(inputs):
        c = c.cast("double")
        stack.append((_within(c, domain[k]) if domain else c, None))
    run(parse(source), [])
    out = [x for x, _ in stack[-len(limits) :]] if limits else []
    out = [F.lit(0.0)] * (len(limits) - len(out)) + out
    return [_within(c, lim) for c, lim in zip(out, limits, strict=True)]


def _within(c: Column, limit: tuple[float, float]) -> Column:
    return F.least(F.greatest(c, F.lit(float(limit[0]))), F.lit(float(limit[1])))


def exponential(x: Column, c0: Sequence[float], c1: Sequence[float], n: float) -> list[Column]:
    """c0 + x^n * (c1 - c0), for each pair."""
    return [F.lit(float(a)) + F.pow(x.cast("double"), F.lit(float(n))) * F.lit(float(b) - float(a)) for a, b in zip(c0, c1, strict=True)]


def stitched(x: Column, functions: Sequence, bounds: Sequence[float], encode: Sequence[tuple[float, float]], domain: tuple[float, float]) -> Column:
    """The function (Column to Column) of the interval that x is in, over x mapped from that interval to its encoding."""
    x = _within(x.cast("double"), domain)
    edges = [float(domain[0]), *map(float, bounds), float(domain[1])]
    out = None
    for k in reversed(range(len(functions))):
        low, high = edges[k], edges[k + 1]
        e0, e1 = map(float, encode[k])
        at = F.lit(e0) if high == low else F.lit(e0) + (x - low) * ((e1 - e0) / (high - low))
        value = functions[k](at)
        out = value if out is None else F.when(x < high, value).otherwise(out)
    return out


def sampled(inputs: Sequence[Column], sizes: Sequence[int], table: Sequence[float], domain: Sequence[tuple[float, float]]) -> Column:
    """Multilinear interpolation in a table whose first dimension varies fastest; inputs are kept within the domain."""
    values = F.array(*[F.lit(float(v)) for v in table])
    places = []
    for x, n, (low, high) in zip(inputs, sizes, domain, strict=True):
        e = (_within(x.cast("double"), (low, high)) - float(low)) * ((n - 1) / (float(high) - float(low)))
        cell = F.least(F.floor(e), F.lit(max(0, n - 2))).cast("int")
        places.append((cell, e - cell, n))
    out = F.lit(0.0)
    for corner in itertools.product((0, 1), repeat=len(places)):
        at, weight, step = F.lit(0), F.lit(1.0), 1
        for up, (cell, share, n) in zip(corner, places, strict=True):
            at = at + F.least(cell + up, F.lit(n - 1)) * step
            weight = weight * (share if up else 1 - share)
            step *= n
        out = out + weight * F.element_at(values, at + 1)
    return out
