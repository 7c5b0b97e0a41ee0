"""FormCalc: its functions as Column expressions, and a compiler from scripts without loops to one Column.

Every value is a string, a number (double, NaN for what is no number), a boolean, or undefined. The kind of each
subexpression is known when it is compiled, so that coercions become plain casts. Scripts with loops run row by row in
interpret().
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def to_number(text: Column) -> Column:
    """A number with optional sign, thousands commas, decimal point and exponent, white space round it ignored; else NaN."""
    bare = F.replace(F.trim(text), F.lit(","), F.lit(""))
    return F.coalesce(F.when(bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), bare.try_cast("double")), F.lit(NAN))


def number_text(x: Column) -> Column:
    """Whole numbers without a decimal point, NaN as "NaN"; null as ""."""
    whole = (x == F.floor(x)) & (F.abs(x) < 9.2e18)
    return F.coalesce(F.when(F.isnan(x), "NaN").when(whole, F.when(whole, x).cast("bigint").cast("string")).otherwise(x.cast("string")), F.lit(""))


def _clamp(n: Column) -> Column:
    """A count: truncated, at least 0; NaN is 0."""
    return F.greatest(F.when(F.isnan(n), 0).otherwise(n).cast("bigint"), F.lit(0)).cast("int")


def left(s: Column, n: Column) -> Column:
    return F.substring(s, F.lit(1), _clamp(n))


def right(s: Column, n: Column) -> Column:
    n = F.least(_clamp(n), F.length(s))
    return F.substring(s, F.length(s) - n + 1, n)


def length(s: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("double")


def substr(s: Column, start: Column, count: Column) -> Column:
    """From a place counted from 1 (below 1: from 1)."""
    return F.substring(s, F.greatest(_clamp(start), F.lit(1)), _clamp(count))


def at(s: Column, part: Column) -> Column:
    """The place of part in s from 1, 0 if it isn't there."""
    return F.instr(s, part).cast("double")


def replace(s: Column, old: Column, new: Column) -> Column:
    return F.when(F.length(old) > 0, F.replace(s, old, new)).otherwise(s)


def stuff(s: Column, start: Column, count: Column, new: Column) -> Column:
    """s with count characters from a place counted from 1 replaced; places and counts are kept within s."""
    at_ = F.least(F.greatest(_clamp(start), F.lit(1)), F.length(s) + 1)
    n = F.least(_clamp(count), F.length(s) - at_ + 1)
    return F.concat(F.substring(s, F.lit(1), at_ - 1), new, F.substring(s, at_ + n, F.length(s)))


def space(n: Column) -> Column:
    return F.repeat(F.lit(" "), _clamp(n))


def _numbers(xs: list[Column]) -> Column:
    return F.filter(F.array(*xs), lambda x: ~F.isnan(x))


def fc_sum(xs: list[Column]) -> Column:
    """Sum of the numbers among xs; others are passed over."""
    return F.aggregate(_numbers(xs), F.lit(0.0), lambda a, x: a + x) if xs else F.lit(0.0)


def fc_avg(xs: list[Column]) -> Column:
    """Sum of the numbers over the count of all arguments, numbers or not."""
    return fc_sum(xs) / len(xs) if xs else F.lit(0.0)


def fc_min(xs: list[Column]) -> Column:
    return F.coalesce(F.array_min(_numbers(xs)), F.lit(0.0)) if xs else F.lit(0.0)


def fc_max(xs: list[Column]) -> Column:
    return F.coalesce(F.array_max(_numbers(xs)), F.lit(0.0)) if xs else F.lit(0.0)


def fc_round(x: Column, digits: int = 0) -> Column:
    """Half away from zero."""
    return F.round(x, max(0, digits))


def divide(a: Column, b: Column) -> Column:
    """IEEE division: infinities and NaN instead of errors."""
    inf = F.lit(float("inf"))
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, inf).otherwise(-inf)
    return F.when(b == 0, by_zero).otherwise(a / F.when(b != 0, b))


# -- the language ----------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r'\s+|(?P<str>"[^"]*")|(?P<num>\.?[0-9][\w.]*)|(?P<id>[^\W\d][\w$!]*|[$_][\w$!]*)|(?P<op><>|<=|>=|==|.)', re.S)
_WORDS = {"if", "then", "elseif", "else", "endif", "for", "do", "endfor", "while", "endwhile", "and", "or", "not", "null", "upto", "downto", "step"}
_DEEPEST, _MOST_ROUNDS = 100, 100_000
#: Binary operators, loosest first.
_LEVELS = (("or", "|"), ("and",), ("==", "<>"), ("<", ">", "<=", ">="), ("&",), ("+", "-"), ("*", "/"))


class ScriptError(ValueError):
    """A script that can't be read or run."""


def parse(source: str) -> list[tuple]:
    """Statements as tuples: ("lit", value), ("ref", path), ("call", name, args), ("un", op, x), ("bin", op, x, y), ("set", path, x),
    ("if", condition, then, else), ("for", name, from, to, down, body), ("while", condition, body)."""
    tokens: list[tuple[str, str]] = []
    for m in _TOKEN.finditer(source):
        if m.lastgroup == "str":
            tokens.append(("str", m[0][1:-1]))
        elif m.lastgroup == "id" and m[0].lower() in _WORDS:
            tokens.append(("word", m[0].lower()))
        elif m.lastgroup:
            tokens.append((m.lastgroup, m[0]))
    tokens.append(("end", ""))
    at, depth = 0, 0

    def peek(*texts: str) -> bool:
        return tokens[at][0] in ("op", "word") and tokens[at][1] in texts

    def take() -> tuple[str, str]:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def need(text: str) -> None:
        if not peek(text):
            raise ScriptError(f"expected {text!r}, found {tokens[at][1]!r}")
        take()

    def block(*ends: str) -> list[tuple]:
        out = []
        while True:
            while peek(";"):
                take()
            if tokens[at][0] == "end" or peek(*ends):
                return out
            out.append(statement())

    def statement() -> tuple:
        nonlocal at, depth
        depth += 1
        if depth > _DEEPEST:
            raise ScriptError(f"nested more than {_DEEPEST} deep")
        try:
            if peek("if", "elseif"):
                take()
                condition = expression(0)
                need("then")
                then = block("elseif", "else", "endif")
                if peek("elseif"):
                    return ("if", condition, then, [statement()])
                other = []
                if peek("else"):
                    take()
                    other = block("endif")
                if peek("endif"):
                    take()
                return ("if", condition, then, other)
            if peek("for"):
                take()
                name = take()[1]
                need("=")
                first = expression(0)
                if not peek("upto", "downto"):
                    raise ScriptError("expected upto or downto")
                down = take()[1] == "downto"
                last = expression(0)
                need("do")
                body = block("endfor")
                need("endfor")
                return ("for", name, first, last, down, body)
            if peek("while"):
                take()
                condition = expression(0)
                need("do")
                body = block("endwhile")
                need("endwhile")
                return ("while", condition, body)
            if tokens[at][0] == "id":
                back, target = at, unary()
                if target[0] == "ref" and peek("="):
                    take()
                    return ("set", target[1], statement() if peek("if", "for", "while") else expression(0))
                at = back
            return expression(0)
        finally:
            depth -= 1

    def expression(level: int) -> tuple:
        if level == len(_LEVELS):
            return unary()
        out = expression(level + 1)
        while peek(*_LEVELS[level]):
            op = take()[1]
            out = ("bin", "or" if op == "|" else op, out, expression(level + 1))
        return out

    def unary() -> tuple:
        nonlocal depth
        if peek("not", "-", "+"):
            depth += 1
            if depth > _DEEPEST:
                raise ScriptError(f"nested more than {_DEEPEST} deep")
            out = ("un", take()[1], unary())
            depth -= 1
            return out
        kind, text = take()
        if kind == "num":
            try:
                return ("lit", float(text))
            except ValueError:
                raise ScriptError(f"bad number {text}") from None
        if kind == "str":
            return ("lit", text)
        if (kind, text) == ("word", "null"):
            return ("lit", None)
        if (kind, text) == ("op", "("):
            depth += 1
            if depth > _DEEPEST:
                raise ScriptError(f"nested more than {_DEEPEST} deep")
            out = expression(0)
            depth -= 1
            need(")")
            return out
        if kind != "id":
            raise ScriptError(f"unexpected {text!r}")
        if peek("("):
            take()
            args = []
            if not peek(")"):
                args.append(expression(0))
                while peek(","):
                    take()
                    args.append(expression(0))
            need(")")
            return ("call", text.lower(), args)
        while peek(".", "!"):
            take()
            text += "." + take()[1]
        return ("ref", text)

    out = block()
    return out


@dataclass(frozen=True)
class Typed:
    """A compiled value: kind is str, num, bool or none."""

    kind: str
    column: Column

    def text(self) -> Column:
        if self.kind == "num":
            return number_text(self.column)
        if self.kind == "bool":
            return F.when(self.column, "true").otherwise("false")
        return F.coalesce(self.column, F.lit("")) if self.kind == "str" else F.lit("")

    def number(self) -> Column:
        if self.kind == "num":
            return F.coalesce(self.column, F.lit(NAN))
        if self.kind == "bool":
            return F.when(self.column, 1.0).otherwise(0.0)
        return to_number(self.column) if self.kind == "str" else F.lit(NAN)

    def truth(self) -> Column:
        if self.kind == "num":
            return F.coalesce((self.column != 0) & ~F.isnan(self.column), F.lit(False))
        if self.kind == "bool":
            return F.coalesce(self.column, F.lit(False))
        return F.coalesce(F.length(self.column) > 0, F.lit(False)) if self.kind == "str" else F.lit(False)


def compile_script(source: str, columns: dict[str, Typed]) -> tuple[Typed, dict[str, Typed]]:
    """The value of a script without loops, and what it assigns, as Columns over `columns` (names as scripts write them).

    A name that is neither assigned nor a column is undefined. Branches that assign differently become conditions on the value.
    """
    scope = dict(columns)

    def merged(c: Column, a: Typed, b: Typed) -> Typed:
        if a.kind == b.kind:
            return Typed(a.kind, F.when(c, a.column).otherwise(b.column))
        if "none" in (a.kind, b.kind):
            k = b.kind if a.kind == "none" else a.kind
            return Typed(k, F.when(c, a.column if a.kind == k else F.lit(None)).otherwise(b.column if b.kind == k else F.lit(None)))
        return Typed("str", F.when(c, a.text()).otherwise(b.text()))

    def run(statements: list[tuple], names: dict[str, Typed]) -> Typed:
        out = Typed("none", F.lit(None))
        for s in statements:
            out = value(s, names)
        return out

    def value(x: tuple, names: dict[str, Typed]) -> Typed:
        what = x[0]
        if what == "lit":
            return Typed("none", F.lit(None)) if x[1] is None else Typed("str" if isinstance(x[1], str) else "num", F.lit(x[1]))
        if what == "ref":
            path = x[1].removesuffix(".rawValue").removesuffix(".value")
            return names.get(path, names.get(path.rpartition(".")[2], Typed("none", F.lit(None))))
        if what == "un":
            a = value(x[2], names)
            return Typed("bool", ~a.truth()) if x[1] == "not" else Typed("num", -a.number() if x[1] == "-" else a.number())
        if what == "bin":
            return binary(x[1], value(x[2], names), value(x[3], names))
        if what == "call":
            return call(x[1], [value(a, names) for a in x[2]])
        if what == "set":
            names[x[1].removesuffix(".rawValue").removesuffix(".value")] = out = value(x[2], names)
            return out
        if what == "if":
            c = value(x[1], names).truth()
            yes, no = dict(names), dict(names)
            a, b = run(x[2], yes), run(x[3], no)
            for k in {*yes, *no}:
                none = Typed("none", F.lit(None))
                one, other = yes.get(k, none), no.get(k, none)
                names[k] = one if one is other else merged(c, one, other)
            return merged(c, a, b)
        raise ScriptError("loops don't compile to a Column; use interpret()")

    def binary(op: str, a: Typed, b: Typed) -> Typed:
        if op == "and":
            return Typed("bool", a.truth() & b.truth())
        if op == "or":
            return Typed("bool", a.truth() | b.truth())
        if op == "&":
            return Typed("str", F.concat(a.text(), b.text()))
        x, y = a.number(), b.number()
        if op in "+-*/":
            return Typed("num", x + y if op == "+" else x - y if op == "-" else x * y if op == "*" else divide(x, y))
        s, t = a.text(), b.text()
        as_numbers = ~F.isnan(x) & ~F.isnan(y)
        by = {"==": lambda p, q: p == q, "<>": lambda p, q: p != q, "<": lambda p, q: p < q, ">": lambda p, q: p > q, "<=": lambda p, q: p <= q, ">=": lambda p, q: p >= q}[op]
        return Typed("bool", F.when(as_numbers, by(x, y)).otherwise(by(s, t)))

    def call(name: str, args: list[Typed]) -> Typed:
        s = lambda k: args[k].text() if k < len(args) else F.lit("")
        n = lambda k: args[k].number() if k < len(args) else F.lit(NAN)
        numbers = [a.number() for a in args]
        many = len(args)
        text = {
            "concat": lambda: F.concat(*[a.text() for a in args], F.lit("")), "left": lambda: left(s(0), n(1)) if many > 1 else s(0), "right": lambda: right(s(0), n(1)) if many > 1 else s(0),
            "upper": lambda: F.upper(s(0)), "lower": lambda: F.lower(s(0)), "substr": lambda: substr(s(0), n(1), n(2)) if many > 2 else F.lit(""),
            "replace": lambda: replace(s(0), s(1), s(2)) if many > 2 else s(0), "stuff": lambda: stuff(s(0), n(1), n(2), s(3)), "space": lambda: space(n(0)),
        }
        number = {
            "len": lambda: length(s(0)), "sum": lambda: fc_sum(numbers), "avg": lambda: fc_avg(numbers), "min": lambda: fc_min(numbers), "max": lambda: fc_max(numbers),
            "abs": lambda: F.abs(n(0)), "at": lambda: at(s(0), s(1)), "round": lambda: fc_round(n(0)),
        }
        if name in text:
            return Typed("str", text[name]())
        if name == "round" and many > 1:
            return Typed("num", _round_by(n(0), n(1)))
        if name in number:
            return Typed("num", number[name]())
        return Typed("none", F.lit(None))

    result = run(parse(source), scope)
    return result, {k: t for k, t in scope.items() if columns.get(k) is not t}


def _round_by(x: Column, digits: Column) -> Column:
    """Rounding to a number of digits that differs by row (0 to 15)."""
    out = F.round(x, 0)
    for d in range(1, 16):
        out = F.when(_clamp(digits) == d, F.round(x, d)).otherwise(out)
    return out


# -- loops -----------------------------------------------------------------------------------------------------------


def _number(v) -> float:
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, float):
        return v
    if isinstance(v, str):
        text = v.strip().replace(",", "")
        return float(text) if re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", text) else NAN
    return NAN


def _text(v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else str(int(v)) if math.isfinite(v) and v == math.floor(v) else repr(v)
    return v


def _truth(v) -> bool:
    return v != 0 and not math.isnan(v) if isinstance(v, float) else bool(v)


def _count(x: float) -> int:
    return 0 if math.isnan(x) else max(0, int(min(x, 1e9)))


def remembered(parse):
    """parse, with what it gave for the last 1,024 sources, or its error, kept: forms of one make share their scripts."""
    @lru_cache(1024)
    def known(source: str):
        try:
            return parse(source), None
        except ScriptError as e:
            return None, str(e)

    def get(source: str) -> list[tuple]:
        statements, error = known(source)
        if error is not None:
            raise ScriptError(error)
        return statements

    return get


_statements = remembered(parse)


def interpret(source: str, values: dict[str, object]):
    """Runs any script over one row's values; returns its last value and the values after it. A loop of over 100,000 rounds is an error."""
    names = {k: float(v) if isinstance(v, int) and not isinstance(v, bool) else v for k, v in values.items()}

    def run(statements):
        out = None
        for s in statements:
            out = value(s)
        return out

    def loop(more, body):
        out = None
        for n, _ in enumerate(more):
            if n >= _MOST_ROUNDS:
                raise ScriptError("too many rounds")
            out = run(body)
        return out

    def counted(name, first, last, down):
        while first >= last if down else first <= last:
            names[name] = first
            yield
            first += -1 if down else 1

    def whilst(condition):
        while _truth(value(condition)):
            yield

    def value(x):
        what = x[0]
        if what == "lit":
            return x[1]
        if what == "ref":
            path = x[1].removesuffix(".rawValue").removesuffix(".value")
            return names.get(path, names.get(path.rpartition(".")[2]))
        if what == "un":
            a = value(x[2])
            return not _truth(a) if x[1] == "not" else -_number(a) if x[1] == "-" else _number(a)
        if what == "set":
            names[x[1].removesuffix(".rawValue").removesuffix(".value")] = out = value(x[2])
            return out
        if what == "if":
            return run(x[2] if _truth(value(x[1])) else x[3])
        if what == "for":
            return loop(counted(x[1], _number(value(x[2])), _number(value(x[3])), x[4]), x[5])
        if what == "while":
            return loop(whilst(x[1]), x[2])
        if what == "call":
            return _call(x[1], [value(a) for a in x[2]])
        op, a = x[1], value(x[2])
        if op == "and":
            return _truth(a) and _truth(value(x[3]))
        if op == "or":
            return _truth(a) or _truth(value(x[3]))
        b = value(x[3])
        if op == "&":
            return _text(a) + _text(b)
        p, q = _number(a), _number(b)
        if op in "+-*":
            return p + q if op == "+" else p - q if op == "-" else p * q
        if op == "/":
            return p / q if q else NAN if math.isnan(p) or p == 0 else math.inf if p > 0 else -math.inf
        if math.isnan(p) or math.isnan(q):
            p, q = _text(a), _text(b)
        return {"==": p == q, "<>": p != q, "<": p < q, ">": p > q, "<=": p <= q, ">=": p >= q}[op]

    return run(_statements(source)), names


def _call(name, args):
    s = lambda k: _text(args[k]) if k < len(args) else ""
    n = lambda k: _number(args[k]) if k < len(args) else NAN
    xs = [v for v in map(_number, args) if not math.isnan(v)]
    if name == "concat":
        return "".join(map(_text, args))
    if name in ("left", "right"):
        if len(args) < 2:
            return s(0)
        k = min(_count(n(1)), len(s(0)))
        return s(0)[:k] if name == "left" else s(0)[len(s(0)) - k :]
    if name in ("upper", "lower"):
        return getattr(s(0), name)()
    if name == "len":
        return float(len(s(0).encode("utf-16-be")) // 2)
    if name == "substr":
        at_ = max(_count(n(1)), 1)
        return s(0)[at_ - 1 : at_ - 1 + _count(n(2))] if len(args) > 2 else ""
    if name == "at":
        return float(s(0).find(s(1)) + 1)
    if name == "replace":
        return s(0).replace(s(1), s(2)) if len(args) > 2 and s(1) else s(0)
    if name == "stuff":
        at_ = min(max(_count(n(1)), 1), len(s(0)) + 1)
        return s(0)[: at_ - 1] + s(3) + s(0)[at_ - 1 + _count(n(2)) :]
    if name == "space":
        return " " * _count(n(0))
    if name == "abs":
        return abs(n(0))
    if name == "round":
        d = _count(n(1))
        return math.copysign(math.floor(abs(n(0)) * 10**d + 0.5) / 10**d, n(0)) if math.isfinite(n(0)) else n(0)
    if name == "sum":
        return float(sum(xs))
    if name == "avg":
        return sum(xs) / len(args) if args else 0.0
    if name in ("min", "max"):
        return {"min": min, "max": max}[name](xs, default=0.0)
    return None
