"""The graphics of content streams: what each painting operator paints, where, and in what state."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pagemill.sources.pdf import Malformed, Parser, Pdf, Stream, _times

_PAINT = {"f": "f", "F": "f", "f*": "f", "S": "s", "s": "s", "B": "fs", "B*": "fs", "b": "fs", "b*": "fs", "n": ""}
_SPACES = {"g": ("DeviceGray", 1), "rg": ("DeviceRGB", 3), "k": ("DeviceCMYK", 4)}
DEEPEST_FORM = 16


@dataclass(frozen=True)
class State:
    """The part of the graphics state that a painted thing shows. Colours are a space and its numbers, as text."""

    ctm: tuple = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    fill: str = "DeviceGray 0"
    stroke: str = "DeviceGray 0"
    width: float = 1.0
    cap: int = 0
    join: int = 0
    miter: float = 10.0
    dash: str = ""
    alpha: float = 1.0
    clips: int = 0
    font: str = ""
    size: float = 0.0


@dataclass
class Painted:
    """op: the operator. kind: path, text, image, inline or shading. paint: f, s or fs. box: x0, y0, x1, y1 on the page; segments: of a path."""

    op: str
    kind: str
    paint: str
    box: tuple[float, float, float, float]
    state: State
    obj_no: int | None = None
    segments: int = 0


def _box(points, m):
    xs, ys = zip(*[(m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]) for x, y in points], strict=True)
    return min(xs), min(ys), max(xs), max(ys)


def _colour(space: str, args: list) -> str:
    return " ".join([space, *(f"{a:g}" for a in args if isinstance(a, int | float)), *(f"/{a}" for a in args if isinstance(a, str))])


def walk(pdf: Pdf, content: bytes, resources: dict, state: State | None = None, depth: int = 0, limit: int = 1_000_000) -> Iterator[Painted]:
    """What a content stream paints, in order, form objects included. An operator with bad operands does nothing."""
    g, saved, args = state or State(), [], []
    path: list[tuple[float, float]] = []
    segments, at, start, clip = 0, (0.0, 0.0), (0.0, 0.0), False
    spaces = {"fill": "DeviceGray", "stroke": "DeviceGray"}
    tm = tlm = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    leading, done = 0.0, 0
    p = Parser(content)

    def named(kind: str, name):
        table = pdf.get(resources.get(kind)) or {}
        ref = table.get(str(name))
        return (ref[0] if isinstance(ref, tuple) else None), pdf.get(ref)

    while True:
        t = p.next()
        if t[0] == "end":
            return
        if t[0] != "word" or t[1] in ("true", "false", "null"):
            p.held.append(t)
            try:
                args.append(p.value())
            except Malformed:
                return
            continue
        done += 1
        if done > limit:
            raise Malformed("too many operators")
        op, operands, args = str(t[1]), args, []
        try:
            n = [float(a) for a in operands] if op in _NUMBERS else []
            if op == "q":
                saved.append((g, dict(spaces)))
            elif op == "Q" and saved:
                g, spaces = saved.pop()
            elif op == "cm":
                g = replace(g, ctm=_times(tuple(n[-6:]), g.ctm))
            elif op == "w":
                g = replace(g, width=n[-1])
            elif op in ("J", "j"):
                g = replace(g, **{"cap" if op == "J" else "join": int(n[-1])})
            elif op == "M":
                g = replace(g, miter=n[-1])
            elif op == "d":
                g = replace(g, dash=" ".join(f"{x:g}" for x in [*operands[-2], operands[-1]]) if operands[-2] else "")
            elif op.lower() in _SPACES:
                space, count = _SPACES[op.lower()]
                side = "fill" if op.islower() else "stroke"
                spaces[side] = space
                g = replace(g, **{side: _colour(space, n[-count:])})
            elif op in ("cs", "CS"):
                side = "fill" if op == "cs" else "stroke"
                spaces[side] = str(operands[-1])
                g = replace(g, **{side: _colour(spaces[side], [0] if spaces[side] in ("DeviceGray", "DeviceRGB", "DeviceCMYK") else [])})
            elif op in ("sc", "scn", "SC", "SCN"):
                side = "fill" if op.islower() else "stroke"
                g = replace(g, **{side: _colour(spaces[side], operands)})
            elif op == "gs":
                _, d = named("ExtGState", operands[-1])
                d = d if isinstance(d, dict) else {}
                g = replace(g, width=float(pdf.get(d.get("LW", g.width))), alpha=float(pdf.get(d.get("ca", g.alpha))))
            elif op == "m":
                at = start = (n[-2], n[-1])
                path.append(at)
            elif op == "l":
                at = (n[-2], n[-1])
                path.append(at)
                segments += 1
            elif op in ("c", "v", "y"):
                path += [(n[-k], n[-k + 1]) for k in range(len(n) - len(n) % 2, 0, -2)]
                at = (n[-2], n[-1])
                segments += 1
            elif op == "h":
                segments += at != start
                at = start
            elif op == "re":
                x, y, w, h = n[-4:]
                path += [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
                at = start = (x, y)
                segments += 4
            elif op in ("W", "W*"):
                clip = True
            elif op in _PAINT:
                if path and _PAINT[op]:
                    yield Painted(op, "path", _PAINT[op], _box(path, g.ctm), g, None, segments + (op in ("s", "b", "b*") and at != start))
                if clip:
                    g = replace(g, clips=g.clips + 1)
                path, segments, clip = [], 0, False
            elif op == "sh":
                yield Painted(op, "shading", "f", (0.0, 0.0, 0.0, 0.0), g, named("Shading", operands[-1])[0])
            elif op == "Do":
                number, x = named("XObject", operands[-1])
                kind = x.dict.get("Subtype") if isinstance(x, Stream) else None
                if kind == "Image":
                    yield Painted(op, "image", "f", _box([(0, 0), (1, 0), (1, 1), (0, 1)], g.ctm), g, number)
                elif kind == "Form" and depth < DEEPEST_FORM:
                    m = pdf.get(x.dict.get("Matrix"))
                    inner = replace(g, ctm=_times(tuple(float(pdf.get(v)) for v in m), g.ctm)) if isinstance(m, list) and len(m) == 6 else g
                    own = pdf.get(x.dict.get("Resources"))
                    yield from walk(pdf, pdf.decoded(x), own if isinstance(own, dict) else resources, inner, depth + 1, limit)
            elif op == "BI":
                end = content.find(b"EI", p.end)
                p = Parser(content, end + 2 if end >= 0 else len(content))
                yield Painted(op, "inline", "f", _box([(0, 0), (1, 0), (1, 1), (0, 1)], g.ctm), g)
            elif op == "BT":
                tm = tlm = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
            elif op == "Tf":
                g = replace(g, font=str(operands[-2]), size=float(operands[-1]))
            elif op == "TL":
                leading = n[-1]
            elif op in ("Td", "TD"):
                leading = -n[-1] if op == "TD" else leading
                tm = tlm = _times((1, 0, 0, 1, n[-2], n[-1]), tlm)
            elif op == "Tm":
                tm = tlm = tuple(n[-6:])
            elif op == "T*":
                tm = tlm = _times((1, 0, 0, 1, 0, -leading), tlm)
            elif op in ("Tj", "TJ", "'", '"'):
                if op in ("'", '"'):
                    tm = tlm = _times((1, 0, 0, 1, 0, -leading), tlm)
                m = _times(tm, g.ctm)
                raw = b"".join(x for x in operands[-1] if isinstance(x, bytes)) if op == "TJ" else operands[-1]
                wide = 0.5 * g.size * len(raw)
                if raw:
                    yield Painted(op, "text", "f", _box([(0, 0), (wide, 0), (wide, g.size), (0, g.size)], m), g)
                tm = _times((1, 0, 0, 1, wide, 0), tm)
        except (IndexError, TypeError, ValueError, AttributeError, KeyError):
            continue


_NUMBERS = {"cm", "w", "J", "j", "M", *_SPACES, *(k.upper() for k in _SPACES), "m", "l", "c", "v", "y", "re", "TL", "Td", "TD", "Tm"}


def minified(content: bytes) -> bytes:
    """A content stream less its comments and all white space that separates nothing; strings and inline images byte for byte."""
    out, at, last = bytearray(), 0, b""
    from pagemill.sources.pdf import tokens

    feed = tokens(content)
    for kind, value, start, end in feed:
        raw = content[start:end]
        if kind == "word" and value == "BI":
            stop = content.find(b"EI", end)
            stop = len(content) if stop < 0 else stop + 2
            raw, feed_at = content[start:stop], stop
            out += (b" " if out and _joins(last, raw) else b"") + raw
            out += _rest(minified(content[feed_at:]), raw)
            return bytes(out)
        if out and _joins(last, raw):
            out += b" "
        out += raw
        last, at = raw, end
    return bytes(out)


def _rest(more: bytes, raw: bytes) -> bytes:
    return (b"\n" if more and _joins(raw, more) else b"") + more


_CLOSED = b"()<>[]{}/%"


def _joins(a: bytes, b: bytes) -> bool:
    """Whether two tokens would be read as one if nothing stood between them."""
    return bool(a) and bool(b) and a[-1] not in b")>]}[{" and b[0] not in _CLOSED or a[-1:] in b"/" and bool(b) and b[0] not in _CLOSED


def arrowhead(x0: float, y0: float, x1: float, y1: float, length: float, spread: float = 30.0) -> list[tuple[float, float]]:
    """The points of an arrow's head at (x1, y1): one wing, the tip, the other wing. A line without length has its tip alone."""
    wide = math.hypot(x1 - x0, y1 - y0)
    if not wide:
        return [(x1, y1)]
    back, half = math.atan2(y0 - y1, x0 - x1), math.radians(spread)
    return [(x1 + length * math.cos(back + s * half), y1 + length * math.sin(back + s * half)) if s else (x1, y1) for s in (1, 0, -1)]
