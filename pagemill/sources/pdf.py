"""Reading documents: bytes to objects, pages and positioned text, one file per row, as Arrow-batched generators.

A damaged file gives rows with an error, not a failed job. Limits bound what one file may cost.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.codecs import decode_chain

_TOKEN = re.compile(rb"[\x00\t\n\x0c\r ]*(?:%[^\r\n]*|(?P<dict><<|>>)|<(?P<hex>[0-9A-Fa-f\x00\t\n\x0c\r ]*)>|(?P<open>\()|/(?P<name>[^\x00\t\n\x0c\r ()<>\[\]{}/%]*)|(?P<mark>[\[\]{}])|(?P<word>[^\x00\t\n\x0c\r ()<>\[\]{}/%]+)|(?P<stray>.))", re.S)
_ENTRIES = re.compile(rb"([\x00\t\n\x0c\r ]*)(?:\d{10} \d{5} [nf][ \r][\r\n])*")
_NUMBER = re.compile(rb"[+-]?(\d+\.?\d*|\.\d+)$")
_PLAIN = re.compile(rb"([^()\\]*)\)")
_DIGITS = b"+-.0123456789"
_ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}
DEEPEST = 256


class Name(str):
    """A name object."""


class Ref(tuple):
    """(object number, generation)."""


@dataclass
class Stream:
    dict: dict
    raw: bytes


class Word(str):
    """A keyword or operator."""


class Malformed(ValueError):
    pass


def string_token(data: bytes, at: int) -> tuple[bytes, int]:
    """The bytes of a literal string that opens before `at`, and where it ends."""
    if plain := _PLAIN.match(data, at):
        return plain[1], plain.end()
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at]
        at += 1
        if c == 92 and at < len(data):
            e = data[at]
            at += 1
            if e in b"01234567":
                digits = re.match(rb"[0-7]{1,3}", data[at - 1 : at + 2])[0]
                out.append(int(digits, 8) & 255)
                at += len(digits) - 1
            elif e == 13:
                at += data[at : at + 1] == b"\n"
            elif e != 10:
                out.append(_ESCAPES.get(e, e))
            continue
        if c == 40:
            depth += 1
        elif c == 41:
            depth -= 1
            if not depth:
                break
        out.append(c)
    return bytes(out), at


@lru_cache(4096)
def _name(raw: bytes) -> Name:
    return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes.fromhex(h[1].decode()), raw).decode("latin-1"))


def tokens(data: bytes, at: int = 0) -> Iterator[tuple[str, object, int, int]]:
    """(kind, value, start, end) of the tokens from a place on: kind is number, string, name, word or mark."""
    match, end = _TOKEN.match, len(data)
    while at < end:
        m = match(data, at)
        kind, at = m.lastgroup, m.end()
        if kind == "word":
            word, start = m["word"], m.start("word")
            if word[0] in _DIGITS and _NUMBER.match(word):
                yield "number", float(word) if b"." in word else int(word), start, at
            else:
                yield "word", Word(word.decode("latin-1")), start, at
        elif kind == "name":
            raw = m["name"]
            yield "name", _name(raw) if len(raw) <= 64 else _name.__wrapped__(raw), m.start("name") - 1, at
        elif kind == "dict" or kind == "mark":
            yield "mark", m[kind].decode(), m.start(kind), at
        elif kind == "open":
            value, at = string_token(data, at)
            yield "string", value, m.start("open"), at
        elif kind == "hex":
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", m["hex"])
            yield "string", bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), m.start("hex") - 1, at


def text_of(value: bytes) -> str:
    """A text string: UTF-16 or UTF-8 with their marks, else one byte a character."""
    if value[:2] in (b"\xfe\xff", b"\xff\xfe"):
        return value.decode("utf-16", "replace")
    return value[3:].decode("utf-8", "replace") if value[:3] == b"\xef\xbb\xbf" else value.decode("latin-1")


class Parser:
    """Objects from tokens, with references recognised two numbers late."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.feed, self.end = data, tokens(data, at), at
        self.held: list = []

    def next(self):
        if self.held:
            return self.held.pop()
        t = next(self.feed, ("end", None, len(self.data), len(self.data)))
        self.end = t[3]
        return t

    def value(self, depth: int = 0):
        kind, v, start, end = t = self.next()
        if depth > DEEPEST:
            raise Malformed("nested too deeply")
        if kind == "number" and isinstance(v, int) and v >= 0:
            second = self.next()
            if second[0] == "number" and isinstance(second[1], int) and second[1] >= 0:
                third = self.next()
                if third[0] == "word" and third[1] == "R":
                    return Ref((v, second[1]))
                self.held.append(third)
            self.held.append(second)
            return v
        if kind == "mark" and v == "<<":
            out = {}
            while True:
                k = self.next()
                if k[0] == "end" or k[1] == ">>" and k[0] == "mark":
                    return out
                if k[0] != "name":
                    continue
                out[str(k[1])] = self.value(depth + 1)
        if kind == "mark" and v == "[":
            out = []
            while True:
                t = self.next()
                if t[0] == "end" or t[0] == "mark" and t[1] == "]":
                    return out
                self.held.append(t)
                out.append(self.value(depth + 1))
        if kind == "word":
            return {"true": True, "false": False, "null": None}.get(v, v)
        if kind == "end":
            raise Malformed("ends early")
        return v


@dataclass
class Entry:
    kind: str
    offset: int
    gen: int
    revision: int
    hybrid: bool = False


@dataclass
class Pdf:
    """A document's index, and its objects as they are asked for."""

    data: bytes
    limit: int = 64 << 20
    index: dict[int, Entry] = field(default_factory=dict)
    sections: list[tuple] = field(default_factory=list)
    trailer: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    cache: dict[int, object] = field(default_factory=dict)
    handler: object = None

    @classmethod
    def open(cls, data: bytes, repair: bool = True, password: str | None = None) -> Pdf:
        """Without a password, strings and streams of an encrypted document stay as they are."""
        pdf = cls._read(data, repair)
        if password is not None and "Encrypt" in pdf.trailer:
            from pagemill.sources.crypt import handler_of

            handler = handler_of(pdf, password)
            pdf.cache, pdf.handler = {}, handler
        return pdf

    @classmethod
    def _read(cls, data: bytes, repair: bool) -> Pdf:
        pdf = cls(data)
        at = data.rfind(b"startxref")
        try:
            m = re.match(rb"startxref\s+(\d+)", data[at : at + 64]) if at >= 0 else None
            if not m:
                raise Malformed("no startxref")
            pdf._chain(int(m[1]))
            if not isinstance(pdf.get(pdf.trailer.get("Root")), dict):
                raise Malformed("no catalog")
        except (Malformed, ValueError, IndexError, zlib.error) as e:
            if not repair:
                raise
            pdf.warnings.append(f"rebuilt: {e}")
            pdf._rebuild()
        return pdf

    def _chain(self, at: int) -> None:
        """Index sections from the newest back; the first entry of an object number counts, free ones too."""
        seen, revision = set(), 0
        while at is not None and at not in seen:
            seen.add(at)
            trailer = self._section(at, revision, False)
            hybrid = trailer.get("XRefStm")
            if isinstance(hybrid, int) and hybrid not in seen:
                seen.add(hybrid)
                mine = self.sections[-1]
                self._section(hybrid, revision, True)
                self.sections[-2:] = [self.sections[-1], mine]
            for k, v in trailer.items():
                self.trailer.setdefault(k, v)
            at, revision = trailer.get("Prev"), revision + 1
        for _, entries in self.sections:
            for number, entry in entries.items():
                self.index.setdefault(number, entry)

    def _section(self, at: int, revision: int, hybrid: bool) -> dict:
        if self.data[at : at + 4] == b"xref":
            entries, p = {}, Parser(self.data, at + 4)
            while True:
                kind, first, *_ = p.next()
                if kind != "number":
                    break
                count = p.next()[1]
                if not isinstance(first, int) or not isinstance(count, int):
                    raise Malformed("an index section is no numbers")
                plain = _ENTRIES.match(self.data, p.end) if not p.held else None
                if plain and 0 <= 20 * count <= plain.end() - plain.end(1):
                    at = plain.end(1)
                    for k in range(count):
                        row = self.data[at + 20 * k : at + 20 * k + 18]
                        entries.setdefault(first + k, Entry("offset" if row[17:] == b"n" else "free", int(row[:10]), int(row[11:16]), revision, hybrid))
                    p = Parser(self.data, at + 20 * count)
                    continue
                for k in range(count):
                    offset, gen, kind_ = p.next()[1], p.next()[1], p.next()[1]
                    if not isinstance(offset, int) or not isinstance(gen, int):
                        raise Malformed("an index entry is no numbers")
                    entries.setdefault(first + k, Entry("offset" if kind_ == "n" else "free", offset, gen, revision, hybrid))
            self.sections.append((revision, entries))
            trailer = p.value()
            if not isinstance(trailer, dict):
                raise Malformed("no trailer")
            return trailer
        _, stream = self._object_at(at)
        if not isinstance(stream, Stream) or stream.dict.get("Type") != "XRef":
            raise Malformed("no index where one was announced")
        body, widths = self.decoded(stream), stream.dict["W"]
        runs = stream.dict.get("Index") or [0, stream.dict["Size"]]
        entries, pos, row = {}, 0, sum(widths)
        for first, count in zip(runs[::2], runs[1::2], strict=False):
            for k in range(count):
                part, cut = body[pos : pos + row], []
                pos += row
                if len(part) < row:
                    break
                at_ = 0
                for w in widths:
                    cut.append(int.from_bytes(part[at_ : at_ + w], "big") if w else None)
                    at_ += w
                kind = 1 if cut[0] is None else cut[0]
                entries.setdefault(first + k, Entry({0: "free", 1: "offset", 2: "compressed"}.get(kind, "free"), cut[1] or 0, cut[2] or 0, revision, hybrid))
        self.sections.append((revision, entries))
        return stream.dict

    def _rebuild(self) -> None:
        """Finds "N G obj" in the bytes: the last one of a number counts."""
        self.index, self.cache, self.sections = {}, {}, []
        for m in re.finditer(rb"(?<!\d)(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+obj\b", self.data):
            self.index[int(m[1])] = Entry("offset", m.start(), int(m[2]), 0)
        for m in re.finditer(rb"trailer", self.data):
            try:
                t = Parser(self.data, m.end()).value()
                self.trailer |= t if isinstance(t, dict) else {}
            except Malformed:
                continue
        for number in list(self.index):
            o = self.get(Ref((number, 0)))
            if isinstance(o, Stream) and o.dict.get("Type") == "ObjStm":
                for k, inner in enumerate(self._packed(o)):
                    self.index.setdefault(inner, Entry("compressed", number, k, 0))
            if isinstance(o, dict) and o.get("Type") == "Catalog":
                self.trailer["Root"] = Ref((number, 0))
        self.sections = [(0, self.index)]

    def _object_at(self, at: int):
        p = Parser(self.data, at)
        number, _, word = p.next()[1], p.next()[1], p.next()[1]
        if word != "obj":
            raise Malformed(f"no object at {at}")
        value = p.value()
        kind, word, _, end = p.next()
        if isinstance(value, dict) and kind == "word" and word == "stream":
            end += 2 if self.data[end : end + 2] == b"\r\n" else 1
            n = value.get("Length")
            n = self.get(n) if isinstance(n, Ref) else n
            if not isinstance(n, int) or not re.match(rb"\s*endstream", self.data[end + n : end + n + 20]):
                stop = self.data.find(b"endstream", end)
                n = (stop if stop >= 0 else len(self.data)) - end
            value = Stream(value, self.data[end : end + n])
        return number, value

    def _packed(self, stream: Stream) -> dict[int, int]:
        p, n = Parser(self.decoded(stream)), stream.dict.get("N", 0)
        pairs = [(p.next()[1], p.next()[1]) for _ in range(n)]
        return {a: stream.dict.get("First", 0) + b for a, b in pairs if isinstance(a, int) and isinstance(b, int)}

    def get(self, value):
        """What a reference leads to, one hop; None for an unknown object. Other values as they are."""
        if not isinstance(value, Ref):
            return value
        number = value[0]
        if number not in self.cache:
            self.cache[number] = None  # ends cycles
            e = self.index.get(number)
            try:
                if e and e.kind == "offset":
                    found, v = self._object_at(e.offset)
                    if self.handler is not None and number != (self.trailer["Encrypt"] or (None,))[0]:
                        v = self.handler.opened(v, number, e.gen)
                    self.cache[number] = v if found == number else None
                elif e and e.kind == "compressed":
                    holder = self.get(Ref((e.offset, 0)))
                    if isinstance(holder, Stream):
                        places = self._packed(holder)
                        self.cache[number] = Parser(self.decoded(holder), places[number]).value() if number in places else None
            except (Malformed, ValueError, IndexError, KeyError, TypeError, zlib.error) as x:
                self.warnings.append(f"object {number}: {x}")
        return self.cache[number]

    def decoded(self, stream: Stream) -> bytes:
        names = self.get(stream.dict.get("Filter"))
        names = [] if names is None else [names] if isinstance(names, Name) else [self.get(n) for n in names]
        parms = self.get(stream.dict.get("DecodeParms"))
        parms = [parms] if isinstance(parms, dict) else [self.get(p) for p in parms] if parms else []
        keys = {"Predictor": "predictor", "Colors": "colors", "BitsPerComponent": "bits", "Columns": "columns", "EarlyChange": "early"}
        parms = [{keys[k]: v for k, v in (p or {}).items() if k in keys} for p in parms]
        return decode_chain([str(n) for n in names], stream.raw, parms)

    def pages(self) -> Iterator[tuple[dict, dict]]:
        """(page, inherited attributes) depth first; a node that is its own ancestor, or no node, is passed over."""
        root = self.get(self.trailer.get("Root"))
        stack = [(root.get("Pages"), {}, ())] if isinstance(root, dict) else []
        while stack:
            ref, above, path = stack.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or ref in path or len(path) > 1024:
                self.warnings.append("bad page node")
                continue
            mine = above | {k: node[k] for k in ("MediaBox", "CropBox", "Rotate", "Resources") if k in node}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                stack += [(k, mine, (*path, ref)) for k in reversed(kids)]
            else:
                yield node, mine

    def contents(self, page: dict) -> bytes:
        c = self.get(page.get("Contents"))
        parts = [self.get(x) for x in c] if isinstance(c, list) else [c]
        return b" ".join(self.decoded(s) for s in parts if isinstance(s, Stream))


@dataclass
class Fragment:
    text: str
    x: float
    y: float
    font_size: float
    width: float | None
    angle: float
    mcid: int | None


def _times(m, n):
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return (a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


def fragments(content: bytes, decode=None, widths=None, limit: int = 1_000_000) -> list[Fragment]:
    """Positioned text of a content stream. decode(font, bytes) -> str, widths(font, bytes) -> thousandths of an em or None."""
    decode = decode or (lambda _, b: b.decode("latin-1"))
    out, stack, saved, marks = [], [], [], []
    ctm, tm, tlm = ((1.0, 0.0, 0.0, 1.0, 0.0, 0.0),) * 3
    s = {"font": None, "size": 0.0, "Tc": 0.0, "Tw": 0.0, "Tz": 100.0, "TL": 0.0, "Ts": 0.0}

    def move(x, y):
        nonlocal tm, tlm
        tlm = tm = _times((1, 0, 0, 1, x, y), tlm)

    def show(raw: bytes):
        nonlocal tm
        m = _times((1, 0, 0, 1, 0, s["Ts"]), _times(tm, ctm))
        scale = math.hypot(m[2], m[3])
        text = decode(s["font"], raw)
        wide = widths(s["font"], raw) if widths else None
        em = wide / 1000 if wide is not None else 0.5 * len(text)
        advance = (em * s["size"] + s["Tc"] * len(raw) + s["Tw"] * raw.count(b" ")) * s["Tz"] / 100
        mcid = next((k for k in reversed(marks) if k is not None), None)
        if text:
            out.append(Fragment(text, m[4], m[5], s["size"] * scale, advance * math.hypot(m[0], m[1]) if wide is not None else None, math.degrees(math.atan2(m[1], m[0])) + 0.0, mcid))
        tm = _times((1, 0, 0, 1, advance, 0), tm)

    p, n = Parser(content), 0
    while True:
        t = p.next()
        if t[0] == "end":
            return out
        if t[0] != "word" or t[1] in ("true", "false", "null"):
            p.held.append(t)
            try:
                stack.append(p.value())
            except Malformed:
                return out
            continue
        n += 1
        if n > limit:
            raise Malformed("too many operators")
        op, args, stack = str(t[1]), stack, []
        try:
            if op == "q":
                saved.append((ctm, dict(s)))
            elif op == "Q" and saved:
                ctm, s = saved.pop()
            elif op == "cm":
                ctm = _times(tuple(map(float, args[-6:])), ctm)
            elif op == "BT":
                tm = tlm = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
            elif op == "Tf":
                s["font"], s["size"] = args[-2], float(args[-1])
            elif op in ("Tc", "Tw", "Tz", "TL", "Ts"):
                s[op] = float(args[-1])
            elif op in ("Td", "TD"):
                if op == "TD":
                    s["TL"] = -float(args[-1])
                move(float(args[-2]), float(args[-1]))
            elif op == "Tm":
                tm = tlm = tuple(map(float, args[-6:]))
            elif op == "T*":
                move(0, -s["TL"])
            elif op in ("Tj", "'", '"'):
                if op == '"':
                    s["Tw"], s["Tc"] = float(args[-3]), float(args[-2])
                if op != "Tj":
                    move(0, -s["TL"])
                show(args[-1])
            elif op == "TJ":
                for x in args[-1]:
                    if isinstance(x, bytes):
                        show(x)
                    else:
                        tm = _times((1, 0, 0, 1, -x / 1000 * s["size"] * s["Tz"] / 100, 0), tm)
            elif op in ("BDC", "BMC"):
                marks.append(args[-1].get("MCID") if op == "BDC" and isinstance(args[-1], dict) else None)
            elif op == "EMC" and marks:
                marks.pop()
            elif op == "BI":
                at = content.find(b"EI", p.end)
                p = Parser(content, at + 2 if at >= 0 else len(content))
        except (IndexError, TypeError, ValueError, AttributeError):
            continue  # an operator with bad operands does nothing


def to_unicode(cmap: bytes) -> dict[bytes, str]:
    """Codes and what they stand for, of bfchar and bfrange sections."""
    out: dict[bytes, str] = {}
    for section, body in re.findall(rb"begin(bfchar|bfrange)(.*?)end\1", cmap, re.S):
        p, items = Parser(body), []
        while (t := p.next())[0] != "end":
            p.held.append(t)
            items.append(p.value())
        if section == b"bfchar":
            out |= {a: b.decode("utf-16-be", "replace") for a, b in zip(items[::2], items[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)}
            continue
        for low, high, to in zip(items[::3], items[1::3], items[2::3], strict=False):
            first, last = int.from_bytes(low, "big"), int.from_bytes(high, "big")
            for k in range(min(last - first, 0xFFFF) + 1):
                if isinstance(to, list):
                    text = to[k].decode("utf-16-be", "replace") if k < len(to) else ""
                else:
                    text = (int.from_bytes(to, "big") + k).to_bytes(len(to), "big").decode("utf-16-be", "replace")
                out[(first + k).to_bytes(len(low), "big")] = text
    return out


def page_fragments(pdf: Pdf, page: dict, inherited: dict) -> list[Fragment]:
    resources = pdf.get(inherited.get("Resources")) or {}
    fonts = pdf.get(resources.get("Font")) or {}
    maps: dict = {}

    def table(name):
        if name not in maps:
            font = pdf.get(fonts.get(name)) or {}
            cmap = pdf.get(font.get("ToUnicode"))
            maps[name] = (to_unicode(pdf.decoded(cmap)) if isinstance(cmap, Stream) else {}, font.get("Subtype") == "Type0", font)
        return maps[name]

    def decode(name, raw):
        table_, wide, _ = table(name)
        step = 2 if wide else 1
        codes = [raw[i : i + step] for i in range(0, len(raw), step)]
        return "".join(table_.get(c, "" if wide else c.decode("cp1252", "replace")) for c in codes)

    def widths(name, raw):
        _, wide, font = table(name)
        listed, first = pdf.get(font.get("Widths")), font.get("FirstChar", 0)
        if wide or not isinstance(listed, list):
            return None
        each = [pdf.get(listed[b - first]) if 0 <= b - first < len(listed) else 0 for b in raw]
        return float(sum(w for w in each if isinstance(w, int | float)))

    return fragments(pdf.contents(page), decode, widths)


def json_of(value) -> str:
    """An object as JSON: names as "/x", references as "n g R", strings as text, streams as their dictionary."""
    import json

    def plain(v, depth=0):
        if depth > DEEPEST:
            return None
        if isinstance(v, Name):
            return f"/{v}"
        if isinstance(v, Ref):
            return f"{v[0]} {v[1]} R"
        if isinstance(v, bytes):
            return text_of(v)
        if isinstance(v, Stream):
            return {"stream": len(v.raw), **plain(v.dict, depth + 1)}
        if isinstance(v, dict):
            return {k: plain(x, depth + 1) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x, depth + 1) for x in v]
        return str(v) if isinstance(v, Word) else v

    return json.dumps(plain(value), sort_keys=True, ensure_ascii=False)


def _refs(value) -> list[int]:
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, Ref):
            out.append(v[0])
        elif isinstance(v, Stream):
            todo.append(v.dict)
        elif isinstance(v, dict):
            todo += v.values()
        elif isinstance(v, list):
            todo += v
    return sorted(set(out))


_RELATIONS = {
    "documents": "version string, page_count int, title string, author string, encrypted boolean, warnings array<string>, error string",
    "xref": "revision int, is_xrefstm boolean, obj_no int, gen int, kind string, offset long",
    "objects": "obj_no int, gen int, kind string, value string, refs array<int>",
    "doc_pages": "page_index int, media_box array<double>, crop_box array<double>, rotate int",
    "fragments": "page_index int, frag_index int, text string, x double, y double, font_size double, width double, angle double, mcid int",
}


def _rows(what: str, data: bytes, most_pages: int, password: str | None):
    return _read(what, Pdf.open(data, password=password), most_pages)


def _read(what: str, pdf: Pdf, most_pages: int):
    from pagemill.sources import parts

    if what in parts.READERS:
        yield from parts.READERS[what](pdf)
        return
    if what == "documents":
        info = pdf.get(pdf.trailer.get("Info"))
        info = info if isinstance(info, dict) else {}
        said = [text_of(v) if isinstance(v := pdf.get(info.get(k)), bytes) else None for k in ("Title", "Author")]
        n = sum(1 for _ in islice(pdf.pages(), most_pages + 1))
        if n > most_pages:
            raise Malformed("too many pages")
        head = re.match(rb"%PDF-(\d+\.\d+)", pdf.data)
        yield head[1].decode() if head else None, n, *said, "Encrypt" in pdf.trailer, list(pdf.warnings), None
    elif what == "xref":
        for revision, entries in pdf.sections:
            for number, e in entries.items():
                yield revision, e.hybrid, number, e.gen, e.kind, e.offset
    elif what == "objects":
        for number in sorted(pdf.index):
            if pdf.index[number].kind != "free":
                v = pdf.get(Ref((number, 0)))
                yield number, pdf.index[number].gen, type(v).__name__.lower(), json_of(v), _refs(v)
    else:
        for k, (page, inherited) in enumerate(islice(pdf.pages(), most_pages)):
            if what == "doc_pages":
                boxes = [pdf.get(inherited.get(b)) for b in ("MediaBox", "CropBox")]
                boxes = [[float(pdf.get(x)) for x in b] if isinstance(b, list) else None for b in boxes]
                yield k, boxes[0], boxes[1] or boxes[0], (pdf.get(inherited.get("Rotate")) or 0) % 360
            else:
                for i, f in enumerate(page_fragments(pdf, page, inherited)):
                    yield k, i, f.text, f.x, f.y, f.font_size, f.width, f.angle, f.mcid


AT_ONCE, BYTES_AT_ONCE = 4096, 4 << 20


def in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows, whose second value is bytes or null, as batches of some megabytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1] or b"")
        if len(held) >= AT_ONCE or size >= BYTES_AT_ONCE:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _gathered(each: Iterator[tuple[int, list, Callable]], made: Callable[[list], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of what files gave: (bytes read, rows, what there is instead if these make no batch)."""
    def batches(held):
        try:
            return [made([r for _, rows, _ in held for r in rows])]
        except Exception:  # one of them: each by itself
            out = []
            for _, rows, instead in held:
                try:
                    out.append(made(rows))
                except Exception as e:
                    out.append(made(instead(e)))
            return out

    held, n, size = [], 0, 0
    for one in each:
        held.append(one)
        n, size = n + len(one[1]), size + one[0]
        if n >= AT_ONCE or size >= BYTES_AT_ONCE:
            yield from (b for b in batches(held) if b.num_rows)
            held, n, size = [], 0, 0
    yield from (b for b in batches(held) if b.num_rows)


def relation(files: DataFrame, what: str, id_col: str = "doc_id", content_col: str = "content", most_bytes: int = 256 << 20, most_pages: int = 1_000_000, password: str | None = "", keep: Sequence[str] = ()) -> DataFrame:
    """One of the relations (documents, xref, objects, doc_pages, fragments, and those of parts.RELATIONS) of files (id, content).

    A file that can't be read has one row in documents, with its error, and none elsewhere; so has one over `most_bytes`,
    and, in documents, one of more than `most_pages` pages. Encrypted files are read with `password`, the user's or the
    owner's (the empty one opens those that ask for none); one it doesn't open is one that can't be read. None: as they are.
    `keep`: columns of the files that every row of theirs keeps.
    """
    from pagemill.sources import parts

    ddl = parts.RELATIONS.get(what) or _RELATIONS[what]
    schema = ", ".join([f"doc_id {files.schema[id_col].dataType.simpleString()}", ddl, *(f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keep)])
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    width = len(arrow) - 1

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], arrow.field(k).type) for k in range(width + 1)], schema=arrow)

    def failed(doc, kept):
        return lambda e: [(doc, None, None, None, None, None, [], f"{type(e).__name__}: {e}", *kept)] if what == "documents" else []

    def each(batches):
        for batch in batches:
            for doc, data, *kept in zip(*batch.columns, strict=True):
                doc, data, kept = doc.as_py(), data.as_py(), [k.as_py() for k in kept]
                try:
                    if data is None or len(data) > most_bytes:
                        raise Malformed("no content" if data is None else "too large")
                    rows = [(doc, *r, *kept) for r in _rows(what, data, most_pages, password)]
                except Exception as e:  # any damage is this row's error
                    rows = failed(doc, kept)(e)
                yield len(data or b""), rows, failed(doc, kept)

    def read(batches):
        return _gathered(each(batches), made)

    return files.select(F.col(id_col), F.col(content_col), *keep).mapInArrow(read, schema)


def relations(files: DataFrame, names: list[str], id_col: str = "doc_id", content_col: str = "content", most_bytes: int = 256 << 20, most_pages: int = 1_000_000, password: str | None = "") -> DataFrame:
    """The rows of several relations of files, each file opened once: doc_id and, for each relation, a column of its rows as a struct, null in the rows of others.

    What can't be read gives what relation() gives. Narrow, one file at a time.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    from pagemill.sources import parts

    ddl = {n: parts.RELATIONS.get(n) or _RELATIONS[n] for n in names}
    schema = StructType.fromDDL(f"doc_id {files.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{n} struct<{', '.join(f'{c.split()[0]}: {c.split()[1]}' for c in d.split(', '))}>" for n, d in ddl.items()))
    arrow = to_arrow_schema(schema)

    def made(rows):
        columns = [pa.array([r[0] for r in rows], arrow.field(0).type)]
        for n in names:
            kind, mine = arrow.field(n).type, [r[2] if r[1] == n else None for r in rows]
            none = (None,) * kind.num_fields
            values = [pa.array(c, t.type) for c, t in zip(zip(*(v or none for v in mine), strict=True), kind, strict=True)] if rows else [pa.array([], t.type) for t in kind]
            columns.append(pa.StructArray.from_arrays(values, fields=list(kind), mask=pa.array([v is None for v in mine], pa.bool_())))
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    def failed(doc, name):
        return lambda e: [(doc, name, (None, None, None, None, None, [], f"{type(e).__name__}: {e}"))] if name == "documents" else []

    def each(batches):
        for batch in batches:
            for doc, data in zip(batch.column(0), batch.column(1), strict=True):
                doc, data, pdf, error = doc.as_py(), data.as_py(), None, None
                try:
                    if data is None or len(data) > most_bytes:
                        raise Malformed("no content" if data is None else "too large")
                    pdf = Pdf.open(data, password=password)
                except Exception as e:  # any damage is this file's error
                    error = e
                for name in sorted(names, key=lambda n: n != "documents"):  # whose warnings are those of the pages alone
                    try:
                        rows = [(doc, name, r) for r in _read(name, pdf, most_pages)] if pdf else failed(doc, name)(error)
                    except Exception as e:  # and this relation's
                        rows = failed(doc, name)(e)
                    yield len(data or b""), rows, failed(doc, name)

    def read(batches):
        return _gathered(each(batches), made)

    return files.select(F.col(id_col), F.col(content_col)).mapInArrow(read, schema)


def read_files(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Files under a path as (doc_id string, content), batch or stream; stateless either way."""
    if stream:
        reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    else:
        reader = spark.read.format("binaryFile")
    return reader.option("pathGlobFilter", "*.pdf").load(path).select(F.col("path").alias("doc_id"), "content")
