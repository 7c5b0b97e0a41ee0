"""What a document holds beside its pages' text, as rows: fields, bookmarks, annotations, layers, signatures, fonts, active content, painted things, tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pagemill.sources.pdf import Malformed, Name, Pdf, Ref, Stream, text_of, tokens
from pagemill.sources.walk import walk

#: By relation, the columns after the document's id.
RELATIONS = {
    "fields": "field_id int, parent_id int, ordinal int, partial_name string, type string, flags int, max_len int, value string",
    "outlines": "node_id int, parent_id int, ordinal int, title string, page_index int",
    "annotations": "page_index int, obj_no int, ordinal int, subtype string, flags int, contents string, x0 double, y0 double, x1 double, y1 double, target int, appearance boolean",
    "layers": "layer int, name string, base boolean, printed boolean",
    "signatures": "field string, sub_filter string, signer string, ranges array<long>, signed binary, message binary, whole boolean",
    "fonts": "page_index int, font string, obj_no int, subtype string, base_font string, embedded boolean, subset boolean",
    "active": "obj_no int, category string",
    "ops": "page_index int, seq int, op string, kind string, paint string, x0 double, y0 double, x1 double, y1 double, fill string, stroke string, line_width double, alpha double, clips int, segments int, obj_no int",
    "linearization": "version double, length long, first_object int, first_end long, page_count int, main_index long, fits boolean",
    "tokens": "kind string, value string, start long, end long",
}
MOST_NODES = 100_000


def _text(pdf: Pdf, value) -> str | None:
    value = pdf.get(value)
    return text_of(value) if isinstance(value, bytes) else str(value) if isinstance(value, Name) else None


def _number(ref) -> int | None:
    return ref[0] if isinstance(ref, Ref) else None


def _dict(pdf: Pdf, value) -> dict:
    value = pdf.get(value)
    return value if isinstance(value, dict) else value.dict if isinstance(value, Stream) else {}


def _list(pdf: Pdf, value) -> list:
    value = pdf.get(value)
    return value if isinstance(value, list) else []


def catalog(pdf: Pdf) -> dict:
    return _dict(pdf, pdf.trailer.get("Root"))


def page_numbers(pdf: Pdf) -> dict[int, int]:
    """By object number, which page a page object is."""
    where, stack, n, seen = {}, [catalog(pdf).get("Pages")], 0, set()
    while stack:
        ref = stack.pop()
        node = _dict(pdf, ref)
        if _number(ref) in seen:
            continue
        seen.add(_number(ref))
        kids = pdf.get(node.get("Kids"))
        if isinstance(kids, list):
            stack += reversed(kids)
        elif node:
            where[_number(ref)] = n
            n += 1
    return where


def destination(pdf: Pdf, value, pages: dict[int, int]) -> int:
    """The page that a destination, a named one or an action leads to; -1 if none."""
    value = pdf.get(value)
    if isinstance(value, dict):
        return destination(pdf, value.get("D"), pages) if value.get("S", "GoTo") == "GoTo" else -1
    if isinstance(value, bytes | Name):
        key = text_of(value) if isinstance(value, bytes) else str(value)
        root = catalog(pdf)
        named = dict(names(pdf, _dict(pdf, root.get("Names")).get("Dests"))) | _dict(pdf, root.get("Dests"))
        found = named.get(key)
        return destination(pdf, found, pages) if found is not None and not isinstance(pdf.get(found), bytes | Name) else -1
    if isinstance(value, list) and value:
        return pages.get(_number(value[0]), value[0] if isinstance(value[0], int) and value[0] < len(pages) else -1)
    return -1


def names(pdf: Pdf, tree) -> Iterator[tuple[str, object]]:
    """(name, value) of a name tree, each node once."""
    stack, seen = [tree], set()
    while stack:
        ref = stack.pop()
        node = _dict(pdf, ref)
        if id(node) in seen:
            continue
        seen.add(id(node))
        pairs = _list(pdf, node.get("Names"))
        yield from ((text_of(k), v) for k, v in zip(pairs[::2], pairs[1::2], strict=False) if isinstance(k, bytes))
        stack += reversed(_list(pdf, node.get("Kids")))


def _fields(pdf: Pdf):
    stack = [(f, None, k) for k, f in enumerate(_list(pdf, _dict(pdf, catalog(pdf).get("AcroForm")).get("Fields")))]
    stack.reverse()
    seen = set()
    while stack and len(seen) < MOST_NODES:
        ref, above, ordinal = stack.pop()
        node, number = _dict(pdf, ref), _number(ref)
        if number is None or number in seen or ("T" not in node and above is not None and "FT" not in node and "Kids" not in node):
            continue
        seen.add(number)
        yield number, above, ordinal, _text(pdf, node.get("T")), (str(pdf.get(node["FT"])) if "FT" in node else None), pdf.get(node.get("Ff")), pdf.get(node.get("MaxLen")), _text(pdf, node.get("V"))
        stack += reversed([(kid, number, k) for k, kid in enumerate(_list(pdf, node.get("Kids")))])


def _outlines(pdf: Pdf):
    pages, seen = page_numbers(pdf), set()
    stack = [(_dict(pdf, catalog(pdf).get("Outlines")).get("First"), None, 0)]
    while stack and len(seen) < MOST_NODES:
        ref, above, ordinal = stack.pop()
        node, number = _dict(pdf, ref), _number(ref)
        if number is None or not node or number in seen:
            continue
        seen.add(number)
        yield number, above, ordinal, _text(pdf, node.get("Title")), destination(pdf, node.get("Dest", node.get("A")), pages)
        stack += [(node.get("Next"), above, ordinal + 1), (node.get("First"), number, 0)]


def _annotations(pdf: Pdf):
    pages = page_numbers(pdf)
    for k, (page, _) in enumerate(pdf.pages()):
        for i, ref in enumerate(_list(pdf, page.get("Annots"))):
            a = _dict(pdf, ref)
            box = [float(pdf.get(v)) for v in _list(pdf, a.get("Rect"))]
            box = [min(box[0], box[2]), min(box[1], box[3]), max(box[0], box[2]), max(box[1], box[3])] if len(box) == 4 else [None] * 4
            yield k, _number(ref), i, str(pdf.get(a.get("Subtype"))), pdf.get(a.get("F")) or 0, _text(pdf, a.get("Contents")), *box, destination(pdf, a.get("Dest", a.get("A")), pages), bool(_dict(pdf, a.get("AP")))


def _layers(pdf: Pdf):
    said = _dict(pdf, catalog(pdf).get("OCProperties"))
    config = _dict(pdf, said.get("D"))
    off = {_number(r) for r in _list(pdf, config.get("OFF"))}
    on = {_number(r) for r in _list(pdf, config.get("ON"))}
    base = pdf.get(config.get("BaseState")) != "OFF"
    for ref in _list(pdf, said.get("OCGs")):
        group = _dict(pdf, ref)
        state = pdf.get(_dict(pdf, _dict(pdf, group.get("Usage")).get("Print")).get("PrintState"))
        yield _number(ref), _text(pdf, group.get("Name")), (base or _number(ref) in on) and _number(ref) not in off, None if state is None else state == "ON"


def _signatures(pdf: Pdf):
    for number, _, _, name, kind, *_ in _fields(pdf):
        value = _dict(pdf, _dict(pdf, Ref((number, 0))).get("V"))
        if kind != "Sig" or not value:
            continue
        ranges = [int(pdf.get(v)) for v in _list(pdf, value.get("ByteRange"))]
        spans = list(zip(ranges[::2], ranges[1::2], strict=False))
        signed = b"".join(pdf.data[a : a + n] for a, n in spans)
        whole = len(spans) == 2 and spans[0][0] == 0 and sum(spans[1]) >= len(pdf.data.rstrip())
        message = pdf.get(value.get("Contents"))
        yield name, str(pdf.get(value.get("SubFilter"))), _text(pdf, value.get("Name")), ranges, signed, message if isinstance(message, bytes) else None, whole


def _fonts(pdf: Pdf):
    for k, (_, inherited) in enumerate(pdf.pages()):
        for name, ref in sorted(_dict(pdf, _dict(pdf, inherited.get("Resources")).get("Font")).items()):
            font = _dict(pdf, ref)
            inner = _dict(pdf, (_list(pdf, font.get("DescendantFonts")) or [None])[0]) or font
            about = _dict(pdf, inner.get("FontDescriptor"))
            base = str(pdf.get(font.get("BaseFont")))
            embedded = font.get("Subtype") == "Type3" or any(key in about for key in ("FontFile", "FontFile2", "FontFile3"))
            yield k, name, _number(ref), str(pdf.get(font.get("Subtype"))), base, embedded, len(base) > 7 and base[6] == "+" and base[:6].isupper()


#: What a category of active or hidden content is, in an object's dictionary.
ACTIVE = ("javascript", "attachment", "action", "metadata", "thumbnail", "private")


def active_in(pdf: Pdf, number: int, value) -> list[str]:
    """The categories of one object."""
    d = value.dict if isinstance(value, Stream) else value if isinstance(value, dict) else {}
    out = []
    if "JS" in d or d.get("S") == "JavaScript":
        out.append("javascript")
    if "EF" in d or d.get("Type") == "EmbeddedFile" or d.get("Subtype") == "FileAttachment":
        out.append("attachment")
    if "OpenAction" in d or "AA" in d:
        out.append("action")
    if d.get("Type") == "Metadata" or _number(pdf.trailer.get("Info")) == number:
        out.append("metadata")
    if "Thumb" in d:
        out.append("thumbnail")
    if "PieceInfo" in d:
        out.append("private")
    return out


def _active(pdf: Pdf):
    for number in sorted(pdf.index):
        if pdf.index[number].kind != "free":
            for category in active_in(pdf, number, pdf.get(Ref((number, 0)))):
                yield number, category


def _ops(pdf: Pdf):
    for k, (page, inherited) in enumerate(pdf.pages()):
        for i, x in enumerate(walk(pdf, pdf.contents(page), _dict(pdf, inherited.get("Resources")))):
            yield k, i, x.op, x.kind, x.paint, *x.box, x.state.fill, x.state.stroke, x.state.width, x.state.alpha, x.state.clips, x.segments, x.obj_no


def _linearization(pdf: Pdf, most: int = 1024):
    """The parameters of a file laid out for reading page by page, from its first object; fits: its length is the one they say."""
    at = re.search(rb"(?<!\d)\d+\s+\d+\s+obj\b", pdf.data[:most])
    try:
        _, first = pdf._object_at(at.start()) if at else (0, None)
    except Malformed:
        return
    if isinstance(first, dict) and "Linearized" in first:
        numbers = [first.get(k) if isinstance(first.get(k), int) else None for k in ("L", "O", "E", "N", "T")]
        yield float(first["Linearized"]), *numbers, numbers[0] == len(pdf.data)


def _tokens(pdf: Pdf):
    for kind, value, start, end in tokens(pdf.data):
        yield kind, text_of(value) if isinstance(value, bytes) else str(value), start, end


READERS = {"fields": _fields, "outlines": _outlines, "annotations": _annotations, "layers": _layers, "signatures": _signatures, "fonts": _fonts, "active": _active, "ops": _ops, "linearization": _linearization, "tokens": _tokens}
