"""Changes to documents: bookmarks, annotations and layers by incremental update; sanitizing and scrubbing by writing anew. Bytes to bytes."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

from pagemill.sources import parts, walk, writer
from pagemill.sources.pdf import Entry, Name, Pdf, Ref, Stream, _refs, in_batches, text_of


def _text(value: str) -> bytes:
    """A text string: one byte a character where that is enough, else UTF-16."""
    try:
        return value.encode("ascii")
    except UnicodeEncodeError:
        return b"\xfe\xff" + value.encode("utf-16-be")


def _free(pdf: Pdf) -> int:
    return max(pdf.index, default=0) + 1


def _root(pdf: Pdf) -> tuple[int, dict]:
    return pdf.trailer["Root"][0], dict(parts.catalog(pdf))


def write_outline(data: bytes, entries: Sequence[tuple[str, int, int]]) -> bytes:
    """The document with bookmarks (title, page, depth) instead of its own. A depth over its predecessor's by more than one counts as one more; a page that isn't there is no target."""
    pdf = Pdf.open(data)
    number, root = _root(pdf)
    pages = {k: n for n, k in parts.page_numbers(pdf).items()}
    top = _free(pdf)
    nodes = [{"Title": _text(t)} | ({"Dest": [Ref((pages[p], 0)), Name("Fit")]} if p in pages else {}) for t, p, _ in entries]
    kids: dict[int, list[int]] = {-1: []}
    chain: list[int] = []
    for i, (_, _, depth) in enumerate(entries):
        chain = chain[: max(0, min(depth, len(chain)))]
        above = chain[-1] if chain else -1
        kids.setdefault(above, []).append(i)
        nodes[i]["Parent"] = Ref((top if above < 0 else top + 1 + above, 0))
        chain.append(i)
    for above, mine in kids.items():
        for a, b in zip(mine, mine[1:], strict=False):
            nodes[a]["Next"], nodes[b]["Prev"] = Ref((top + 1 + b, 0)), Ref((top + 1 + a, 0))
        if above >= 0:
            nodes[above] |= {"First": Ref((top + 1 + mine[0], 0)), "Last": Ref((top + 1 + mine[-1], 0)), "Count": len(mine)}
    out = {"Type": Name("Outlines"), "Count": len(kids[-1])}
    if kids[-1]:
        out |= {"First": Ref((top + 1 + kids[-1][0], 0)), "Last": Ref((top + 1 + kids[-1][-1], 0))}
    root["Outlines"] = Ref((top, 0))
    return writer.update(data, {number: root, top: out} | {top + 1 + i: n for i, n in enumerate(nodes)})


def add_annotations(data: bytes, annotations: Sequence[tuple[int, str, tuple[float, float, float, float], str]]) -> bytes:
    """The document with more annotations (page, subtype, rectangle, contents); those of pages that aren't there are left out."""
    pdf = Pdf.open(data)
    pages = {k: n for n, k in parts.page_numbers(pdf).items()}
    new, changed, at = {}, {}, _free(pdf)
    for page, subtype, box, contents in annotations:
        if page not in pages:
            continue
        if page not in changed:
            changed[page] = dict(pdf.get(Ref((pages[page], 0))))
            changed[page]["Annots"] = list(parts._list(pdf, changed[page].get("Annots")))
        new[at] = {"Type": Name("Annot"), "Subtype": Name(subtype), "Rect": list(box), "Contents": _text(contents), "F": 4, "P": Ref((pages[page], 0))}
        changed[page]["Annots"].append(Ref((at, 0)))
        at += 1
    return writer.update(data, new | {pages[k]: v for k, v in changed.items()}) if new else data


def set_layers(data: bytes, visible: dict[str, bool]) -> bytes:
    """The document with layers, by name, shown or hidden by default."""
    pdf = Pdf.open(data)
    number, root = _root(pdf)
    said = dict(parts._dict(pdf, root.get("OCProperties")))
    if not said:
        return data
    config = dict(parts._dict(pdf, said.get("D")))
    on, off = [], []
    for layer, name, base, _ in parts.READERS["layers"](pdf):
        (on if visible.get(name, base) else off).append(Ref((layer, 0)))
    said["D"] = config | {"BaseState": Name("ON"), "ON": on, "OFF": off}
    root["OCProperties"] = said
    return writer.update(data, {number: root})


def rewritten(pdf: Pdf, change: Callable[[int, object], object], info: bool = True) -> bytes:
    """The document written anew from what its root leads to after change(number, object), each under its own number."""
    root = pdf.trailer["Root"][0]
    about = pdf.trailer.get("Info")
    todo, kept = [root] + ([about[0]] if info and isinstance(about, Ref) else []), {}
    while todo:
        number = todo.pop()
        if number in kept or number not in pdf.index or pdf.index[number].kind == "free":
            continue
        kept[number] = change(number, pdf.get(Ref((number, 0))))
        todo += _refs(kept[number])
    return writer.write(kept, root, about[0] if info and isinstance(about, Ref) and about[0] in kept else None)


_KEYS = {"javascript": ("JS", "JavaScript"), "attachment": ("EmbeddedFiles", "EF", "AF"), "action": ("OpenAction", "AA"), "metadata": ("Metadata",), "thumbnail": ("Thumb",), "private": ("PieceInfo",)}


def sanitize(data: bytes, categories: Sequence[str] = parts.ACTIVE) -> bytes:
    """The document less the content of some categories, and less what only that content led to."""
    pdf = Pdf.open(data)
    gone = {k for c in categories for k in _KEYS[c]}

    def cut(value):
        if isinstance(value, Stream):
            return Stream(cut(value.dict), value.raw)
        if isinstance(value, dict):
            if "javascript" in categories and value.get("S") == "JavaScript":
                return {}
            return {k: cut(v) for k, v in value.items() if k not in gone}
        if isinstance(value, list):
            kept = [v for v in value if not ("attachment" in categories and parts._dict(pdf, v).get("Subtype") == "FileAttachment")]
            return [cut(v) for v in kept]
        return value

    return rewritten(pdf, lambda number, value: cut(value), "metadata" not in categories)


_XMP = """<?xpacket begin="\ufeff" id="W5M0MpCehiHzreSzNTczkc9d"?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:pdfaid="http://www.aiim.org/pdfa/ns/id/" pdfaid:part="2" pdfaid:conformance="B" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title><rdf:Alt><rdf:li xml:lang="x-default">%s</rdf:li></rdf:Alt></dc:title></rdf:Description></rdf:RDF></x:xmpmeta><?xpacket end="w"?>"""


def archived(data: bytes) -> bytes:
    """The document as an archive takes it, as far as no content has to be drawn anew: no active content, attachments, layers or hidden notes; LZW data deflated, notes with an appearance, metadata and an output intent.

    Fonts that aren't embedded and transparency stay, and conformance.findings() tells of them.
    """
    clean = Pdf.open(sanitize(data, [c for c in parts.ACTIVE if c != "metadata"]))
    title = parts._text(clean, parts._dict(clean, clean.trailer.get("Info")).get("Title")) or ""
    top = _free(clean)
    blank = Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0, 0, 0, 0]}, b"")
    root, about = clean.trailer["Root"][0], escape(title)
    added = {top: Stream({"Type": Name("Metadata"), "Subtype": Name("XML")}, (_XMP % about).encode()), top + 1: blank}

    def change(number, value):
        if number in added:
            return added[number]
        if number == root:
            intent = {"Type": Name("OutputIntent"), "S": Name("GTS_PDFA1"), "OutputConditionIdentifier": b"sRGB"}
            return {k: v for k, v in value.items() if k != "OCProperties"} | {"Metadata": Ref((top, 0)), "OutputIntents": [intent]}
        if isinstance(value, Stream) and "LZWDecode" in str(clean.get(value.dict.get("Filter"))):
            return Stream({k: v for k, v in value.dict.items() if k != "DecodeParms"} | {"Filter": Name("FlateDecode")}, zlib.compress(clean.decoded(value)))
        if isinstance(value, dict) and isinstance(notes := clean.get(value.get("Annots")), list):
            value = value | {"Annots": [a for a in notes if not (clean.get(parts._dict(clean, a).get("F")) or 0) & 34]}
        if isinstance(value, dict) and "Subtype" in value and "Rect" in value and "AP" not in value:
            return value | {"AP": {"N": Ref((top + 1, 0))}, "F": (value.get("F") or 0) | 4}
        return value

    clean.index |= {n: Entry("offset", 0, 0, 0) for n in added}
    return rewritten(clean, change)


def scrub(data: bytes, replace: Callable[[str], str]) -> bytes:
    """The document with replace() over every text outside its pages' contents: titles, names, field values, notes, attachments' text, metadata."""
    pdf = Pdf.open(data)

    def text(value, key=""):
        if isinstance(value, bytes) and key not in ("Contents/Sig", "ID", "O", "U", "OE", "UE", "Perms"):
            was = text_of(value)
            now = replace(was)
            return value if now == was else _text(now)
        if isinstance(value, dict):
            signature = value.get("Type") == "Sig" or "ByteRange" in value
            return {k: v if signature and k in ("Contents", "Cert") else text(v, k) for k, v in value.items()}
        if isinstance(value, list):
            return [text(v, key) for v in value]
        if isinstance(value, Stream):
            d = text(value.dict)
            if value.dict.get("Type") in ("EmbeddedFile", "Metadata"):
                try:
                    was = pdf.decoded(value).decode("utf-8")
                except UnicodeDecodeError:
                    return Stream(d, value.raw)
                if (now := replace(was)) != was:
                    return Stream({k: v for k, v in d.items() if k not in ("Filter", "DecodeParms")}, now.encode())
            return Stream(d, value.raw)
        return value

    return rewritten(pdf, lambda number, value: text(value))


def minify(data: bytes) -> bytes:
    """The document with each page's contents as one stream, less comments and needless white space."""
    pdf = Pdf.open(data)
    numbers = {k: n for n, k in parts.page_numbers(pdf).items()}
    new, at = {}, _free(pdf)
    for k, (page, _) in enumerate(pdf.pages()):
        new[numbers[k]] = page | {"Contents": Ref((at, 0))}
        new[at] = Stream({}, walk.minified(pdf.contents(page)))
        at += 1
    return rewritten(Pdf.open(writer.update(data, new)), lambda number, value: value)


def signed(data: bytes, sign: Callable[[bytes], bytes], signer: str, room: int = 8192) -> bytes:
    """The document with an invisible signature field over all of it; sign(content) gives the detached message, of up to `room` bytes."""
    pdf = Pdf.open(data)
    number, root = _root(pdf)
    at, place = _free(pdf), b"[0 0000000000 0000000000 0000000000]"
    head = b"<</Type /Sig /Filter /Adobe.PPKLite /SubFilter /adbe.pkcs7.detached /Name " + writer.serialize(_text(signer)) + b" /ByteRange "
    value = writer.Raw(head + place + b" /Contents <" + b"0" * (2 * room) + b">>>")
    form = dict(parts._dict(pdf, root.get("AcroForm")))
    pages = {k: n for n, k in parts.page_numbers(pdf).items()}
    field = {"FT": Name("Sig"), "T": b"Signature%d" % at, "V": Ref((at, 0)), "Type": Name("Annot"), "Subtype": Name("Widget"), "Rect": [0, 0, 0, 0], "F": 132} | ({"P": Ref((pages[0], 0))} if pages else {})
    root["AcroForm"] = form | {"Fields": [*parts._list(pdf, form.get("Fields")), Ref((at + 1, 0))], "SigFlags": 3}
    out = bytearray(writer.update(data, {number: root, at: value, at + 1: field}))
    first = out.find(place, len(data))
    start = out.find(b"/Contents <", first) + 10
    end = start + 2 + 2 * room
    out[first : first + len(place)] = (b"[0 %d %d %d" % (start, end, len(out) - end)).ljust(len(place) - 1) + b"]"
    message = sign(bytes(out[:start] + out[end:]))
    if len(message) > room:
        raise ValueError(f"a message of {len(message)} bytes")
    out[start + 1 : start + 1 + 2 * len(message)] = message.hex().encode()
    return bytes(out)


def changed(files: DataFrame, change: Callable[..., bytes], *columns: str, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """(id, content, error) of files after change(content, *columns of the row): narrow, one file at a time. A file that can't be changed keeps its content and has an error."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kind = files.schema[id_col].dataType
    arrow = pa.schema([(id_col, to_arrow_type(kind)), ("content", pa.binary()), ("error", pa.string())])

    def each(batches):
        for batch in batches:
            for doc, data, *given in zip(*batch.columns, strict=True):
                doc, data = doc.as_py(), data.as_py()
                try:
                    out, error = change(data, *[g.as_py() for g in given]), None
                except Exception as e:  # any damage is this row's error
                    out, error = data, f"{type(e).__name__}: {e}"
                yield doc, out, error

    def run(batches):
        return in_batches(each(batches), arrow)

    return files.select(id_col, content_col, *columns).mapInArrow(run, f"{id_col} {kind.simpleString()}, content binary, error string")
