"""Writing documents: objects to bytes, with a classic index; incremental updates; a small builder for test files."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagemill.sources.pdf import Name, Pdf, Ref, Stream, in_batches


class Raw(bytes):
    """Document syntax that is written as it is."""


@lru_cache(4096)
def _named(value: str) -> bytes:
    return b"/" + b"".join(bytes((c,)) if 33 <= c <= 126 and c not in b"()<>[]{}/%#" else b"#%02X" % c for c in value.encode("latin-1"))


def serialize(value) -> bytes:
    """One object in document syntax."""
    if isinstance(value, Raw):
        return bytes(value)
    if value is None:
        return b"null"
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if isinstance(value, Name):
        return _named(value) if len(value) <= 64 else _named.__wrapped__(value)
    if isinstance(value, Ref):
        return b"%d %d R" % value
    if isinstance(value, int):
        return b"%d" % value
    if isinstance(value, float):
        return (f"{value:.6f}".rstrip("0").rstrip(".") or "0").encode() if value == value and abs(value) != float("inf") else b"0"
    if isinstance(value, bytes):
        return b"(" + value.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")"
    if isinstance(value, dict):
        return b"<<" + b" ".join(serialize(Name(k)) + b" " + serialize(v) for k, v in value.items()) + b">>"
    if isinstance(value, Stream):
        return serialize(value.dict | {"Length": len(value.raw)}) + b"\nstream\n" + value.raw + b"\nendstream"
    return b"[" + b" ".join(map(serialize, value)) + b"]"


def _index(offsets: dict[int, int], free: bool) -> bytes:
    rows = {0: b"0000000000 65535 f \n"} if free else {}
    rows |= {n: b"%010d 00000 n \n" % at for n, at in offsets.items()}
    out, run = b"xref\n", []
    for n in [*sorted(rows), None]:
        if run and (n is None or n != run[-1] + 1):
            out += b"%d %d\n" % (run[0], len(run)) + b"".join(rows[k] for k in run)
            run = []
        run.append(n)
    return out


def write(objects: dict[int, object], root: int, info: int | None = None, more: dict | None = None) -> bytes:
    """A whole file: objects in number order, an index, a trailer (with more entries, if given)."""
    out, offsets = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}
    for n, v in sorted(objects.items()):
        offsets[n] = len(out)
        out += b"%d 0 obj\n" % n + serialize(v) + b"\nendobj\n"
    at = len(out)
    trailer = {"Size": max(objects, default=0) + 1, "Root": Ref((root, 0))} | ({"Info": Ref((info, 0))} if info else {}) | (more or {})
    return bytes(out + _index(offsets, True) + b"trailer\n" + serialize(trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % at)


def update(data: bytes, objects: dict[int, object]) -> bytes:
    """The file with changed objects appended, and an index that leads back to its own."""
    pdf = Pdf.open(data)
    before = int(data[data.rfind(b"startxref") + 9 :].split()[0])
    out, offsets = bytearray(data if data.endswith(b"\n") else data + b"\n"), {}
    for n, v in sorted(objects.items()):
        offsets[n] = len(out)
        out += b"%d 0 obj\n" % n + serialize(v) + b"\nendobj\n"
    at = len(out)
    trailer = {"Size": max([*pdf.index, *objects]) + 1, "Root": pdf.trailer["Root"], "Prev": before} | {k: pdf.trailer[k] for k in ("Info", "ID") if k in pdf.trailer}
    return bytes(out + _index(offsets, False) + b"trailer\n" + serialize(trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % at)


def text_document(pages: list[str], title: str = "", size: float = 12.0) -> bytes:
    """A file whose pages have lines of text, from above."""
    objects: dict[int, object] = {1: {"Type": Name("Catalog"), "Pages": Ref((2, 0))}, 3: {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica")}, 4: {"Title": title.encode("latin-1", "replace")}}
    kids = []
    for k, text in enumerate(pages):
        lines = b" T* ".join(serialize(line.encode("cp1252", "replace")) + b" Tj" for line in text.split("\n"))
        objects[5 + 2 * k] = Stream({}, b"BT /F1 %g Tf %g TL 50 750 Td " % (size, size * 1.2) + lines + b" ET")
        objects[6 + 2 * k] = {"Type": Name("Page"), "Parent": Ref((2, 0)), "MediaBox": [0, 0, 600, 800], "Contents": Ref((5 + 2 * k, 0)), "Resources": {"Font": {"F1": Ref((3, 0))}}}
        kids.append(Ref((6 + 2 * k, 0)))
    objects[2] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)}
    return write(objects, 1, 4)


def image_document(frames: list, margin: float = 0.0, scale: float = 1.0) -> bytes:
    """A file with a page for each image (images.Frame), as large as it and a margin round it; scale: points a pixel."""
    import zlib

    objects: dict[int, object] = {1: {"Type": Name("Catalog"), "Pages": Ref((2, 0))}}
    kids = []
    for k, frame in enumerate(frames):
        width, height, channels = frame.size
        colour = frame.samples[..., :3] if channels > 2 else frame.samples[..., :1]
        page, image, content = 3 + 3 * k, 4 + 3 * k, 5 + 3 * k
        w, h = width * scale, height * scale
        objects[page] = {"Type": Name("Page"), "Parent": Ref((2, 0)), "MediaBox": [0, 0, w + 2 * margin, h + 2 * margin], "Resources": {"XObject": {"Im0": Ref((image, 0))}}, "Contents": Ref((content, 0))}
        said = {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": width, "Height": height, "ColorSpace": Name("DeviceRGB" if channels > 2 else "DeviceGray"), "BitsPerComponent": 8, "Filter": Name("FlateDecode")}
        objects[image] = Stream(said, zlib.compress(colour.tobytes()))
        objects[content] = Stream({}, b"q %g 0 0 %g %g %g cm /Im0 Do Q" % (w, h, margin, margin))
        kids.append(Ref((page, 0)))
    objects[2] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)}
    return write(objects, 1)


def each_written(pages: DataFrame, make: Callable[[object, list], bytes], doc: str = "doc_id", page: str = "page_index", text: str = "text") -> DataFrame:
    """(doc_id, content): make(document, its pages' texts in order), one file at a time."""
    kind = pages.schema[doc].dataType.simpleString()
    listed = pages.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct(page, text))), lambda x: x[text]).alias("_t"))

    def each(batches):
        for batch in batches:
            for number, texts in zip(batch.column(0), batch.column(1), strict=True):
                yield number.as_py(), make(number.as_py(), [t or "" for t in texts.as_py()])

    def run(batches):
        return in_batches(each(batches), schema)

    schema = pa.schema([("doc_id", to_arrow_type(pages.schema[doc].dataType)), ("content", pa.binary())])
    return listed.select(doc, "_t").mapInArrow(run, f"doc_id {kind}, content binary")


def documents_of(pages: DataFrame, doc: str = "doc_id", page: str = "page_index", text: str = "text") -> DataFrame:
    """(doc_id, content): each document's pages written as one file, in one task per document."""
    return each_written(pages, lambda _, texts: text_document(texts), doc, page, text)


def svg_of(shapes: DataFrame) -> DataFrame:
    """(doc_id, page_index, svg) of (doc_id, page_index, z, kind, x, y, width, height, text, fill): rectangles and texts, in their order."""
    safe = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    rect = F.format_string('<rect x="%.2f" y="%.2f" width="%.2f" height="%.2f" fill="%s"/>', "x", "y", "width", "height", F.coalesce("fill", F.lit("none")))
    label = F.concat(F.format_string('<text x="%.2f" y="%.2f">', "x", "y"), safe, F.lit("</text>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("z", "s"))), lambda v: v["s"]), "")
    drawn = shapes.withColumn("s", F.when(F.col("kind") == "rect", rect).otherwise(label))
    return drawn.groupBy("doc_id", "page_index").agg(F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg">'), body, F.lit("</svg>")).alias("svg"))
