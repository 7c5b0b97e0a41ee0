"""Font programs: the tables of TrueType and OpenType files that text needs, read and, for files made here, written."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field


class BadFont(ValueError):
    pass


@dataclass
class Face:
    """glyphs: by code point; widths: by glyph, in units of em; names: by name id (1 family, 2 style, 4 full, 6 PostScript)."""

    em: int
    glyphs: dict[int, int] = field(default_factory=dict)
    widths: list[int] = field(default_factory=list)
    names: dict[int, str] = field(default_factory=dict)
    ascent: int = 0
    descent: int = 0

    def width(self, text: str) -> float:
        """Thousandths of an em; characters without a glyph have the missing glyph's width."""
        return sum(self.widths[min(self.glyphs.get(ord(c), 0), len(self.widths) - 1)] for c in text) * 1000 / self.em if self.widths else 0.0


def _tables(data: bytes) -> dict[str, bytes]:
    start = 0
    if data[:4] == b"ttcf":
        start = struct.unpack_from(">I", data, 12)[0]
    if data[start : start + 4] not in (b"\0\1\0\0", b"OTTO", b"true"):
        raise BadFont("no font program")
    (n,) = struct.unpack_from(">H", data, start + 4)
    out = {}
    for k in range(n):
        tag, _, at, size = struct.unpack_from(">4sIII", data, start + 12 + 16 * k)
        if at + size > len(data):
            raise BadFont(f"table {tag!r} ends after the file")
        out[tag.decode("latin-1")] = data[at : at + size]
    return out


def read(data: bytes) -> Face:
    """The face of a font program, the first one of a collection."""
    try:
        t = _tables(data)
        face = Face(struct.unpack_from(">H", t["head"], 18)[0] or 1000)
        if "hhea" in t:
            face.ascent, face.descent = struct.unpack_from(">hh", t["hhea"], 4)
            (long,) = struct.unpack_from(">H", t["hhea"], 34)
            (glyphs,) = struct.unpack_from(">H", t["maxp"], 4)
            face.widths = [struct.unpack_from(">H", t["hmtx"], 4 * k)[0] for k in range(min(long, glyphs))]
            face.widths += face.widths[-1:] * (glyphs - len(face.widths))
        face.glyphs = _characters(t.get("cmap", b""))
        face.names = _names(t.get("name", b""))
        return face
    except (struct.error, KeyError, IndexError) as e:
        raise BadFont(f"damaged: {e}") from e


def _characters(cmap: bytes) -> dict[int, int]:
    """Code points and their glyphs of the widest Unicode table: beyond the basic plane, else within it, else of single bytes."""
    if not cmap:
        return {}
    order = {(3, 10): 0, (0, 6): 0, (0, 4): 0, (3, 1): 1, (0, 3): 1, (0, 2): 1, (0, 1): 1, (0, 0): 1, (3, 0): 2, (1, 0): 3}
    found = []
    for k in range(struct.unpack_from(">H", cmap, 2)[0]):
        platform, encoding, at = struct.unpack_from(">HHI", cmap, 4 + 8 * k)
        if (platform, encoding) in order:
            found.append((order[platform, encoding], at))
    for _, at in sorted(found):
        kind = struct.unpack_from(">H", cmap, at)[0]
        if kind == 12:
            out = {}
            for k in range(struct.unpack_from(">I", cmap, at + 12)[0]):
                first, last, glyph = struct.unpack_from(">III", cmap, at + 16 + 12 * k)
                out |= {c: glyph + c - first for c in range(first, min(last, 0x10FFFF) + 1)}
            return out
        if kind == 4:
            return _segments(cmap, at)
        if kind == 6:
            first, n = struct.unpack_from(">HH", cmap, at + 6)
            return {first + k: g for k, g in enumerate(struct.unpack_from(f">{n}H", cmap, at + 10)) if g}
        if kind == 0:
            return {c: g for c, g in enumerate(cmap[at + 6 : at + 262]) if g}
    return {}


def _segments(cmap: bytes, at: int) -> dict[int, int]:
    n = struct.unpack_from(">H", cmap, at + 6)[0] // 2
    last = struct.unpack_from(f">{n}H", cmap, at + 14)
    first = struct.unpack_from(f">{n}H", cmap, at + 16 + 2 * n)
    delta = struct.unpack_from(f">{n}H", cmap, at + 16 + 4 * n)
    ranges = at + 16 + 6 * n
    out = {}
    for k in range(n):
        (offset,) = struct.unpack_from(">H", cmap, ranges + 2 * k)
        for c in range(first[k], min(last[k], 0xFFFE) + 1):
            if offset:
                (g,) = struct.unpack_from(">H", cmap, ranges + 2 * k + offset + 2 * (c - first[k]))
                g = g and g + delta[k] & 0xFFFF
            else:
                g = c + delta[k] & 0xFFFF
            if g:
                out[c] = g
    return out


def _names(name: bytes) -> dict[int, str]:
    if not name:
        return {}
    n, at = struct.unpack_from(">HH", name, 2)
    out: dict[int, str] = {}
    for k in range(n):
        platform, _, _, which, size, offset = struct.unpack_from(">HHHHHH", name, 6 + 12 * k)
        text = name[at + offset : at + offset + size].decode("utf-16-be" if platform in (0, 3) else "latin-1", "replace")
        if platform in (0, 3) or which not in out:
            out[which] = text
    return out


def build(glyphs: dict[int, int], widths: list[int], em: int = 1000, family: str = "Made") -> bytes:
    """A font program of these characters and widths, without outlines: a table of segments, and one of groups if a character needs it."""
    runs: list[list[int]] = []
    for c, g in sorted(glyphs.items()):
        if runs and c == runs[-1][1] + 1 and g - c == runs[-1][2] - runs[-1][0]:
            runs[-1][1] = c
        else:
            runs.append([c, c, g])
    basic = [r for r in runs if r[1] < 0xFFFF] + [[0xFFFF, 0xFFFF, 0]]
    n = len(basic)
    columns = [[r[1] for r in basic], [0], [r[0] for r in basic], [(r[2] - r[0]) & 0xFFFF for r in basic[:-1]] + [1], [0] * n]
    body = b"".join(struct.pack(f">{len(c)}H", *c) for c in columns)
    four = struct.pack(">HHHHHHH", 4, 14 + len(body), 0, 2 * n, 0, 0, 0) + body
    wide = struct.pack(">HHIII", 12, 0, 16 + 12 * len(runs), 0, len(runs)) + b"".join(struct.pack(">III", *r) for r in runs)
    subtables = [((3, 1), four)] + ([((3, 10), wide)] if any(r[1] > 0xFFFF for r in runs) else [])
    cmap, at = struct.pack(">HH", 0, len(subtables)), 4 + 8 * len(subtables)
    for (platform, encoding), s in subtables:
        cmap += struct.pack(">HHI", platform, encoding, at)
        at += len(s)
    cmap += b"".join(s for _, s in subtables)
    text = family.encode("utf-16-be")
    tables = {
        "cmap": cmap, "head": bytes(18) + struct.pack(">H", em) + bytes(34), "hhea": bytes(4) + struct.pack(">hh", 800, -200) + bytes(26) + struct.pack(">H", len(widths)),
        "hmtx": b"".join(struct.pack(">HH", w, 0) for w in widths), "maxp": struct.pack(">IH", 0x5000, len(widths)), "name": struct.pack(">HHH6H", 0, 1, 18, 3, 1, 0x409, 1, len(text), 0) + text,
    }
    head, at, out = struct.pack(">IHHHH", 0x10000, len(tables), 0, 0, 0), 12 + 16 * len(tables), b""
    for tag, t in sorted(tables.items()):
        head += struct.pack(">4sIII", tag.encode(), 0, at + len(out), len(t))
        out += t + bytes(-len(t) % 4)
    return head + out
