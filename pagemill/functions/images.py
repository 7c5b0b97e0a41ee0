"""Raster images: bitmap and network-graphics files to samples and back, and how alike two images are."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

MOST_PIXELS = 1 << 28
# Fixed value of the format.
PNG_HEAD = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


class BadImage(ValueError):
    pass


@dataclass
class Frame:
    """samples: height x width x channels (1 gray, 2 gray and alpha, 3 RGB, 4 RGB and alpha), 8 bits each."""

    samples: np.ndarray

    @property
    def size(self) -> tuple[int, int, int]:
        return self.samples.shape[1], self.samples.shape[0], self.samples.shape[2]


def _limited(width: int, height: int) -> None:
    if width <= 0 or height <= 0 or width * height > MOST_PIXELS:
        raise BadImage(f"{width} x {height}")


def decode_bmp(data: bytes) -> Frame:
    """Uncompressed bitmaps of 8 bits by palette, 24 and 32 bits; rows from below unless the height is negative."""
    if data[:2] != b"BM" or len(data) < 54:
        raise BadImage("no bitmap")
    start, head, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    turned, height = height > 0, abs(height)
    _limited(width, height)
    if packing not in (0, 3) or bits not in (8, 24, 32):
        raise BadImage(f"{bits} bits, packing {packing}")
    row = (width * bits + 31) // 32 * 4
    if len(data) < start + row * height:
        raise BadImage("ends within its rows")
    rows = np.frombuffer(data, np.uint8, row * height, start).reshape(height, row)[:, : width * bits // 8].reshape(height, width, bits // 8)
    rows = rows[::-1] if turned else rows
    if bits == 8:
        colours = np.frombuffer(data[14 + head : start], np.uint8)
        table = np.zeros((256, 3), np.uint8)
        n = min(256, len(colours) // 4)
        table[:n] = colours[: 4 * n].reshape(-1, 4)[:, 2::-1]
        return Frame(table[rows[..., 0]])
    return Frame(np.ascontiguousarray(rows[..., [2, 1, 0, 3][: bits // 8]]))


def encode_bmp(frame: Frame) -> bytes:
    """24 bits a pixel, rows from below; alpha is left out, gray is three equal channels."""
    x = frame.samples
    rgb = np.repeat(x[..., :1], 3, axis=2) if x.shape[2] < 3 else x[..., :3]
    height, width = x.shape[:2]
    row = (width * 3 + 3) // 4 * 4
    rows = np.zeros((height, row), np.uint8)
    rows[:, : width * 3] = rgb[::-1, :, ::-1].reshape(height, -1)
    return struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode_png(data: bytes) -> Frame:
    """Images of 1 to 16 bits, by rows (not interlaced); 16 bits are read as their upper 8, palettes as RGB."""
    if data[:8] != PNG_HEAD:
        raise BadImage("no network graphics")
    at, body, head, palette = 8, b"", None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        if len(part) < n or zlib.crc32(kind + part) != int.from_bytes(data[at + 8 + n : at + 12 + n], "big"):
            raise BadImage("a damaged chunk")
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += part
        elif kind == b"IEND":
            break
    if head is None or head[3] not in _CHANNELS or head[6]:
        raise BadImage("no header that is read here")
    width, height, bits, colour = head[:4]
    _limited(width, height)
    channels = _CHANNELS[colour]
    row, step = (width * channels * bits + 7) // 8, max(1, channels * bits // 8)
    reader = zlib.decompressobj()
    raw = reader.decompress(body, (row + 1) * height)
    if len(raw) < (row + 1) * height:
        raise BadImage("ends within its rows")
    rows = _unfiltered(np.frombuffer(raw, np.uint8).reshape(height, row + 1), step)
    if bits == 16:
        samples = rows.reshape(height, width, channels, 2)[..., 0]
    elif bits == 8:
        samples = rows.reshape(height, width, channels)
    else:
        flat = np.unpackbits(rows, axis=1).reshape(height, -1, bits)
        samples = (flat * (1 << np.arange(bits - 1, -1, -1))).sum(axis=2)[:, :width, None].astype(np.uint8)
        samples = samples if colour == 3 else samples * (255 // ((1 << bits) - 1))
    if colour == 3:
        if palette is None or samples.max(initial=0) >= len(palette):
            raise BadImage("a palette that is too short")
        samples = palette[samples[..., 0]]
    return Frame(np.ascontiguousarray(samples, np.uint8))


def _unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """Rows less their filters: each byte was told as its difference from its neighbours to the left and above."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if (kinds == 2).all():
        return np.add.accumulate(out, axis=0, dtype=np.uint8)
    above = np.zeros(out.shape[1], np.uint8)
    for y, kind in enumerate(kinds.tolist()):
        line = out[y]
        if kind == 2:
            line += above
        elif kind == 1:
            for k in range(step):
                line[k::step] = np.add.accumulate(line[k::step], dtype=np.uint8)
        elif kind in (3, 4):
            now, up = line.tolist(), above.tolist()
            for i in range(len(now)):
                a, b, c = (now[i - step], up[i], up[i - step]) if i >= step else (0, up[i], 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if p <= q and p <= r else b if q <= r else c
                now[i] = now[i] + guess & 255
            line[:] = now
        elif kind:
            raise BadImage(f"filter {kind}")
        above = line
    return out


def encode_png(frame: Frame) -> bytes:
    """8 bits a sample, each row told as its difference from the row above."""
    x = frame.samples
    height, width, channels = x.shape
    flat = x.reshape(height, -1)
    rows = np.empty((height, flat.shape[1] + 1), np.uint8)
    rows[:, 0] = 2
    rows[0, 1:], rows[1:, 1:] = flat[0], flat[1:] - flat[:-1]
    colour = {n: c for c, n in _CHANNELS.items() if c != 3}[channels]

    def chunk(kind: bytes, part: bytes) -> bytes:
        return struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))

    return PNG_HEAD + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def gray(frame: Frame) -> np.ndarray:
    x = frame.samples.astype(float)
    return x[..., 0] if x.shape[2] < 3 else x[..., :3] @ np.array([0.299, 0.587, 0.114])


def alike(a: Frame, b: Frame, block: int = 8) -> float:
    """Structural similarity of two images of one size, as the mean over blocks of their gray; 1 for equal ones."""
    if a.size[:2] != b.size[:2]:
        raise BadImage("images of different sizes")
    x, y = gray(a), gray(b)
    one, two = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    cuts = [np.arange(0, n, block) for n in x.shape]
    high, wide = (np.diff(c, append=n) for c, n in zip(cuts, x.shape, strict=True))
    count = np.outer(high, wide)

    def mean(v: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.add.reduceat(v, cuts[0], axis=0), cuts[1], axis=1) / count

    def off(v: np.ndarray, m: np.ndarray) -> np.ndarray:
        return v - np.repeat(np.repeat(m, high, axis=0), wide, axis=1)

    mp, mq = mean(x), mean(y)
    p, q = off(x, mp), off(y, mq)
    return float(((2 * mp * mq + one) * (2 * mean(p * q) + two) / ((mp**2 + mq**2 + one) * (mean(p * p) + mean(q * q) + two))).mean())


def straightened(frame: Frame, corners: list[tuple[float, float]], width: int, height: int) -> Frame:
    """What lies between four corners (from the upper left, clockwise) as an image of its own: the plane's projective map, sampled between the four nearest pixels."""
    _limited(width, height)
    rows, right = [], []
    for (x, y), (u, v) in zip([(0, 0), (width - 1, 0), (width - 1, height - 1), (0, height - 1)], corners, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    m = np.linalg.lstsq(np.array(rows, float), np.array(right, float), rcond=None)[0]
    y, x = np.mgrid[0:height, 0:width]
    depth = m[6] * x + m[7] * y + 1
    u, v = (m[0] * x + m[1] * y + m[2]) / depth, (m[3] * x + m[4] * y + m[5]) / depth
    wide, high, _ = frame.size
    u, v = np.clip(u, 0, wide - 1), np.clip(v, 0, high - 1)
    i, j = np.minimum(u.astype(int), max(0, wide - 2)), np.minimum(v.astype(int), max(0, high - 2))
    p, q = (u - i)[..., None], (v - j)[..., None]
    s, k, n = frame.samples.astype(float), np.minimum(i + 1, wide - 1), np.minimum(j + 1, high - 1)
    out = (s[j, i] * (1 - p) + s[j, k] * p) * (1 - q) + (s[n, i] * (1 - p) + s[n, k] * p) * q
    return Frame(np.clip(np.rint(out), 0, 255).astype(np.uint8))
