"""The block cipher of document encryption, in cipher-block chaining: tables by their rule, decryption over all blocks at once."""

from __future__ import annotations

import numpy as np


def _times(a: int, b: int) -> int:
    """The product of two bytes as polynomials modulo x^8 + x^4 + x^3 + x + 1."""
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a = a << 1 ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


def _substitution() -> list[int]:
    """Each byte's inverse, its bits mixed with those four places on, and 0x63."""
    inverse = [0] * 256
    for a in range(1, 256):
        if not inverse[a]:
            b = next(b for b in range(1, 256) if _times(a, b) == 1)
            inverse[a], inverse[b] = b, a
    out = []
    for v in inverse:
        s = 0x63
        for k in range(5):
            s ^= (v << k | v >> 8 - k) & 0xFF
        out.append(s)
    return out


SBOX = _substitution()
_BACK = np.argsort(np.array(SBOX)).astype(np.uint8)
_COLUMN = (2, 1, 1, 3)  # what a byte in the first row is multiplied by for its column's four; the other rows' are turned
_TE = [[int.from_bytes(bytes(_times(SBOX[x], _COLUMN[(i - k) % 4]) for i in range(4)), "big") for x in range(256)] for k in range(4)]
_MIX = {m: np.array([_times(x, m) for x in range(256)], np.uint8) for m in (9, 11, 13, 14)}
_ROWS = np.array([0, 13, 10, 7, 4, 1, 14, 11, 8, 5, 2, 15, 12, 9, 6, 3])  # where each byte of a state comes from as rows turn back


def expand(key: bytes) -> list[int]:
    """The round keys of a key of 16 or 32 bytes, as 32-bit words."""
    n = len(key) // 4
    words = [int.from_bytes(key[4 * i : 4 * i + 4], "big") for i in range(n)]
    rcon = 1
    for i in range(n, 4 * (n + 7)):
        t = words[-1]
        if i % n == 0:
            t = (t << 8 | t >> 24) & 0xFFFFFFFF
            t = _sub(t) ^ rcon << 24
            rcon = _times(rcon, 2)
        elif n > 6 and i % n == 4:
            t = _sub(t)
        words.append(words[i - n] ^ t)
    return words


def _sub(word: int) -> int:
    return SBOX[word >> 24] << 24 | SBOX[word >> 16 & 255] << 16 | SBOX[word >> 8 & 255] << 8 | SBOX[word & 255]


def cbc_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """data in whole blocks, each mixed with the one before."""
    rk, (t0, t1, t2, t3) = expand(key), _TE
    a, b, c, d = (int.from_bytes(iv[i : i + 4], "big") for i in (0, 4, 8, 12))
    out, last = bytearray(), len(rk) - 4
    for at in range(0, len(data), 16):
        a ^= int.from_bytes(data[at : at + 4], "big") ^ rk[0]
        b ^= int.from_bytes(data[at + 4 : at + 8], "big") ^ rk[1]
        c ^= int.from_bytes(data[at + 8 : at + 12], "big") ^ rk[2]
        d ^= int.from_bytes(data[at + 12 : at + 16], "big") ^ rk[3]
        for k in range(4, last, 4):
            a, b, c, d = (
                t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ rk[k],
                t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ rk[k + 1],
                t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ rk[k + 2],
                t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ rk[k + 3],
            )
        s = SBOX
        a, b, c, d = (
            (s[a >> 24] << 24 | s[b >> 16 & 255] << 16 | s[c >> 8 & 255] << 8 | s[d & 255]) ^ rk[last],
            (s[b >> 24] << 24 | s[c >> 16 & 255] << 16 | s[d >> 8 & 255] << 8 | s[a & 255]) ^ rk[last + 1],
            (s[c >> 24] << 24 | s[d >> 16 & 255] << 16 | s[a >> 8 & 255] << 8 | s[b & 255]) ^ rk[last + 2],
            (s[d >> 24] << 24 | s[a >> 16 & 255] << 16 | s[b >> 8 & 255] << 8 | s[c & 255]) ^ rk[last + 3],
        )
        out += (a << 96 | b << 64 | c << 32 | d).to_bytes(16, "big")
    return bytes(out)


def cbc_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """The inverse; a part of a block at the end is passed over."""
    data = data[: len(data) // 16 * 16]
    x = np.frombuffer(data, np.uint8).reshape(-1, 16)
    rk = np.frombuffer(b"".join(w.to_bytes(4, "big") for w in expand(key)), np.uint8).reshape(-1, 16)
    s = x ^ rk[-1]
    for k in range(len(rk) - 2, -1, -1):
        s = _BACK[s[:, _ROWS]] ^ rk[k]
        if k:
            a, b, c, d = (s[:, i::4] for i in range(4))
            mixed = np.empty_like(s)
            for i, (p, q, r, t) in enumerate(((a, b, c, d), (b, c, d, a), (c, d, a, b), (d, a, b, c))):
                mixed[:, i::4] = _MIX[14][p] ^ _MIX[11][q] ^ _MIX[13][r] ^ _MIX[9][t]
            s = mixed
    before = np.concatenate([np.frombuffer(iv, np.uint8)[None], x[:-1]]) if len(x) else x
    return (s ^ before).tobytes()


def padded(data: bytes) -> bytes:
    n = 16 - len(data) % 16
    return data + bytes([n]) * n


def unpadded(data: bytes) -> bytes:
    """Less what padded() adds; data without such an end is as it is."""
    n = data[-1] if data else 0
    return data[:-n] if 1 <= n <= 16 and data[-n:] == bytes([n]) * n else data
