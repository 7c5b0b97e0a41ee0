"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re

import numpy as np
import xxhash


def classes(ids, linked):
    """Smallest id reachable, by repeated relaxation over linked(i, j)."""
    root = {i: i for i in range(len(ids))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i, x in enumerate(ids):
        low[find(i)] = min(low.get(find(i), x), x)
    return [low[find(i)] for i in range(len(ids))]


def simhash(text: str | None) -> int:
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def windows_in(text: str | None, items: list[tuple[object, str | None]]):
    """(n_words, n_hit, item ids) of one document."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = split(text), set(), set()
    for name, t in items:
        w = split(t)
        n = min(13, len(w))
        if not n:
            continue
        for i in range(len(w) - n + 1):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add("null" if name is None else str(name))
    return len(words), len(hit), sorted(found)


def cosine_links(vectors, least=0.95):
    x = np.array(vectors, float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = x @ x.T >= least
    np.fill_diagonal(out, False)
    return out


def repeated(docs: list[tuple[int, str]], words: int = 25) -> dict[int, set[int]]:
    """Lines that repeat: each run of lines of a document that equals an earlier one, grown as far as it goes.

    Every gram (the fewest lines with so many words) that has an earlier first occurrence counts, fingerprint or not, so
    this is what winnowing may delete at most, and all of it in runs of twice as many words.
    """
    word = re.compile("[^\x20\x09-\x0d]+")
    rows = {}
    for d, text in docs:
        lines = [(p, line, len(word.findall(line))) for p, line in enumerate(text.split("\n"))]
        rows[d] = [x for x in lines if x[2]]
    first, gone = {}, {d: set() for d, _ in docs}
    for d, lines in rows.items():
        for i in range(len(lines)):
            n, j = 0, i
            while j < len(lines) and n < words:
                n, j = n + lines[j][2], j + 1
            if n < words:
                continue
            gram = tuple(line for _, line, _ in lines[i:j])
            if gram not in first:
                first[gram] = (d, i)
                continue
            e, k = first[gram]
            other, a, b = rows[e], i, j
            while a > 0 and k - (i - a) > 0 and lines[a - 1][1] == other[k - (i - a) - 1][1]:
                a -= 1
            while b < len(lines) and k + b - i < len(other) and lines[b][1] == other[k + b - i][1]:
                b += 1
            gone[d] |= set(range(lines[a][0], lines[b - 1][0] + 1))
    return gone
