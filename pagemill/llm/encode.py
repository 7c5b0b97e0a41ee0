"""Byte-level BPE through the tokenizers library, with what single words encode to remembered."""

from __future__ import annotations

import re

import numpy as np

_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Where a text may be cut: a piece of the pre-tokenizer starts at such a space, whatever is around.
_CUT = re.compile(f"(?<=[^{_SPACE}]) (?=[^{_SPACE}])")
#: Pieces that are one to the pre-tokenizer: with a space before each, or each on a line of its own. Letters are some that are letters to every version of Unicode.
_ONE = "(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]++|[0-9]++|[\x00-\x08\x0e-\x1f!-&(-/:-@\\[-`{-\x7f]++)"
_ONES = re.compile(f"(?: {_ONE})++|(?:{_ONE}\n)*+{_ONE}")
_LONG = 64
_CHARS = 1_000_000
#: Kinds of bytes: letters (and all beyond ASCII), digits, other marks, white space.
_KIND = bytes(3 if k == 32 or 9 <= k <= 13 else 1 if 48 <= k <= 57 else 0 if chr(k).isalpha() or k > 127 else 2 for k in range(256))
#: White space of two and three bytes.
_SPACES = np.array(sorted(int.from_bytes(chr(k).encode()) << 8 * (k < 0x800) for k in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Bytes of a piece that fit its key, and which of 8 bytes belong to one of 0 to 8 bytes.
_SHORT = 15
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_open: dict[str, "Encoder"] = {}


def _byte_letters() -> dict[int, str]:
    """What byte-level vocabularies write for each byte; with a space before it for the space."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: " " * (b == 32) + chr(256 + k) for k, b in enumerate(other)}


def _ranges(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers at, at + 1, ... of each range, one range after another."""
    ends = np.cumsum(size)
    return np.repeat(at - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def _pieces(raw: bytes, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the pieces of texts start that the pre-tokenizer never joins, and which are one piece to it and no white space.

    The texts are UTF-8, one after another, and start at firsts. White space before a word is a piece, less its last
    character, which is the word's if it is a space. Words are split between letters, digits and marks, unless they have
    an apostrophe or something beyond the letters up to U+024F, which are letters to every version of Unicode.
    """
    b = np.frombuffer(raw + bytes(16), np.uint8)
    kind = np.frombuffer(bytearray(raw.translate(_KIND)), np.uint8)
    odd = np.flatnonzero(b[: len(raw)] == 0x27)
    if not raw.isascii():
        lead = np.flatnonzero(b >= 0xC2)
        one, two = b[lead], b[lead + 1]
        lead = lead[~((one == 0xC3) & (two != 0x97) & (two != 0xB7) | (one >= 0xC4) & (one <= 0xC8) | (one == 0xC9) & (two <= 0x8F))]
        one, two, three = (b[lead + k].astype(np.int64) for k in range(3))
        size = 2 + (one >= 0xE0)
        space = np.isin(one << 16 | two << 8 | three * (size == 3), _SPACES)
        kind[_ranges(lead[space], size[space])] = 3
        odd = np.sort(np.concatenate([odd, lead[~space]]))
    white = kind == 3
    mark = np.zeros(len(raw) + 1, bool)
    mark[1:-1] = white[1:] != white[:-1]
    new = np.zeros(len(raw) + 1, bool)
    new[firsts] = True
    word = np.flatnonzero(white[:-1] & ~white[1:]) + 1
    word = word[~new[word]]
    last = word - 1
    wide = np.flatnonzero(b[last] >= 0x80)
    last[wide] -= 1 + (b[last[wide] - 1] < 0xC0)
    mark[word] = b[last] != 32
    mark[last] = True
    mark |= new
    mark[-1] = True
    inner = np.flatnonzero((kind[1:] != kind[:-1]) & ~white[1:] & ~white[:-1]) + 1
    inner = inner[~mark[inner]]
    if len(odd):
        starts = np.flatnonzero(mark)
        k = np.unique(np.searchsorted(starts, odd, "right"))
        low, high = np.searchsorted(inner, starts[k - 1]), np.searchsorted(inner, starts[k])
        keep = np.ones(len(inner), bool)
        keep[_ranges(low, high - low)] = False
        inner = inner[keep]
    mark[inner] = True
    bounds = np.flatnonzero(mark)
    single = ~white[bounds[1:] - 1]
    single[np.searchsorted(bounds, odd, "right") - 1] = False
    return bounds[:-1], np.diff(bounds), single


class _Memory:
    """What pieces of up to 15 bytes encode to, looked up many at a time. A key is a piece's bytes and its length, so that equal keys are equal pieces."""

    def __init__(self):
        self.n = self.used = self.clock = 0
        self.low, self.high = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.size, self.seen = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(1 << 16, "<u4")
        self.slots = np.zeros(0, np.int32)

    def _home(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The slot that the search for a key starts at."""
        h = low * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h += high
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x165667B19E3779F9)
        return (h >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def room(self, n: int) -> None:
        """Makes room for n more pieces."""
        if self.n + n > len(self.low):
            more = self.n + n + len(self.low) // 4
            for name in ("low", "high", "at", "size", "seen"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old[: self.n], np.zeros(more - self.n, old.dtype)]))
        if 2 * (self.n + n) > len(self.slots):
            self._deal(1 << (2 * (self.n + n)).bit_length())

    def _deal(self, slots: int) -> None:
        """Deals all pieces to so many slots."""
        self.slots = np.full(slots, -1, np.int32)
        n, self.n = self.n, 0
        number, _ = self.find(self.low[:n].copy(), self.high[:n].copy())
        for a in (self.at, self.size, self.seen):
            a[number] = a[:n].copy()

    def find(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each key's number, and the places of those that weren't there; these get the next numbers, in this order. There must be room."""
        out, new = np.empty(len(low), np.int64), []
        todo, slot = np.arange(len(low)), self._home(low, high)
        while len(todo):
            k = self.slots[slot]
            hit = (self.low[k] == low[todo]) & (self.high[k] == high[todo]) & (k >= 0)
            out[todo[hit]] = k[hit]
            free = np.flatnonzero(k < 0)
            if len(free):
                # Of keys at one free slot the last takes it; the others look there again.
                at = slot[free]
                self.slots[at] = -2 - free
                won = free[self.slots[at] == -2 - free]
                number = self.n + np.arange(len(won))
                self.low[number], self.high[number] = low[todo[won]], high[todo[won]]
                self.slots[slot[won]] = out[todo[won]] = number
                self.n += len(won)
                new.append(todo[won])
                hit[won] = True
            slot = (slot + (k >= 0))[~hit] & (len(self.slots) - 1)
            todo = todo[~hit]
        return out, np.concatenate([*new, np.zeros(0, np.int64)])

    def put(self, ids: np.ndarray) -> int:
        """Adds ids to the pool; returns their place."""
        at = self.used
        if at + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[:at], np.zeros(at // 2 + 2 * len(ids), "<u4")])
        self.pool[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def forget(self, most: int) -> None:
        """Keeps the `most` pieces met last."""
        keep = np.sort(np.argpartition(self.seen[: self.n], self.n - most)[self.n - most :])
        ids = self.pool[_ranges(self.at[keep], self.size[keep])]
        for name in ("low", "high", "at", "size", "seen"):
            setattr(self, name, getattr(self, name)[keep])
        self.n, self.used, self.at = len(keep), 0, np.cumsum(self.size) - self.size
        self.put(ids)
        self._deal(len(self.slots))


class Encoder:
    """Encodes whole texts as the library does; pieces are encoded once and remembered, those of up to 15 bytes in arrays, those of up to 64 characters by themselves.

    Texts with one of the tokenizer's added tokens, and tokenizers that aren't byte-level BPE with the usual pattern,
    go through the library as they are. Of more than twice `most` short pieces the `most` met last are kept; of others, those
    met since the last `most` new ones, and those met before.
    """

    def __init__(self, path: str, most: int = 400_000):
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The same model for words alone, already written as the vocabulary writes them.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = _byte_letters()
        self.letters[10] = f" {self.letters[10]} "
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        pre = said.get("pre_tokenizer") or {}
        self.added = [x["content"] for x in said.get("added_tokens", [])]
        self.by_piece = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and said.get("normalizer") is None
        self.most = most
        vocab = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[k for t, k in vocab.items() if t.startswith("\u0120")]] = True
        self.size = np.zeros(len(self.opens), np.int64)
        for t, k in vocab.items():
            self.size[k] = len(t.encode()) if t in self.added else len(t)
        self.line = vocab.get("\u010a", -1)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.memory = _Memory()

    @classmethod
    def at(cls, path: str) -> Encoder:
        """One per path and process."""
        if path not in _open:
            _open[path] = cls(path)
        return _open[path]

    def _whole(self, text: str) -> bool:
        return not self.by_piece or any(x in text for x in self.added)

    def _learn(self, pieces: list[str]) -> None:
        """Encodes pieces together, and leaves their ids, and from where to where each one's are, in `learnt`.

        All or none of them start with a space; they are told apart by tokens that start with one, or by ends of lines.
        """
        spaced = pieces[0][0] == " "
        text = ("" if spaced else "\n").join(pieces)
        ones = _ONES.fullmatch(text)
        tokenizer = self.words if ones else self.tokenizer
        if ones:
            text = text.encode().decode("latin-1").translate(self.letters)
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(self.opens[ids] if spaced else ids == self.line)
        first, last = (at, np.append(at[1:], len(ids))) if spaced else (np.append(0, at + 1), np.append(at, len(ids)))
        if len(first) != len(pieces):  # not the vocabulary this was made for
            codes = self._ids(pieces)
            ids, last = np.frombuffer(b"".join(codes), "<u4"), np.cumsum([len(c) // 4 for c in codes])
            first = np.append(0, last[:-1])
        self.learnt = ids, first, last

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        parts, owner, size = [], [], 0
        for k, t in enumerate(texts):
            if self._whole(t):
                out[k] = self._ids([t])
                continue
            at = 0
            while at < len(t):
                cut = _CUT.search(t, at + _CHARS) if len(t) - at > _CHARS else None
                end = cut.start() if cut else len(t)
                parts.append(t[at:end])
                owner.append(k)
                size, at = size + end - at, end
                if size >= _CHARS:
                    self._encode(parts, owner, out)
                    parts, owner, size = [], [], 0
        if parts:
            self._encode(parts, owner, out)
        return [b"".join(codes) for codes in out]

    def _encode(self, parts: list[str], owner: list[int], out: list[list[bytes]]) -> None:
        """Adds the ids of parts, none of them empty, to their owners'."""
        coded = [t.encode() for t in parts]
        raw = b"".join(coded)
        ends = np.cumsum([len(c) for c in coded])
        firsts = np.concatenate([[0], ends[:-1]])
        starts, sizes, single = _pieces(raw, firsts)
        at, n = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        memory = self.memory
        if memory.n > 2 * self.most:
            memory.forget(self.most)
        memory.clock += 1
        short = np.flatnonzero(sizes <= _SHORT)
        s, size = starts[short], sizes[short]
        word = np.ndarray(len(raw) + 9, "<u8", raw + bytes(16), strides=(1,))
        low = word[s] & _KEEP[np.minimum(size, 8)]
        high = word[s + 8] & _KEEP[np.maximum(size - 8, 0)] | size.astype(np.uint64) << np.uint64(56)
        memory.room(len(short))
        before = memory.n
        try:
            number, new = memory.find(low, high)
            if len(new):
                self._add(raw, s[new], size[new], single[short[new]], before)
        except BaseException:
            self.memory = _Memory()  # some pieces in it have no ids yet
            raise
        memory.seen[number] = memory.clock
        at[short], n[short] = memory.at[number], memory.size[number]
        used = memory.used
        far = np.flatnonzero(sizes > _SHORT)
        if len(far):
            at[far], n[far] = self._put(self._far([raw[a : a + k].decode() for a, k in zip(starts[far].tolist(), sizes[far].tolist(), strict=True)]))
        ids = memory.pool[_ranges(at, n)].tobytes()
        memory.used = used
        total = np.concatenate([[0], np.cumsum(n)])
        stops = 4 * total[np.searchsorted(starts, ends)]
        for k, a, z in zip(owner, [0, *stops[:-1].tolist()], stops.tolist(), strict=True):
            out[k].append(ids[a:z])

    def _add(self, raw: bytes, starts: np.ndarray, sizes: np.ndarray, single: np.ndarray, before: int) -> None:
        """Gives the memory the ids of its pieces from number `before` on."""
        memory = self.memory
        pieces = [raw[a:z].decode() for a, z in zip(starts.tolist(), (starts + sizes).tolist(), strict=True)]
        spaced = np.frombuffer(raw, np.uint8)[starts] == 32
        for chosen in (single & spaced, single & ~spaced):
            mine = np.flatnonzero(chosen)
            if len(mine):
                self._learn(list(map(pieces.__getitem__, mine.tolist())))
                ids, first, last = self.learnt
                memory.at[before + mine], memory.size[before + mine] = memory.put(ids) + first, last - first
        mine = np.flatnonzero(~single)
        memory.at[before + mine], memory.size[before + mine] = self._put(self._far(list(map(pieces.__getitem__, mine.tolist()))))

    def _put(self, codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Adds ids to the memory's pool; returns the places and numbers of each."""
        n = np.array([len(c) // 4 for c in codes], np.int64)
        return self.memory.put(np.frombuffer(b"".join(codes), "<u4")) + np.cumsum(n) - n, n

    def _far(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces that the memory isn't for."""
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        new = self._unknown(set(pieces))
        white = [p for p in new if p.isspace()]
        self.known.update(zip(white, self._ids(white), strict=True))
        words = new.difference(white)
        spaced = [p for p in words if p[0] == " "]
        for part in (spaced, list(words.difference(spaced))):
            if part:
                self._learn(part)
                ids, first, last = self.learnt
                code = ids.tobytes()
                self.known.update((p, code[4 * a : 4 * z]) for p, a, z in zip(part, first.tolist(), last.tolist(), strict=True))
        out = list(map(self.known.__getitem__, pieces))
        for p in new:
            if len(p) > _LONG:
                del self.known[p]
        return out

    def _unknown(self, pieces: set[str]) -> set[str]:
        """Those of pieces that aren't remembered; what is only among those met before is taken over."""
        pieces = pieces.difference(self.known)
        if self.older:
            again = [p for p in pieces if p in self.older]
            self.known.update(zip(again, map(self.older.__getitem__, again), strict=True))
            pieces.difference_update(again)
        return pieces

    def offsets(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The character spans (starts, ends) of each text's tokens. Tokens of parts of a character span the character.

        Byte-level tokens follow each other byte for byte, so their spans are running sums of their lengths.
        """
        if not self.by_piece:
            spans = [np.array(e.offsets, np.int64).reshape(-1, 2) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            return [(x[:, 0], x[:, 1]) for x in spans]
        out = []
        for t, code in zip(texts, self.encode(texts), strict=True):
            ends = np.cumsum(self.size[np.frombuffer(code, "<u4")])
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            if not t.isascii():
                char = np.cumsum((np.frombuffer(t.encode(), np.uint8) & 0xC0) != 0x80) - 1
                starts, ends = char[starts], char[ends - 1] + 1
            out.append((starts, ends))
        return out


def groups(texts: list, chars: int = 4_000_000):
    """Index ranges of texts of together about `chars` characters."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
