"""Benchmark decontamination: a prefix-filtered set join of benchmark windows against whole documents."""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import guarded, without

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)
OUT = ["n_words", "n_hit", "n_items", "item_ids", "contaminated"]


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text after A-Z are lower-cased; every byte of a longer code point is part of a word."""
    return WORD.findall(text.lower()) if text else []


def _rolled(ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the k-word shingles all of whose words are known (id 0: unknown), and their hashes."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    known = np.concatenate([[0], np.cumsum(ids != 0)])
    at = np.nonzero(known[k:] - known[:-k] == k)[0]
    h = np.zeros(len(at), np.uint64)
    for i in range(k):
        h = _stirred(h, ids[at + i])
    return at, h


def _stirred(h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Hashes of shingles that go on with a word."""
    h = (h ^ ids.astype(np.uint64)) * _MULT
    return h ^ h >> np.uint64(29)


class WindowIndex:
    """Windows of one block of items: distinct word-id sequences, their shingles, and (once counted) rarest-first prefixes."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int, shingle: int):
        self.vocab: dict[bytes, int] = {}
        number: dict[str, int] = {}
        rows, owner = [np.empty((0, window), np.int32)], [np.empty(0, np.int64)]
        for name, text in items:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)], np.int32)
            if not len(ids):
                continue
            if len(ids) < window:
                ids = np.pad(ids, (0, window - len(ids)))
            rows.append(np.lib.stride_tricks.sliding_window_view(ids, window))
            owner.append(np.full(len(rows[-1]), number.setdefault(name, len(number)), np.int64))
        self.names = list(number)
        self.words, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.length = (self.words != 0).sum(axis=1)
        pairs = np.unique(np.stack([which.reshape(-1), np.concatenate(owner)], axis=1), axis=0)
        self.owner_at, self.owner = np.searchsorted(pairs[:, 0], np.arange(len(self.words) + 1)), pairs[:, 1]
        #: By shingle size, each window's shingle hashes in order. An item of fewer words than a shingle has is one shingle.
        self.shingles: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in np.unique(np.minimum(self.length, shingle)):
            of = np.nonzero(np.minimum(self.length, shingle) == size)[0]
            wide = window - int(size) + 1
            hashes = np.zeros((len(of), wide), np.uint64)
            for k in range(int(size)):
                hashes = _stirred(hashes, self.words[of, k : k + wide])
            self.shingles[int(size)] = (of, hashes)
        self.counted = {size: np.unique(h[self._inside(size, of, h)]) for size, (of, h) in self.shingles.items()}
        self.prefixes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def _inside(self, size: int, of: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Which places of `hashes` are shingles that lie within their window."""
        return np.arange(hashes.shape[1]) <= (self.length[of] - size)[:, None]

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocab.get, words, repeat(0)), np.int32, len(words))

    def seen(self, words: list[bytes]) -> list[tuple[int, np.ndarray]]:
        """By shingle size, which of the counted shingles are in a document, each once."""
        ids = self.ids(words)
        out = []
        for size, known in self.counted.items():
            h = _rolled(ids, size)[1]
            at = np.searchsorted(known, h)
            at = at[known[np.minimum(at, len(known) - 1)] == h]
            out.append((size, np.unique(at)))
        return out

    def order(self, frequency: dict[int, np.ndarray]) -> None:
        """Orders each window's shingles by document frequency, rarest first, and keeps the prefix that containment makes necessary.

        For whole containment the prefix is one shingle: the rarest. A window with a shingle of no document is left out.
        """
        for size, (of, hashes) in self.shingles.items():
            known = self.counted[size]
            df = frequency[size][np.minimum(np.searchsorted(known, hashes), len(known) - 1)].astype(np.int64)
            df[~self._inside(size, of, hashes)] = np.iinfo(np.int64).max
            at = df.argmin(axis=1)
            row = np.nonzero(df[np.arange(len(of)), at] > 0)[0]
            key = hashes[row, at[row]]
            by = np.argsort(key, kind="stable")
            keys, first = np.unique(key[by], return_index=True)
            self.prefixes[size] = (keys, np.append(first, len(by)), of[row[by]], at[row[by]])
        self.shingles = {}

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Which words of a document are inside an occurring window, and the numbers of the items that own such windows."""
        ids, n = self.ids(words), len(words)
        covered, found = np.zeros(n + 1, np.int64), []
        for size, (keys, first, window, offset) in self.prefixes.items():
            if not len(keys):
                continue
            at, h = _rolled(ids, size)
            slot = np.searchsorted(keys, h)
            match = np.nonzero(keys[np.minimum(slot, len(keys) - 1)] == h)[0]
            for part in np.array_split(match, len(match) // 4096 + 1):
                many = first[slot[part] + 1] - first[slot[part]]
                if not many.sum():
                    continue
                which = np.repeat(first[slot[part]] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
                w = window[which]
                start = np.repeat(at[part], many) - offset[which]
                fits = (start >= 0) & (start + self.length[w] <= n)  # bounds on position and length
                w, start = w[fits], start[fits]
                span = np.arange(self.words.shape[1])
                inside = span < self.length[w][:, None]
                same = (ids[np.minimum(start[:, None] + span, n - 1)] == self.words[w]) | ~inside
                ok = same.all(axis=1)  # the whole window, word by word
                w, start = w[ok], start[ok]
                np.add.at(covered, start, 1)
                np.add.at(covered, start + self.length[w], -1)
                found.append(np.unique(w))
        if not found:
            return np.zeros(n, bool), np.empty(0, np.int64)
        w = np.unique(np.concatenate(found))
        items = np.unique(np.concatenate([self.owner[self.owner_at[k] : self.owner_at[k + 1]] for k in w]))
        return np.cumsum(covered[:n]) > 0, items


def _blocks(items: DataFrame, id_col: str, text_col: str, window: int, shingle: int, block_chars: int):
    """One WindowIndex after another, each over at most about block_chars characters of items."""
    slim = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("name"), F.col(text_col).alias("text")).where("text is not null")
    chars, longest = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.max(F.octet_length("text")), F.lit(0))).first()
    n = max(1, -(-int(chars) // max(1, block_chars - min(int(longest), block_chars // 2))))
    for b in range(n):
        rows = slim.where(F.pmod(F.xxhash64("name"), F.lit(n)) == b).orderBy("name", "text").collect() if n > 1 else slim.orderBy("name", "text").collect()
        yield WindowIndex([(r.name, r.text.encode()) for r in rows], window, shingle)


def _texts(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


@guarded("_t")
def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "item_id", item_text: str = "text", text_col: str = "text",
                  window: int = 13, shingle: int = 5, share: float = 0.05, block_chars: int = 4_000_000, keep: list[str] | None = None) -> DataFrame:
    """Adds to each document n_words, n_hit, n_items, item_ids (sorted strings) and contaminated.

    A window is `window` consecutive words of an item (all of them, if it has fewer). Windows are sets of word shingles;
    one pass over all documents counts how many hold each shingle of a window, so that the windows' shingles can be
    ordered by rarity; as whole containment is asked for, the rarest one is the necessary prefix. A second pass looks up
    prefixes in every document, applies the bounds on position and length, and compares the whole window word by word.
    contaminated: n_hit > 0 and n_hit >= share * n_words.

    Items go to the workers in blocks of about block_chars bytes, however many there are (a longer single item is a block
    of its own). Documents are read twice, in both passes a batch of texts against one block after another, so that a
    worker and the driver have one block in memory, and a block is loaded once a batch. They are never shuffled, so a
    passage in a third of them is no hot key.
    Null and empty texts have no words; items without words match nothing; a null item id reads "null"; rows with the
    same item id are one item; repeated documents each get their row; an empty table gives no rows. Input columns named
    like an output column are replaced. keep: the input columns to return (all, if None).
    """
    spark = docs.sparkSession
    src = without(docs, OUT) if text_col not in OUT else docs
    blocks, sizes = [], []
    for index in _blocks(items, id_col, item_text, window, shingle, block_chars):
        sizes.append({size: len(x) for size, x in index.counted.items()})
        blocks.append(spark.sparkContext.broadcast(index))
        del index

    def by_block():
        """(number of the block, its index) one after another, one in memory at a time."""
        for b, shared in enumerate(blocks):
            yield b, shared.value
            if len(blocks) > 1:
                del shared._value

    def count(batches):
        for batch in batches:
            texts = _texts(batch, "t")
            for b, index in by_block():
                totals = {size: np.zeros(len(x), np.int64) for size, x in index.counted.items()}
                for text in texts:
                    for size, at in index.seen(words_of(text)):
                        totals[size][at] += 1
                for size, x in totals.items():
                    at = np.nonzero(x)[0]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), b), pa.int32()), pa.array(np.full(len(at), size), pa.int32()), pa.array(at, pa.int64()), pa.array(x[at], pa.int64())], ["block", "size", "at", "n"])

    frequency = [{size: np.zeros(n, np.int64) for size, n in x.items()} for x in sizes]
    if any(frequency):
        seen = src.select(F.col(f"`{text_col}`").alias("t")).where("t is not null").mapInArrow(count, "block int, size int, at long, n long")
        for r in seen.groupBy("block", "size", "at").agg(F.sum("n").alias("n")).toLocalIterator():
            frequency[r["block"]][r["size"]][r["at"]] = r["n"]
    for b, shared in enumerate(blocks):
        index = shared.value
        index.order(frequency[b])
        blocks[b] = spark.sparkContext.broadcast(index)
        shared.destroy()
        del index
    names = [c for c in src.columns if keep is None or c in keep]
    fields = [src.schema[c] for c in names]
    src = src.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").alias("_t"))
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
                           T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("contaminated", T.BooleanType())])

    def match(batches):
        for batch in batches:
            texts = _texts(batch, "_t")
            n_words, hit, found = np.zeros(len(texts), np.int64), [None] * len(texts), [[] for _ in texts]
            for _, index in by_block():
                for i, text in enumerate(texts):
                    words = words_of(text)
                    n_words[i] = len(words)
                    inside, owners = index.hits(words)
                    if len(owners):
                        hit[i] = inside if hit[i] is None else hit[i] | inside
                        found[i] += [index.names[k] for k in owners]
            n_hit = np.array([0 if h is None else int(h.sum()) for h in hit], np.int64)
            names = [sorted(set(x)) for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in names], pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array((n_hit > 0) & (n_hit >= share * n_words))], schema.fieldNames())

    return src.mapInArrow(match, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
                      ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


SQL = r"""
WITH item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
cut AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT DISTINCT r, i, n, item FROM cut JOIN win USING (n, g)),
per AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN per USING (r) LEFT JOIN items USING (r)
"""
