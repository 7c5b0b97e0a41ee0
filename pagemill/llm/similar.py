"""Near-duplicates at a similarity of shingle sets, by wide SimHashes over a ring of byte segments."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagemill.llm import simhash
from pagemill.llm.common import drop_staged, free_name, guarded, partitions, stage

OUT = ["component_id"]
#: The most rows of a bucket whose pairs are all looked at; in larger ones only a forest's.
FEW = 16
_GAMMA = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes | None, words: int = 5) -> np.ndarray:
    """Hashes of a UTF-8 text's distinct shingles of `words` words, A-Z lower-cased; a text of fewer words is one shingle, of none has none."""
    parts = text.lower().split() if text else []  # bytes: A-Z only, and exactly \x20 and \x09-\x0D
    if not parts:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
    n = max(1, len(ids) - words + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(words, len(ids))):
        h = (h ^ ids[k : k + n]) * _GAMMA
        h ^= h >> np.uint64(29)
    return np.unique(h)


def fingerprint(hashes: np.ndarray, bits: int) -> bytes:
    """The SimHash of a set of hashes: a bit is 1 if it is set in over half of what the hashes spread to; all 0 for none."""
    ones, step = np.zeros(bits, np.int64), 255 * 16
    spread = np.arange(1, bits // 64 + 1, dtype=np.uint64) * _GAMMA
    for at in range(0, len(hashes), step):
        x = hashes[at : at + step, None] + spread
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        on = np.unpackbits(x.view(np.uint8), axis=1)
        for a in range(0, len(on), 255):  # sums of 255 bits fit a byte
            ones += on[a : a + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).tobytes()


class Wide:
    """Fingerprints whose bytes are a ring of segments; two link at `most` or fewer differing bits.

    `most` is what two sets of the least similarity (Jaccard) and equal sizes differ in: their vectors' angle, over pi,
    of the bits. A bucket is a chain of two equal segments from one start. From there a candidate's chain is followed
    eight segments at a time, and its cumulative differences must stay within a proportional budget and two standard
    deviations, before all bits are counted. A pair of the least similarity has no certain bucket, as one of a few bits
    has (simhash.Ring): of random pairs that differ in `most` bits, `recall` share one and pass its chain.
    """

    def __init__(self, similarity: float = 0.8, bits: int = 384):
        self.bits, self.n = bits, bits // 8
        share = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
        self.most = int(bits * share)
        self.budget = [int(64 * k * share + 2 * math.sqrt(64 * k * share * (1 - share))) for k in range(1, bits // 64)] + [self.most]

    def keys(self, fps: np.ndarray) -> np.ndarray:
        """Bucket keys (start, fingerprint) of fingerprints as rows of bytes."""
        wide = fps.astype(np.int64).T
        return wide | np.roll(wide, -1, axis=0) << 8 | np.arange(self.n)[:, None] << 16

    def turned(self, fps: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Fingerprints as 64-bit words of the ring, read from each row's start."""
        at = (start[:, None] + np.arange(self.n)) % self.n
        return np.take_along_axis(fps, at, axis=1).view(np.uint64)

    def linked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which rows of two arrays from turned() keep the chain's budgets."""
        left, total = np.arange(len(b)), np.zeros(len(b), np.int64)
        for k, most in enumerate(self.budget):
            total = total + np.bitwise_count((a if a.ndim == 1 else a[left])[..., k] ^ b[left, k])
            ok = total <= most
            left, total = left[ok], total[ok]
        out = np.zeros(len(b), bool)
        out[left] = True
        return out

    def owned(self, a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which pairs that link from `start` don't from an earlier start, so that each is told of once."""
        same = a == b
        meets = same & np.roll(same, -1, axis=1)
        left, out = np.arange(len(a)), np.zeros(len(a), bool)
        for t in range(self.n):
            at = np.nonzero(meets[left, t])[0]
            if len(at):
                i = left[at]
                turn = np.full(len(i), t)
                ok = self.linked(self.turned(a[i], turn), self.turned(b[i], turn))
                out[i[ok]] = start[i[ok]] == t
                left = np.delete(left, at[ok])
        return out

    def recall(self, pairs: int = 2000, seed: int = 5) -> float:
        """The share of random pairs that differ in exactly `most` bits which share a bucket and pass its chain."""
        rng = np.random.default_rng(seed)
        found = 0
        for _ in range(pairs):
            bits = np.zeros(self.bits, np.uint8)
            bits[rng.choice(self.bits, self.most, replace=False)] = 1
            diff = np.packbits(bits)
            at = np.nonzero((diff == 0) & (np.roll(diff, -1) == 0))[0]
            turned = self.turned(np.repeat(diff[None], len(at), axis=0), at)
            found += bool(len(at)) and bool(self.linked(np.zeros_like(turned), turned).any())
        return found / pairs


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as an Arrow array."""
    n, wide = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * wide).astype("<i4").tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _rows(column, wide: int) -> np.ndarray:
    """The bytes of an Arrow array of equally long values, as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, wide)


def name_of(fp: bytes) -> bytes:
    return xxhash.xxh3_128_digest(fp)


def bucket_links(batches, ring: Wide):
    """Links (a, b) of fingerprints' names within buckets of rows sorted by (key, cell).

    Of a bucket of few rows, the pairs that no earlier start has; of a larger one, a spanning forest.
    """
    for t, group in simhash.whole_buckets(batches):
        fps = _rows(t["fp"], ring.n)
        start = t["key"].to_numpy() >> 16
        size = np.bincount(group)
        ends = np.cumsum(size)
        a, b = [], []
        i = np.nonzero((size[group] > 1) & (size[group] <= FEW))[0]
        turned = ring.turned(fps, start)
        last = ends[group] - 1
        for d in range(1, FEW):
            i = i[i + d <= last[i]]
            for part in np.array_split(i, len(i) // 200_000 + 1):
                ok = part[ring.linked(turned[part], turned[part + d])]
                ok = ok[(fps[ok] != fps[ok + d]).any(axis=1)]
                ok = ok[ring.owned(fps[ok], fps[ok + d], start[ok])]
                a.append(ok)
                b.append(ok + d)
        for g in np.nonzero(size > FEW)[0]:
            x = turned[ends[g] - size[g] : ends[g]]
            p, q = simhash.forest(len(x), lambda i, j, x=x: ring.linked(x[i], x[j]))
            a.append(p + ends[g] - size[g])
            b.append(q + ends[g] - size[g])
        a, b = np.concatenate(a).astype(int), np.concatenate(b).astype(int)
        yield pa.RecordBatch.from_arrays([pa.array([name_of(fps[k].tobytes()) for k in x], pa.binary()) for x in (a, b)], ["a", "b"])


def links(nodes: DataFrame, ring: Wide) -> DataFrame:
    """Links (a, b) of names among nodes (name, fp), enough to connect them."""
    def index(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            fps = _rows(batch.column(0), ring.n)
            yield pa.RecordBatch.from_arrays([pa.array(ring.keys(fps).ravel()), _binary(np.tile(fps, (ring.n, 1)))], ["key", "fp"])

    rows = nodes.select("fp").mapInArrow(index, "key long, fp binary")
    rows = simhash.cells(rows, "key", simhash.BLOCK, "fp").drop("own")
    rows = rows.repartition(partitions(nodes.sparkSession), "key", "cell").sortWithinPartitions("key", "cell", "fp")
    return rows.mapInArrow(lambda batches: bucket_links(batches, ring), "a binary, b binary")


@guarded("_n")
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, bits: int = 384, keep: list[str] | None = None, extra: dict | None = None) -> DataFrame:
    """Adds component_id, the smallest id reachable over links of fingerprints as similar as two sets of Jaccard `similarity`.

    Fingerprints are SimHashes of `bits` bits of a text's set of shingles of `words` words (see Wide for the bound, the
    buckets and the recall). Equal fingerprints are one node, so that copies make no pairs. Null, empty and word-less
    texts have one fingerprint, all zero; a null id is passed over as component id unless a component has no other;
    repeated rows each get their row; an empty table gives no rows. Input columns named like an output column are
    replaced. keep: the input columns to return (all, if None). extra: further columns to return, by name, which docs
    must not have; "root" among the values stands for a name of the row's component, any other is an expression over docs.
    """
    ring = Wide(similarity, bits)
    names = [c for c in docs.columns if (keep is None or c in keep) and c.lower() not in OUT]
    own = {k: v for k, v in (extra or {}).items() if not isinstance(v, str)}
    fp, text, low, name = (free_name(docs, x) for x in ("_fp", "_text", "_low", "_name"))
    src = docs.select(*[F.col(f"`{c}`") for c in names], *[v.alias(k) for k, v in own.items()], F.col(f"`{id_col}`").alias(low), F.col(f"`{text_col}`").alias(text))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField(fp, T.BinaryType()), T.StructField(name, T.BinaryType())])

    def scan(batches):
        for batch in batches:
            got = [fingerprint(shingles(t, words), bits) for t in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got, pa.binary()), pa.array([name_of(f) for f in got], pa.binary())], schema.fieldNames())

    marked = stage(src.mapInArrow(scan, schema), "fingerprints")
    nodes = stage(marked.groupBy(F.col(f"`{name}`").alias("name")).agg(F.min(low).alias("low"), F.first(fp).alias("fp")), "nodes")
    found = stage(links(nodes, ring), "links")
    whole = stage(simhash.grouped(nodes.select("name", "low"), found, "name").withColumnRenamed("name", "_n"), "components")
    drop_staged(found)
    drop_staged(nodes)
    out = marked.join(whole, marked[name] == whole["_n"])
    return out.select(*[F.col(f"`{c}`") for c in names], "component_id", *[F.col("root").alias(k) if isinstance(v, str) else F.col(k) for k, v in (extra or {}).items()])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The documents less all but one of each near-duplicate component: the one with the smallest id stays.

    Of a component's rows that share that id, or of one without any id, one stays: the first by hashes of its text and of
    its row. Components that share an id keep one row each. Columns and their order are those of docs. Which rows stay is
    found from their ids and hashes; of the documents themselves only those that may stay are shuffled, once.
    """
    every = [F.col(f"`{c}`") for c in docs.columns]
    names = [free_name(docs, x) for x in ("_id", "_hash", "_row")]
    same, text, row = names
    what = {same: F.col(f"`{id_col}`"), text: F.xxhash64(F.col(f"`{text_col}`")), row: F.xxhash64(*every), "_root": "root"}
    marked = near_duplicates(docs, id_col, text_col, keep=[], extra=what, **settings)
    first = marked.where(F.col(same).eqNullSafe(F.col("component_id"))).groupBy("_root").agg(F.min(F.struct(F.col(text), F.col(row), F.col(same))).alias("k"))
    key = [free_name(docs, f"_k{i}") for i in range(4)]
    stay = stage(first.select(*[F.col(f"k.{c}").alias(k) for k, c in zip(key, names, strict=False)]), "kept")
    own = docs.withColumn(text, what[text]).withColumn(row, what[row])
    out = own.join(stay.hint("merge"), F.col(f"`{id_col}`").eqNullSafe(F.col(key[0])) & (F.col(text) == F.col(key[1])) & (F.col(row) == F.col(key[2])))
    # Rows alike in everything are one row of stay.
    alike = Window.partitionBy(F.col(f"`{id_col}`"), text, row).orderBy(F.lit(0))
    return out.withColumn(key[3], F.row_number().over(alike)).where(F.col(key[3]) == 1).select(*every)
