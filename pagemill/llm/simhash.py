"""SimHash near-duplicates, with candidates from pigeonring filtering."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import components, drop_staged, free_name, guarded, partitions, stage, without

OUT = ["fingerprint", "component_id"]
BITS = 64
#: Fingerprints of one bucket that are compared in one go; larger buckets are cut into blocks, each pair of blocks by itself.
BLOCK = 4096
#: Larger buckets whose sizes (16 bytes each) may be broadcast.
LISTED_BUCKETS = 100_000


def fingerprint(text: bytes | None, words: int = 4, seed: int = 42) -> int:
    """The unsigned SimHash of a UTF-8 text: a bit is 1 if it is set in over half the shingles' XXH64; 0 without words."""
    parts = text.lower().split() if text else []  # bytes: A-Z only, and exactly \x20 and \x09-\x0D
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    digest = xxhash.xxh64_intdigest
    ones, step = np.zeros(BITS, np.int64), 1 << 16
    for at in range(0, n, step):
        spans = zip(starts[at : min(at + step, n)].tolist(), ends[at + min(words, len(parts)) - 1 :][: min(step, n - at)].tolist(), strict=True)
        h = np.array([digest(joined[s:e], seed) for s, e in spans], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


class Ring:
    """A fingerprint cut into a ring of segments, and the budgets that chains of them must keep.

    If two fingerprints differ in at most `most` bits, some segment starts a chain all of whose beginnings keep the
    budget: the first j segments from there differ in at most floor(j * most / segments) bits, for every j. Buckets are
    made of the first `lead` segments of a chain: one side is stored as it is, the other under every variant that the
    budgets allow. More lead segments make buckets smaller and variants more; either way no pair is lost.
    """

    def __init__(self, most: int, segments: int, lead: int):
        self.most, self.n, self.lead = most, segments, lead
        cuts = [BITS * i // segments for i in range(segments + 1)]
        self.segments = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
        self.budget = [j * most // segments for j in range(segments + 1)]
        self.chains = []  # by start, the masks of its first 1, 2, ... segments
        for s in range(segments):
            mask, chain = 0, []
            for j in range(segments):
                mask |= self.segments[(s + j) % segments]
                chain.append(mask)
            self.chains.append(np.array(chain, np.uint64))
        self.flips = [self._flips(s) for s in range(segments)]

    def _flips(self, start: int) -> np.ndarray:
        """The differences within the lead segments that keep every budget."""
        bits = [b for b in range(BITS) if int(self.chains[start][self.lead - 1]) >> b & 1]
        out = []
        for k in range(self.budget[self.lead] + 1):
            for on in combinations(bits, k):
                flip = sum(1 << b for b in on)
                if all((flip & int(self.chains[start][j])).bit_count() <= self.budget[j + 1] for j in range(self.lead)):
                    out.append(flip)
        return np.array(out, np.uint64)

    def rows(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each fingerprint and start: its bucket's key, the start, and whether it is the stored side (else a variant)."""
        keys, at, stored = [], [], []
        for s in range(self.n):
            lead = fps & self.chains[s][self.lead - 1]
            salt = np.uint64((s + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            for flip in self.flips[s]:
                keys.append((lead ^ flip) ^ salt)
                at.append(np.full(len(fps), s, np.int8))
                stored.append(np.full(len(fps), flip == 0))
        return np.concatenate(keys), np.concatenate(at), np.concatenate(stored)

    def linked(self, a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which pairs keep the budgets along the chain from start and differ in at most `most` bits."""
        diff = a ^ b
        left = np.arange(len(diff))
        chains = np.stack(self.chains)
        for j in range(self.n - 1):  # the chain, segment by segment, on what is left; the last is the whole ring
            if self.lead > 1 or j:
                left = left[np.bitwise_count(diff[left] & chains[start[left], j]) <= self.budget[j + 1]]
        left = left[np.bitwise_count(diff[left]) <= self.most]
        out = np.zeros(len(diff), bool)
        out[left] = True
        return out


def ring_for(rows: int, most: int) -> Ring:
    """Buckets of one segment while these hold a few thousand fingerprints at most; beyond that, of longer chains. All find the same pairs."""
    if rows <= 20_000_000 or most >= 8:
        return Ring(most, most + 1, 1)
    return Ring(most, 2 * most, 3 if rows <= 10_000_000_000 else 4)


def _small(fps, start, stored, group, ring):
    """Pairs within groups of adjacent rows, by distance between the rows."""
    size = np.bincount(group)
    last = np.cumsum(size)[group] - 1
    i = np.arange(len(fps))
    a, b = [], []
    for d in range(1, int(size.max()) if len(size) else 0):
        i = i[i + d <= last[i]]
        j = i + d
        k = np.nonzero((stored[i] | stored[j]) & (fps[i] != fps[j]))[0]
        ok = ring.linked(fps[i[k]], fps[j[k]], start[i[k]])
        a.append(i[k][ok])
        b.append(j[k][ok])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, int), np.empty(0, int))


def forest(n: int, linked) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among n rows; linked(i, j) says which rows of j, all after i, link with row i.

    Rows that are connected already aren't looked at again, so that a large group of copies takes few rounds.
    """
    root, a, b = np.arange(n), [], []
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        j = j[root[j] != root[i]]
        if len(j):
            j = j[linked(i, j)]
        if len(j):
            kin, first = np.unique(root[j], return_index=True)
            a += [i] * len(kin)
            b += j[first].tolist()
            low = min(int(kin[0]), int(root[i]))
            root[np.isin(root, np.append(kin, root[i]))] = low
    return np.array(a, int), np.array(b, int)


def _large(fps, start, stored, ring):
    """A spanning forest of the links within one large group: no more links than rows leave it."""
    return forest(len(fps), lambda i, j: ring.linked(np.broadcast_to(fps[i], len(j)), fps[j], np.broadcast_to(start[i], len(j))) & (stored[i] | stored[j]))


def whole_buckets(batches):
    """Tables of rows sorted by (key, cell), cut where a bucket ends, and each row's bucket number in them: a bucket's rows follow each other, across batches too."""
    held: pa.Table | None = None

    def cuts(t: pa.Table) -> np.ndarray:
        key, cell = t["key"].to_numpy(), t["cell"].to_numpy()
        return (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])

    def numbered(t: pa.Table):
        return t, np.concatenate([[0], np.cumsum(cuts(t))])

    for batch in batches:
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        ends = np.nonzero(cuts(held))[0]
        if len(ends):  # all but the last bucket are whole
            yield numbered(held.slice(0, int(ends[-1]) + 1).combine_chunks())
            held = held.slice(int(ends[-1]) + 1).combine_chunks()
    if held is not None and held.num_rows:
        yield numbered(held.combine_chunks())


def bucket_links(batches, ring: Ring):
    """Links within buckets of rows sorted by (key, cell)."""
    for t, group in whole_buckets(batches):
        fps, start, stored = t["fp"].to_numpy().view(np.uint64), t["start"].to_numpy().astype(np.int64), t["stored"].to_numpy()
        size = np.bincount(group)
        pairs = []
        few = np.nonzero((size[group] > 1) & (size[group] <= 64))[0]
        if len(few):
            i, j = _small(fps[few], start[few], stored[few], np.unique(group[few], return_inverse=True)[1], ring)
            pairs.append((fps[few][i], fps[few][j]))
        first = np.concatenate([[0], np.cumsum(size)])
        for g in np.nonzero(size > 64)[0]:
            s = slice(first[g], first[g + 1])
            i, j = _large(fps[s], start[s], stored[s], ring)
            pairs.append((fps[s][i], fps[s][j]))
        a = np.concatenate([x for x, _ in pairs]) if pairs else np.empty(0, np.uint64)
        b = np.concatenate([x for _, x in pairs]) if pairs else np.empty(0, np.uint64)
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.empty((0, 2), np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].view(np.int64)), pa.array(both[:, 1].view(np.int64))], ["a", "b"])


def cells(df: DataFrame, key: str, block: int, by: str) -> DataFrame:
    """Adds cell: 0 for a bucket of up to `block` rows; rows of a larger one are dealt to blocks (own), and each pair of blocks is a cell.

    Two rows of a bucket meet in at least one cell, and no cell has much over two blocks. The table of larger buckets is
    counted: up to LISTED_BUCKETS of them are broadcast, more are merged.
    """
    big = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block).select(F.col(key).alias("_k"), F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    big = stage(big, "buckets")
    big = F.broadcast(big) if big.count() <= LISTED_BUCKETS else big.hint("merge")
    df = df.join(big, df[key] == big["_k"], "left").drop("_k")
    own = F.pmod(F.xxhash64(by), F.col("_blocks")).cast("int")
    other = F.explode(F.when(F.col("_blocks").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    df = df.withColumn("_other", other).withColumn("_own", F.coalesce(own, F.lit(-1)))
    cell = F.when(F.col("_blocks").isNull(), F.lit(0).cast("long")).otherwise(F.least("_own", "_other").cast("long") * F.lit(1 << 31) + F.greatest("_own", "_other"))
    return df.withColumn("cell", cell).withColumn("own", F.col("_own")).drop("_blocks", "_other", "_own")


def fingerprint_links(fps: DataFrame, most: int) -> DataFrame:
    """Links (a, b) among the distinct fingerprints (column fp, bigint) at `most` or fewer differing bits, enough to connect them."""
    spark = fps.sparkSession
    ring = ring_for(fps.count(), most)

    def index(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            key, start, stored = ring.rows(fp)
            many = len(key) // max(1, len(fp))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(start), pa.array(stored), pa.array(np.tile(fp.view(np.int64), many))], ["key", "start", "stored", "fp"])

    rows = fps.select("fp").mapInArrow(index, "key long, start byte, stored boolean, fp long")
    rows = cells(rows, "key", BLOCK, "fp").drop("own")
    rows = rows.repartition(partitions(spark), "key", "cell").sortWithinPartitions("key", "cell", "fp", "stored")
    return rows.mapInArrow(lambda batches: bucket_links(batches, ring), "a long, b long")


@guarded("_id", "_t", "_fp")
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42, most: int = 4, keep: list[str] | None = None) -> DataFrame:
    """Adds to each document fingerprint (16 lowercase hex digits) and component_id, the smallest id reachable over links.

    Fingerprints are SimHashes over shingles of `words` words; two link at `most` or fewer differing bits. Equal
    fingerprints are one node, so that copies make no pairs. Links come from pigeonring filtering (see Ring), components
    from links. Null, empty and word-less texts have fingerprint zero and link like any other; a null id is passed over
    as component id unless a component has no other; repeated rows each get their row; an empty table gives no rows.
    Input columns named like an output column are replaced. keep: the input columns to return (all, if None).
    """
    src = docs if id_col in OUT or text_col in OUT else without(docs, OUT)
    names = [c for c in src.columns if (keep is None or c in keep) and c.lower() not in OUT]
    fp = free_name(src, "fp")
    fields = [src.schema[c] for c in names]
    schema = T.StructType([*fields, T.StructField("_id", src.schema[id_col].dataType), T.StructField(fp, T.LongType())])
    src = src.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_t"))

    def scan(batches):
        for batch in batches:
            got = np.array([fingerprint(t, words, seed) for t in batch.column("_t").cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got.view(np.int64))], schema.fieldNames())

    marked = stage(src.mapInArrow(scan, schema), "simhash")
    nodes = stage(marked.groupBy(F.col(fp).alias("fp")).agg(F.min("_id").alias("low")), "nodes")
    links = stage(fingerprint_links(nodes, most), "links")
    whole = stage(grouped(nodes, links, "fp").select(F.col("fp").alias("_fp"), "component_id"), "components")
    drop_staged(links)
    drop_staged(nodes)
    out = marked.join(whole, marked[fp] == whole["_fp"])
    text = F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
    return out.select(*[F.col(f"`{c}`") for c in names], text.alias("fingerprint"), "component_id")


def grouped(nodes: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """(name, component_id, root) of each node (name, low), low being the smallest id of its rows, under links (a, b) of names.

    Nodes are ordered by their smallest id (none: last), so that a component's root has the component's id, and no table
    of components has to be joined back to all of a large one's members. root is the root's name.
    """
    key = nodes.select(name, F.struct(F.col("low").isNull().alias("no"), "low", F.col(name).alias("name")).alias("k"))
    for side in "ab":
        k = key.select(F.col(name).alias("_name"), F.col("k").alias(f"k{side}"))
        links = links.join(k, F.col(side) == k["_name"]).drop("_name")
    roots = components(links.select(F.col("ka").alias("a"), F.col("kb").alias("b"))).select(F.col("node.name").alias("_name"), F.col("root").alias("_root"))
    whole = nodes.join(roots, nodes[name] == roots["_name"], "left")
    found = F.col("_root").isNotNull()
    return whole.select(name, F.when(found, F.col("_root.low")).otherwise(F.col("low")).alias("component_id"), F.when(found, F.col("_root.name")).otherwise(F.col(name)).alias("root"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, keep=["doc_id"]).select("doc_id", "fingerprint", "component_id")
