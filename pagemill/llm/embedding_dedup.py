"""Embedding near-duplicates by spherical-cap filters: structured random product codes, list-decoded."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import components, drop_staged, guarded, partitions, stage, without
from pagemill.llm.simhash import cells

OUT = ["n_links", "component_id", "kept"]
#: The share of pairs exactly at the least cosine that shall have a filter in common, whatever the number of vectors; and the random pairs it is measured on.
RECALL, TRIED = 0.98, 1000
#: Filters a random vector exceeds on average, to begin with; as many more are taken as RECALL needs.
LISTED = 12
#: Vectors of one bucket that are compared in one go; larger buckets are cut into blocks, each pair of blocks by itself.
BLOCK = 2048
_IDS = "a_hi long, a_lo long, b_hi long, b_lo long, links long"


class Caps:
    """Filter directions: after a random rotation, a code word of each half's codebook, side by side.

    The codebooks grow with the square root of the number of vectors and of filters a vector is in, so that buckets stay
    as large as they are. A vector is in all filters whose direction it exceeds by `height`, which `listed` are on
    average, and in half as many, its best ones, in any case. Larger codebooks' filters are narrower, so that a pair
    needs more of them: listed, if not given, is the smallest number tried that finds RECALL of random pairs at cosine `least`.
    """

    def __init__(self, dim: int, rows: int, least: float = 0.95, listed: int | None = None, seed: int = 11):
        self._build(dim, rows, listed or LISTED, seed)
        while listed is None and self.recall(least) < RECALL and self.listed < self.words**2:
            self._build(dim, rows, self.listed * 5 // 4, seed)

    def _build(self, dim: int, rows: int, listed: int, seed: int) -> None:
        rng = np.random.default_rng([seed, dim])
        self.dim, self.listed, self.best = max(16, dim), listed, listed // 2  # short vectors lie in more dimensions, as halves of few have few directions
        self.words = int(max(8, np.ceil(np.sqrt(rows * listed / (4 * LISTED)))))
        self.turn = np.linalg.qr(rng.standard_normal((self.dim, self.dim)))[0][:dim]
        cut = self.dim // 2
        self.books = []
        for size in (cut, self.dim - cut):
            book = rng.standard_normal((self.words, size))
            self.books.append(book / np.linalg.norm(book, axis=1, keepdims=True) / np.sqrt(2))
        self.cut = cut
        self.height = NormalDist().inv_cdf(1 - min(0.5, listed / self.words**2)) / np.sqrt(self.dim)

    def recall(self, cosine: float, pairs: int = TRIED, seed: int = 5) -> float:
        """The share of random pairs of unit vectors at this cosine that have a filter in common."""
        dim = len(self.turn)
        if dim < 2:  # all of one direction are equal
            return 1.0
        rng = np.random.default_rng(seed)
        a, b = rng.standard_normal((2, pairs, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        b = cosine * a + np.sqrt(max(0.0, 1 - cosine**2)) * b
        found = 0
        for at in range(0, pairs, 250):
            found += sum(len(np.intersect1d(p, q, assume_unique=True)) > 0 for p, q in zip(self.decode(a[at : at + 250]), self.decode(b[at : at + 250]), strict=True))
        return found / pairs

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """The filters of each unit vector, ascending."""
        y = x @ self.turn
        left, right = y[:, : self.cut] @ self.books[0].T, y[:, self.cut :] @ self.books[1].T
        by = [np.argsort(-s, axis=1, kind="stable") for s in (left, right)]
        top = [np.take_along_axis(s, o, axis=1) for s, o in zip((left, right), by, strict=True)]
        out = []
        for i in range(len(x)):
            # Rows of the sorted grid of sums while their best sum exceeds; in each, columns as far as they exceed.
            a = max(self.best, int(np.searchsorted(-top[0][i], -(self.height - top[1][i, 0]), "right")))
            b = max(self.best, int(np.searchsorted(-top[1][i], -(self.height - top[0][i, 0]), "right")))
            sums = top[0][i, :a, None] + top[1][i, None, :b]
            least = np.partition(sums.ravel(), -self.best)[-self.best] if sums.size > self.best else -np.inf
            k, m = np.nonzero(sums >= min(self.height, least))
            out.append(np.sort(by[0][i, k].astype(np.int64) * self.words + by[1][i, m]))
        return out


def _slim(raw: bytes) -> bytes:
    """8-byte components as 4-byte ones, if these are equal."""
    x = np.frombuffer(raw, "<f8")
    with np.errstate(over="ignore"):
        small = x.astype("<f4")
    return small.tobytes() if (small == x).all() else raw


def _unit(raw: list[bytes], dim: int | None = None) -> np.ndarray:
    """Unit vectors of components of 8 bytes, or, given how many there are, of 8 or 4."""
    x = np.stack([np.frombuffer(b, "<f4" if dim and len(b) == 4 * dim else "<f8").astype("<f8") for b in raw])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _forest(n: int, i: np.ndarray, j: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
    """Adds pairs to the components in root; returns the pairs that joined two."""
    kept = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        if root[a] != root[b]:
            kept.append((a, b))
            root[root == root[b]] = root[a]
    return kept


def _bucket(diagonal: bool, own: np.ndarray, size: np.ndarray, x: np.ndarray, filters: list[np.ndarray], least: float):
    """Linked weight of each vector of a bucket, and links that connect what is linked.

    filters: each vector's filters before this one. A pair that several buckets hold is counted in the one of its smallest
    common filter; of the cells of a cut bucket, in the one of its two blocks.
    """
    n = len(size)
    weight, edges, root = np.zeros(n, np.int64), [], np.arange(n)
    wide = max(1, *map(len, filters))
    lists = np.full((n, wide), -1, np.int64)
    for k, f in enumerate(filters):
        lists[k, : len(f)] = f
    for at in range(0, n, 256):
        close = x[at : at + 256] @ x.T >= least
        close &= np.arange(n) > np.arange(at, min(at + 256, n))[:, None]
        if not diagonal:
            close &= own[at : at + 256, None] != own
        i, j = np.nonzero(close)
        i += at
        for part in np.array_split(np.arange(len(i)), len(i) * wide**2 // 50_000_000 + 1):
            a, b = lists[i[part]], lists[j[part]]
            earlier = ((a[:, :, None] == b[:, None, :]) & (a >= 0)[:, :, None]).any(axis=(1, 2))
            p, q = i[part][~earlier], j[part][~earlier]
            np.add.at(weight, p, size[q])
            np.add.at(weight, q, size[p])
            joins = root[p] != root[q]
            edges += _forest(n, p[joins], q[joins], root)
    return weight, edges


def _links(batches, least: float):
    held: pa.Table | None = None

    def whole(t: pa.Table):
        key, cell = t["key"].to_numpy(), t["cell"].to_numpy()
        hi, lo, own, size, dim = (t[c].to_numpy() for c in ("hi", "lo", "own", "n", "dim"))
        cuts = np.nonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1]) | (dim[1:] != dim[:-1]))[0] + 1
        raw, lists = t["vec"], t["filters"]
        out: list[tuple] = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
            if b - a < 2:
                continue
            x = _unit(raw.slice(a, b - a).to_pylist(), int(dim[a]))
            f = [np.frombuffer(r, "<i8") for r in lists.slice(a, b - a).to_pylist()]
            c = int(cell[a])
            weight, edges = _bucket(c >> 31 == c & (1 << 31) - 1, own[a:b], size[a:b], x, f, least)
            out += [(hi[a + k], lo[a + k], None, None, weight[k]) for k in np.nonzero(weight)[0]]
            out += [(hi[a + i], lo[a + i], hi[a + j], lo[a + j], 0) for i, j in edges]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(5)], ["a_hi", "a_lo", "b_hi", "b_lo", "links"])

    for batch in batches:
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        key, cell, dim = held["key"].to_numpy(), held["cell"].to_numpy(), held["dim"].to_numpy()
        ends = np.nonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1]) | (dim[1:] != dim[:-1]))[0]
        if len(ends):
            yield whole(held.slice(0, int(ends[-1]) + 1))
            held = held.slice(int(ends[-1]) + 1).combine_chunks()
    if held is not None and held.num_rows:
        yield whole(held)


@guarded("_id", "_hi", "_lo", "_v", "hi", "lo", "r_hi", "r_lo", "a_hi", "a_lo", "low", "n", "links", "found")
def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, keep: list[str] | None = None) -> DataFrame:
    """Adds n_links, component_id and kept to each vector: links are pairs of cosine >= `least`, in double precision.

    Equal vectors are one node with a weight, so that copies make no pairs, and link with each other. Other pairs are
    found where both vectors exceed a filter (see Caps: RECALL of the pairs exactly at `least`, more of closer ones, at
    any number of vectors) and verified by their cosine; none below `least` links. n_links counts the other vectors linked directly, component_id is the
    smallest id reachable, kept says whether a vector is that one.

    Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing, nor do vectors of
    different lengths with each other. A null id counts as a vector but is no component id beside others. Repeated rows
    are equal vectors. An empty table gives no rows. Input columns named like an output column are replaced. keep: the
    input columns to return (all, if None).
    """
    src = without(vectors, OUT)
    names = [c for c in src.columns if keep is None or c in keep]
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda c: F.coalesce((c == c) & (F.abs(c) < float("inf")), F.lit(False))) & F.exists(v, lambda c: c != 0)
    ok = F.coalesce(fine, F.lit(False))
    rows = src.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{id_col}`").alias("_id"),
                      F.when(ok, F.xxhash64(v)).alias("_hi"), F.when(ok, F.xxhash64(F.lit(1), v)).alias("_lo"), F.when(ok, v).alias("_v"))
    nodes = stage(rows.where("_hi is not null").groupBy(F.col("_hi").alias("hi"), F.col("_lo").alias("lo")).agg(F.min("_id").alias("low"), F.count(F.lit(1)).alias("n"), F.any_value("_v").alias("v")), "vectors")
    many = nodes.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["dim"]: r["n"] for r in many.collect()}  # one row for each vector length
    listed = {dim: Caps(dim, n, least).listed for dim, n in sizes.items()}

    def list_decode(batches):
        caps: dict[int, Caps] = {}
        for batch in batches:
            vec = [np.array(x, "<f8").tobytes() for x in batch.column("v").to_pylist()]
            dims = np.array([len(r) // 8 for r in vec])
            for dim in np.unique(dims).tolist():
                at = np.nonzero(dims == dim)[0]
                cap = caps.setdefault(dim, Caps(dim, sizes[dim], least, listed[dim]))
                for part in np.array_split(at, len(at) // 1024 + 1):
                    if not len(part):
                        continue
                    lists = cap.decode(_unit([vec[i] for i in part]))
                    rep = np.repeat(part, [len(f) for f in lists])
                    # A row needs the filters before its own alone, and vectors go in 4 bytes a component where nothing is lost.
                    before = [f[:k].tobytes() for f in lists for k in range(len(f))]
                    slim = {i: _slim(vec[i]) for i in part.tolist()}
                    took = batch.take(pa.array(rep))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists)), pa.array(np.full(len(rep), dim, np.int32)), took.column("hi"), took.column("lo"), took.column("n"), pa.array([slim[i] for i in rep.tolist()], pa.binary()), pa.array(before, pa.binary())], ["key", "dim", "hi", "lo", "n", "vec", "filters"])

    decoded = nodes.select("hi", "lo", "n", "v").mapInArrow(list_decode, "key long, dim int, hi long, lo long, n long, vec binary, filters binary")
    decoded = cells(decoded, "key", BLOCK, "hi").repartition(partitions(vectors.sparkSession), "key", "cell").sortWithinPartitions("key", "cell", "dim", "hi", "lo")
    links = stage(decoded.mapInArrow(lambda batches: _links(batches, least), _IDS), "cosines")
    # Nodes are ordered by their smallest id, so that a component's root has the component's id, and no table of
    # components has to be joined back to all of a large one's members.
    key = nodes.select("hi", "lo", F.struct(F.col("low").isNull().alias("no"), "low", "hi", "lo").alias("k"))
    pairs = links.where("b_hi is not null")
    for side in "ab":
        k = key.select(F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), F.col("k").alias(side))
        pairs = pairs.join(k, (F.col(f"{side}_hi") == k["_hi"]) & (F.col(f"{side}_lo") == k["_lo"])).drop("_hi", "_lo")
    roots = components(pairs.select("a", "b")).select(F.col("node.hi").alias("r_hi"), F.col("node.lo").alias("r_lo"), F.col("root.low").alias("component_id"), F.lit(True).alias("found"))
    direct = links.where("b_hi is null").groupBy("a_hi", "a_lo").agg(F.sum("links").alias("links"))
    node = nodes.select("hi", "lo", "low", "n")
    node = node.join(direct, (node["hi"] == direct["a_hi"]) & (node["lo"] == direct["a_lo"]), "left").join(roots, (F.col("hi") == F.col("r_hi")) & (F.col("lo") == F.col("r_lo")), "left")
    component = F.when(F.col("found"), F.col("component_id")).otherwise(F.col("low"))
    node = stage(node.select("hi", "lo", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), component.alias("component_id")), "components")
    drop_staged(links)
    out = rows.drop("_v").join(node, (F.col("_hi") == node["hi"]) & (F.col("_lo") == node["lo"]), "left")
    component = F.when(F.col("_hi").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return out.select(*[F.col(f"`{c}`") for c in names], F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), keep=["vec_id"])
