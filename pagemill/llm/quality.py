"""Quality classifier: averaged embeddings of hashed words and character n-grams under a softmax, trained by numpy SGD."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagemill.llm.common import drop_staged, guarded, stage, without

OUT = ["score", "predicted"]
BUCKETS = 1 << 16
DIM = 8
#: Neutral features that every document is taken to have besides its own, so that a few words alone decide little.
FEW = 8
#: Bytes of a text whose features are in memory at once; grams and pairs across two parts, which are cut at white space, are not features.
PART = 1 << 20
#: The most labelled documents that one model is trained on, and the most bytes of their features; they are the ones with the smallest hash of their id.
SAMPLE, SAMPLE_BYTES = 3000, 1 << 27
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _bucket(h: np.ndarray) -> np.ndarray:
    """16 bits of a 32-bit value."""
    h = h * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    return h * np.uint32(0x85EBCA77) >> np.uint32(16)


def features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, word pairs and n-grams of UTF-8 bytes, and the byte each starts at.

    Words end at ASCII white space. A pair's value is the difference of its words' values, so that a word that repeats
    itself is one and the same feature whichever word it is.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    two = data.astype(np.uint32)
    two[:-1] |= two[1:] << np.uint32(8)
    four = two[:-2] | two[2:] << np.uint32(16)
    out, at = [_bucket(two[:-1]), _bucket(four[:-1] + np.uint32(1))], [np.arange(n - 1), np.arange(max(0, n - 3))]
    gap = _SPACE[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    first = edge[~gap[edge]] if gap[0] else np.concatenate([[0], edge[~gap[edge]]])
    if len(first):
        # A word's value: its bytes, each times a factor by its place in the word, added up.
        start = np.zeros(n, np.int32)
        start[first] = first
        place = (np.arange(n, dtype=np.int32) - np.maximum.accumulate(start)).astype(np.uint32)
        factor = (place + np.uint32(1)) * np.uint32(0x9E3779B1)
        factor ^= factor >> np.uint32(13)
        h = np.add.reduceat(np.where(gap, np.uint32(0), (data + np.uint32(1)) * factor), first, dtype=np.uint32)
        out += [_bucket(h + np.uint32(2)), _bucket((h[1:] - h[:-1]) * np.uint32(3) + np.uint32(5))]
        at += [first, first[1:]]
    return np.concatenate(out), np.concatenate(at)


def parts(text: bytes):
    """A text's bytes in parts of up to PART, each ending with white space; a run without any in so much is cut at a code point."""
    data, a = np.frombuffer(text, np.uint8), 0
    while len(data) - a > PART:
        cut = np.flatnonzero(_SPACE[data[a : a + PART]])
        if not len(cut):
            cut = np.flatnonzero((data[a + 1 : a + PART + 1] & 0xC0) != 0x80)
        b = a + (int(cut[-1]) + 1 if len(cut) else PART)
        yield data[a:b]
        a = b
    yield data[a:]


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A document's distinct buckets and how many features fall into each."""
    counts = np.zeros(BUCKETS, np.int64)
    for part in parts(text):
        counts += np.bincount(features(part)[0], minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    """weights: by bucket, the difference of the two classes' outputs; a document's logit is their mean over its features and FEW neutral ones, plus bias."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        logits = np.full(len(texts), self.bias)
        for i, t in enumerate(texts):
            total, n = 0.0, 0
            for part in parts(t or b""):
                got = features(part)[0]
                total, n = total + float(self.weights[got].sum()), n + len(got)
            logits[i] += total / (n + FEW)
        return 1 / (1 + np.exp(-np.clip(logits, -60, 60)))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> Model:
    """Stochastic gradient descent, a document at a time: embeddings and softmax weights together.

    The hidden vector is the mean of a document's feature embeddings; cross-entropy's gradient goes through the output
    weights into every embedding that was averaged, scaled so that one step moves the mean by as much whatever its length. The rate falls linearly to zero. Without labels of both classes the
    model is the labels' rate alone.
    """
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    out, bias = np.zeros((DIM, 2)), np.zeros(2)
    n = len(bags)
    if n == 0 or labels.min() == labels.max():
        p = (labels.sum() + 1) / (n + 2)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p))))
    shares = [(i, c / (c.sum() + FEW)) for i, c in bags]
    for epoch in range(epochs):
        for k, d in enumerate(rng.permutation(n)):
            step = rate * (1 - (epoch * n + k) / (epochs * n))
            ids, share = shares[d]
            rows = emb[ids]
            hidden = share @ rows
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[d]] -= 1
            back = out @ p
            out -= step * np.outer(hidden, p)
            bias -= 0.1 * step * p
            if len(ids):
                emb[ids] = rows - np.outer(share * (step / (share @ share)), back)
    delta = emb @ (out[:, 1] - out[:, 0])
    return Model(delta.astype(np.float32), float(bias[1] - bias[0]))


def held_out(id_col: Column) -> Column:
    """True for the fifth of the documents whose labels are never learned from."""
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Trains on at most `sample` labelled documents that are not held out.

    Only ids, labels and the size of the documents' features choose the sample: documents go in by a hash of their id
    until their features reach sample_bytes, one at least. A document with several labels has the one most of them say (1 of equals).
    Labels that are null, or whose id or text is null, teach nothing. Executors turn the sample's whole texts into bags
    of buckets, six bytes an entry; the driver gets those alone and trains.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null")
    known = known.where(F.coalesce(~held_out(F.col("id")), F.lit(False))).groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t")).where("t is not null and t <> ''")

    def bags(batches):
        for batch in batches:
            got = [bag(t) for t in batch.column("t").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array([i.astype("<u2").tobytes() for i, _ in got]), pa.array([c.astype("<i4").tobytes() for _, c in got])], ["id", "y", "i", "c"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("y", T.IntegerType()), T.StructField("i", T.BinaryType()), T.StructField("c", T.BinaryType())])
    chosen = texts.join(F.broadcast(known), "id").select("id", "y", "t")  # known has at most `sample` rows
    bagged = stage(chosen.mapInArrow(bags, schema), "bags")
    order = Window.orderBy(F.xxhash64("id"), "id", "y", "size")  # at most `sample` documents' sizes, not their bags
    sizes = bagged.select("id", "y", (F.octet_length("i") + F.octet_length("c")).alias("size"))
    sizes = sizes.withColumn("upto", F.sum("size").over(order)).withColumn("at", F.row_number().over(order))
    last = sizes.where((F.col("upto") <= sample_bytes) | (F.col("at") == 1)).agg(F.max(F.struct(F.xxhash64("id").alias("h"), "id")).alias("k")).first()["k"]
    rows = [] if last is None else bagged.where((F.xxhash64("id") < last["h"]) | ((F.xxhash64("id") == last["h"]) & (F.col("id") <= F.lit(last["id"])))).collect()
    drop_staged(bagged)
    rows.sort(key=lambda r: (str(r.id), r.y, bytes(r.i), bytes(r.c)))
    return train([(np.frombuffer(r.i, "<u2"), np.frombuffer(r.c, "<i4")) for r in rows], np.array([r.y for r in rows], int))


@guarded("_t")
def classify(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """Adds score (0 to 1, of label 1) and predicted (1 if score >= threshold, else 0) from the whole text alone.

    Null and empty texts get the score of the bias. Repeated rows get equal scores; an empty table gives no rows. Input
    columns named like an output column are replaced. keep: the input columns to return (all, if None).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs if text_col in OUT else without(docs, OUT)
    names = [c for c in src.columns if (keep is None or c in keep) and c not in OUT]
    schema = T.StructType([*[src.schema[c] for c in names], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def score(batches):
        for batch in batches:
            s = shared.value.scores(batch.column("_t").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s), pa.array((s >= threshold).astype(np.int32))], schema.fieldNames())

    return src.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").alias("_t")).mapInArrow(score, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs, model, keep=["doc_id"]).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
