"""Decontamination, SimHash and embedding near-duplicates against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm import decontaminate, embedding_dedup, simhash
from tests.llm import brute

DOC = "doc_id long, text string, n_words string, Fingerprint int"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    items = [(i, words(rng, rng.choice([3, 8, 13, 20, 40]))) for i in range(12)] + [(None, words(rng, 20)), (50, None), (51, ""), (3, words(rng, 15))]
    docs = []
    for i in range(60):
        text = words(rng, rng.randrange(0, 200))
        if i % 3 == 0:
            piece = (rng.choice(items)[1] or "").upper()
            text = f"{text} {piece} - {text[:50]} {piece[20:]}"
        docs.append((i, text, "x", i))
    docs += [(60, None, None, 1), (61, "", "", 2), (61, "", "", 2), (62, "é,É " + (items[4][1] or ""), "y", 3), (None, items[5][1], "z", 4), (63, items[0][1], "q", 5)]
    return docs, items


@pytest.mark.parametrize("block", [16_000_000, 300])
def test_decontaminate(spark, corpus, block):
    docs, items = corpus
    out = decontaminate.decontaminate(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string"), block_chars=block).collect()
    assert len(out) == len(docs)
    wanted = {}
    for d, text, *_ in docs:
        wanted.setdefault(d, []).append((text, *brute.windows_in(text, items)))
    hits = 0
    for r in out:
        n, hit, found = next(w[1:] for w in wanted[r.doc_id] if w[0] == r.text)
        assert (r.n_words, r.n_hit, r.item_ids, r.n_items) == (n, hit, found, len(found))
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
        hits += hit > 0
    assert hits > 15 and "Fingerprint" in out[0].asDict()


def test_decontaminate_empty(spark, corpus):
    docs, items = corpus
    d, i = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.decontaminate(d.limit(0), i).count() == 0
    assert decontaminate.decontaminate(d, i.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def near_texts():
    rng = random.Random(5)
    docs = []
    for g in range(6):
        base = words(rng, 300, 5000).split()
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = "changed"
            docs.append(" ".join(copy))
    docs += [words(rng, rng.randrange(1, 60), 5000) for _ in range(40)] + [None, "", "  \n ", "One", "one", "a b c", "A  b\tc"]
    rows = [(i * 7 % 101, t, str(i), i) for i, t in enumerate(docs)]
    return rows + [rows[0], rows[50]]


def test_fingerprint_by_the_letter():
    for t in (None, "", "One", "a b c", "A  b\tc d\x0be", "x y z é É 日本 語", " ".join(map(str, range(500)))):
        assert simhash.fingerprint(None if t is None else t.encode()) == brute.simhash(t)


def test_simhash(spark):
    rows = near_texts()
    out = simhash.near_duplicates(spark.createDataFrame(rows, DOC)).collect()
    fps = [brute.simhash(t) for _, t, *_ in rows]
    want = brute.classes([r[0] for r in rows], lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in out) == sorted((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, want, strict=True))
    assert simhash.near_duplicates(spark.createDataFrame(rows, DOC).limit(0)).count() == 0


def flipped(rng, fp, k):
    for b in rng.sample(range(64), k):
        fp ^= 1 << b
    return fp


@pytest.mark.parametrize(("segments", "lead"), [(5, 1), (8, 3), (8, 4), (4, 1), (3, 2)])
def test_ring_loses_no_pair(segments, lead):
    """Every pair at up to 4 bits shares a bucket, as stored and as variant, and passes the chain check there."""
    rng = random.Random(1)
    ring = simhash.Ring(4, segments, lead)
    for _ in range(60):
        a = rng.getrandbits(64)
        b = flipped(rng, a, rng.randrange(5))
        key, start, stored = ring.rows(np.array([a, b], np.uint64))
        of = np.tile([0, 1], len(key) // 2)
        mine = {(k, s) for k, s, i, y in zip(key.tolist(), start.tolist(), of, stored, strict=True) if i == 0 and y}
        shared = [(k, s) for k, s, i in zip(key.tolist(), start.tolist(), of, strict=True) if i == 1 and (k, s) in mine]
        ok = [ring.linked(np.array([a], np.uint64), np.array([b], np.uint64), np.array([s]))[0] for _, s in shared]
        assert any(ok)


def test_large_bucket_is_cut(spark, monkeypatch):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = {flipped(rng, base, rng.randrange(4)) for _ in range(500)} | {rng.getrandbits(64) for _ in range(200)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    for block in (64, 4096):
        monkeypatch.setattr(simhash, "BLOCK", block)
        links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), 4)
        got = {(r.node, r.root) for r in simhash.components(links).collect()}
        want = brute.classes(signed, lambda i, j: ((signed[i] ^ signed[j]) & (1 << 64) - 1).bit_count() <= 4)
        assert {n: r for n, r in got} == {f: c for f, c in zip(signed, want, strict=True) if want.count(c) > 1}


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 24))
    near = base[:40].repeat(4, axis=0) + 0.12 * rng.standard_normal((160, 24))
    x = [*base.tolist(), *near.tolist(), *base[:20].tolist(), (3 * base[0]).tolist(), (1e-200 * base[1]).tolist()]
    rows = [(i, v, "k") for i, v in enumerate(x)] + [(1000, None, "k"), (1001, [0.0] * 24, "k"), (1002, [float("nan")] * 24, "k"), (1003, [None] * 24, "k"), (1004, [1.0, 2.0], None), (1005, [2.0, 4.0], None), (1006, [], None), (1004, [1.0, 2.0], None)]
    want = brute.cosine_links(x)
    for block in (2048, 16):
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
        out = {}
        for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, kept string")).collect():
            out.setdefault(r.vec_id, r)
        got = np.array([out[i].n_links for i in range(len(x))])
        assert (got <= want.sum(1)).all() and got.sum() >= 0.9 * want.sum()
        assert got.sum() == want.sum()  # at this size nothing is missed
        assert [out[i].component_id for i in range(len(x))] == brute.classes(list(range(len(x))), lambda i, j: want[i, j])
        assert all(out[i].n_links == 0 and out[i].component_id == i and out[i].kept for i in (1000, 1001, 1002, 1003, 1006))
        assert (out[1004].n_links, out[1005].n_links, out[1005].component_id, out[1005].kept) == (2, 2, 1004, False)
    empty = spark.createDataFrame([], T.StructType.fromDDL("vec_id long, embedding array<float>"))
    assert embedding_dedup.near_vectors(empty).count() == 0


@pytest.mark.parametrize("rows", [2_500, 100_000, 1_000_000, 10_000_000, 100_000_000])
def test_caps_recall_does_not_fall_with_size(rows):
    """Pairs exactly at the least cosine, other ones than those the number of filters is chosen by."""
    assert embedding_dedup.Caps(64, rows).recall(0.95, 1500, seed=77) >= 0.96
