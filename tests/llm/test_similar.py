"""Near-duplicates at a Jaccard similarity, by wide SimHashes: against plain versions."""

import random
import re

import numpy as np
import pytest

from pagemill.llm import common, similar, simhash
from tests.llm import brute

DOC = "doc_id long, text string, Component_ID string, _name int"


def words(rng, n, size=5000):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def sets(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def edited(rng, text, share):
    """A copy with single words changed, about as many as take the shingles' Jaccard similarity to `share`."""
    w = text.split()
    for _ in range(round(len(w) * (1 - share) / (1 + share) / 5)):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def table():
    rng = random.Random(11)
    texts = []
    for g in range(30):
        base = words(rng, 400)
        texts += [base] + [edited(rng, base, rng.choice([0.5, 0.8, 0.9, 0.95])) for _ in range(4)]
    texts += [words(rng, rng.randrange(1, 300)) for _ in range(100)] + [None, "", " \t ", "a b c", "A  b\tC", "a b c d e f"]
    rows = [(i * 7 % 1009, t, "x", i) for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[7], (None, rows[3][1], None, None)]


def test_shingles_by_the_letter():
    for t in (None, "", "One", "a b c", "A  b\tc d\x0be f", "x y z é É 日本 語", "a " * 50, words(random.Random(1), 3000)):
        assert len(similar.shingles(None if t is None else t.encode())) == len(sets(t))
    assert similar.shingles(b"a B c d e f").tolist() == similar.shingles(b"A b  c\td e F").tolist()
    assert similar.fingerprint(np.empty(0, np.uint64), 384) == bytes(48)


def test_most_is_the_angle_of_the_similarity():
    rng = random.Random(2)
    for share in (0.7, 0.8, 0.9):
        ring, diffs = similar.Wide(share), []
        for _ in range(60):
            a, b, c = ([rng.getrandbits(64) for _ in range(n)] for n in (1000, round(1000 * (1 - share) / (2 * share)), round(1000 * (1 - share) / (2 * share))))
            x, y = (np.frombuffer(similar.fingerprint(np.unique(np.array(a + z, np.uint64)), 384), np.uint8) for z in (b, c))
            diffs.append(int(np.bitwise_count(x ^ y).sum()))
        assert abs(np.mean(diffs) - ring.most) < 4


def test_recall_at_the_bound():
    assert similar.Wide().recall(2000, seed=99) >= 0.95


@pytest.mark.parametrize("few", [16, 2])
def test_links_against_brute_force(spark, monkeypatch, few):
    """No link that isn't one; of those at the bound and nearer nearly all; by pairs or by forests."""
    monkeypatch.setattr(similar, "FEW", few)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    rng, ring = np.random.default_rng(3), similar.Wide()
    fps = [rng.bytes(48) for _ in range(60)]
    for f in fps[:30]:
        for k in (3, 30, 58, 59):
            bits = np.unpackbits(np.frombuffer(f, np.uint8))
            bits[rng.choice(384, k, replace=False)] ^= 1
            fps.append(np.packbits(bits).tobytes())
    names = [similar.name_of(f) for f in fps]
    close = lambda i, j: sum((x ^ y).bit_count() for x, y in zip(fps[i], fps[j], strict=True)) <= ring.most
    nodes = spark.createDataFrame([(bytearray(n), bytearray(f)) for n, f in zip(names, fps, strict=True)], "name binary, fp binary")
    found = similar.links(nodes, ring).collect()
    at = {n: i for i, n in enumerate(names)}
    assert all(close(at[bytes(r.a)], at[bytes(r.b)]) for r in found)
    got = {bytes(r.node): bytes(r.root) for r in common.components(spark.createDataFrame(found, "a binary, b binary")).collect()}
    want = brute.classes(names, close)
    joined = [w for n, w in zip(names, want, strict=True) if want.count(w) > 1]
    assert sum(got.get(n) == w for n, w in zip(names, want, strict=True) if want.count(w) > 1) >= 0.95 * len(joined)
    if few == 16:
        pairs = {(min(bytes(r.a), bytes(r.b)), max(bytes(r.a), bytes(r.b))) for r in found}
        assert len(pairs) <= len(found) <= 1.2 * len(pairs)


def test_near_duplicates(spark):
    rows = table()
    out = similar.near_duplicates(spark.createDataFrame(rows, DOC)).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"doc_id", "text", "_name", "component_id"}
    class_of = {r.text: r.component_id for r in out}
    jaccard = lambda a, b: len(a & b) / max(1, len(a | b))
    texts = list(class_of)
    shingled = [sets(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(shingled[i], shingled[j]) >= 0.85]
    assert len(near) > 80 and sum(class_of[texts[i]] == class_of[texts[j]] for i, j in near) >= 0.97 * len(near)
    assert all(jaccard(shingled[i], shingled[j]) > 0 or not (shingled[i] or shingled[j]) for i in range(len(texts)) for j in range(i) if class_of[texts[i]] == class_of[texts[j]])
    assert class_of[None] == class_of[""] == class_of[" \t "] and class_of["a b c"] == class_of["A  b\tC"]
    kept = similar.keep_one(spark.createDataFrame(rows, DOC)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(class_of.values())) and list(kept[0].asDict()) == ["doc_id", "text", "Component_ID", "_name"]
    empty = spark.createDataFrame(rows, DOC).limit(0)
    assert similar.near_duplicates(empty).count() == 0 and similar.keep_one(empty).count() == 0


def test_keep_one_of_each_component(spark):
    """Unrelated texts of one id both stay; of linked texts without ids, one does; of rows alike, one."""
    rng = random.Random(9)
    one, other, none = (words(rng, 300) for _ in range(3))
    d = spark.createDataFrame([(1, one), (1, other), (1, other), (2, one), (None, none), (None, f"{none} more"), (None, none)], "doc_id long, text string")
    kept = sorted((r.doc_id or 0, r.text) for r in similar.keep_one(d).collect())
    assert len(kept) == 3 and kept[0][1] in (none, f"{none} more") and kept[1:] == sorted([(1, one), (1, other)])


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST_HUB", 5)
    monkeypatch.setattr(common, "HUBS", 20)
    rng = random.Random(4)
    edges = [(1000, i) for i in range(200)] + [(i, i + 300) for i in range(0, 200, 3)] + [(2000 + i, 2001 + i) for i in range(60)] + [(5, 5), (None, 7)] + [(rng.randrange(3000, 3100), rng.randrange(3000, 3100)) for _ in range(90)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges for x in e if x is not None and None not in e and e[0] != e[1]})
    have = {frozenset(e) for e in edges}
    want = brute.classes(nodes, lambda i, j: frozenset((nodes[i], nodes[j])) in have)
    assert got == dict(zip(nodes, want, strict=True))
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
