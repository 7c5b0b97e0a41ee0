"""Clashing names, very long texts, labelled URLs, widely held values, bounded samples: what the other tests leave out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import common, decontaminate, embedding_dedup, line_dedup, mixing, quality, secrets, similar, simhash, token_counts, url_filter
from tests.llm import brute

INNER = ["_t", "_id", "_Key", "_d", "d2", "_text", "_owner", "_u", "_parts", "_hi", "_n", "low", "N", "links", "_fp", "found", "_spans"]


def words(rng, n, size=3000):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def plain_columns(spark, rows, names):
    """rows, and the same rows with a column named like each of the operators' own."""
    plain = spark.createDataFrame(rows, names)
    return plain, plain.select("*", *[F.lit(k).alias(c) for k, c in enumerate(INNER)])


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(21)
    rows = [(i, words(rng, 60) + f" token=abcdefghijkl{i:04}", f"https://h{i % 3}.example.org/a/b{i}", rng.choice(["a", None])) for i in range(12)]
    return [*rows, (12, rows[0][1], rows[0][2], "a"), (13, None, None, None)]


NAMES = "doc_id long, text string, url string, source string"


@pytest.mark.parametrize("name", ["decontaminate", "lines", "quality", "secrets", "urls", "tokens", "simhash", "similar", "mix", "vectors"])
def test_clashing_names(spark, texts, name):
    plain, odd = plain_columns(spark, texts, NAMES)
    items = spark.createDataFrame([(1, " ".join(texts[2][1].split()[:20]))], "item_id long, text string")
    model = quality.Model(np.arange(quality.BUCKETS, dtype=np.float32) / quality.BUCKETS, 0.1)
    run = {
        "decontaminate": lambda d: decontaminate.decontaminate(d, items), "lines": line_dedup.dedup_lines, "quality": lambda d: quality.classify(d, model),
        "secrets": lambda d: secrets.find_secrets(d, keep=d.columns), "urls": url_filter.filter_urls, "tokens": lambda d: token_counts.count_tokens(d, rule="last"),
        "simhash": simhash.near_duplicates, "similar": similar.near_duplicates, "mix": mixing.mix,
        "vectors": lambda d: embedding_dedup.near_vectors(d.withColumn("v", F.array(F.length("text") * 1.0, F.lit(2.0), F.lit(3.0))), "doc_id", "v"),
    }[name]
    want, got = run(plain), run(odd)
    taken = {c.lower() for c in want.columns}
    assert set(got.columns) == {*want.columns, *(c for c in INNER if c.lower() not in taken)}
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert all(tuple(r) == tuple(k for k, c in enumerate(INNER) if c in got.columns) for r in got.select(*[c for c in INNER if c in got.columns]).collect())


def test_a_column_of_that_name_may_be_the_text(spark, texts):
    d = spark.createDataFrame([(r[0], r[1]) for r in texts], "_id long, _t string")
    got = simhash.near_duplicates(d, "_id", "_t", keep=["_id"])
    assert got.columns == ["_id", "fingerprint", "component_id"]
    assert {r["_id"]: r.fingerprint for r in got.collect()} == {r[0]: f"{brute.simhash(r[1]):016x}" for r in texts}


def test_very_long_texts(spark):
    """Texts of megabytes: one word, words without a line's end, lines without number."""
    rng = random.Random(5)
    item, run = words(rng, 30), "\n".join(words(rng, 10) for _ in range(8))
    long = words(rng, 300_000)
    rows = [(1, "x" * 3_000_000), (2, f"{long} {item} password=abcdefghijklmnop {long}"), (3, "\n".join(f"{i} line" for i in range(100_000)) + "\n" + run), (4, f"short\n{run}\nend"), (5, f"{long} {item} password=abcdefghijklmnop {long} more")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.decontaminate(d, items, keep=["doc_id"]).collect()} == {1: (1, 0), 2: (600_032, 30), 3: (200_080, 0), 4: (82, 0), 5: (600_033, 30)}
    lines = {r.doc_id: r.removed for r in line_dedup.dedup_lines(d, keep=["doc_id"]).collect()}
    assert lines == {1: [], 2: [], 3: [], 4: list(range(1, 9)), 5: []}
    at = rows[1][1].index("password")
    found = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == 0] for r in secrets.find_secrets(d.withColumn("source", F.lit("s"))).collect()}
    assert found[2] == found[5] == [(at, at + len("password=abcdefghijklmnop"))] and found[1] == []
    near = {r.doc_id: r.component_id for r in simhash.near_duplicates(d, keep=["doc_id"]).collect()}
    assert near == {1: 1, 2: 2, 3: 3, 4: 4, 5: 2}
    assert {r.doc_id: r.component_id for r in similar.near_duplicates(d, keep=["doc_id"]).collect()} == near


def test_parts_of_long_texts():
    rng = random.Random(6)
    for text in (words(rng, 500_000), "é" * 1_500_000, "", "a", " " * 2_500_000):
        parts = [bytes(p) for p in quality.parts(text.encode())]
        assert b"".join(parts) == text.encode() and all(len(p) <= quality.PART for p in parts)
        assert all(p.decode() is not None for p in parts) and (" " not in text or all(p[-1:] == b" " for p in parts[:-1]))


def test_a_sample_bounded_by_bytes(spark):
    rng = random.Random(7)
    d = spark.createDataFrame([(i, words(rng, 50) if i % 2 else "!!! " * 50) for i in range(200)], "doc_id long, text string")
    y = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    whole, less, one = (quality.fit(d, y, sample_bytes=n) for n in (1 << 27, 60_000, 1))
    assert not (whole.weights == less.weights).all() and less.scores([b"w1 w2 w3"])[0] > less.scores([b"!!! !!!"])[0]
    assert (one.weights == 0).all()  # one document has one class


def test_training_is_two_layers_gradient_descent():
    """One step on one document against the plain gradient of cross-entropy through mean embeddings and softmax."""
    rng = np.random.default_rng(7)
    emb, out = rng.uniform(-1 / quality.DIM, 1 / quality.DIM, (quality.BUCKETS, quality.DIM)), np.zeros((quality.DIM, 2))
    bags = [(np.array([3, 9]), np.array([2, 1])), (np.array([4, 9]), np.array([1, 5]))]
    labels, bias, steps = np.array([1, 0]), np.zeros(2), 4
    for epoch in range(2):
        for k, d in enumerate(rng.permutation(2)):
            step = 0.5 * (1 - (epoch * 2 + k) / steps)
            ids, c = bags[d]
            share = np.zeros(quality.BUCKETS)
            share[ids] = c / (c.sum() + quality.FEW)
            hidden = share @ emb
            p = np.exp(hidden @ out + bias) / np.exp(hidden @ out + bias).sum()
            error = p - np.eye(2)[labels[d]]
            d_emb, d_out = np.outer(share, out @ error), np.outer(hidden, error)
            emb -= step / (share @ share) * d_emb
            out -= step * d_out
            bias -= 0.1 * step * error
    want = emb @ (out[:, 1] - out[:, 0])
    got = quality.train(bags, labels, epochs=2)
    assert np.allclose(got.weights, want, atol=1e-6) and np.isclose(got.bias, bias[1] - bias[0])


def test_labelled_urls(spark):
    """Rules mined from labels of one's own, against all frequent token sets by brute force."""
    rng = random.Random(8)
    urls = [f"https://{rng.choice(['a', 'spam', 'c'])}.{rng.choice(['x', 'y'])}.example/{rng.choice(['p', 'q'])}/{rng.choice(['1', '2', '3'])}?{rng.choice(['id', 'z'])}=1" for _ in range(400)]
    label = lambda u: "block" if "spam." in u or "/q/3" in u else "allow"
    known = [(u, label(u) if rng.random() < 0.97 else None) for u in urls]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(900, None, None), (901, "nothing", None), (902, "https://other.test/", None)], "page_id long, url string, Verdict string")
    labelled = spark.createDataFrame(known, "url string, label string")
    out = {r.page_id: r for r in url_filter.filter_urls(pages, labelled=labelled, rules=(), support=0.05, confidence=0.9).collect()}
    sets = [frozenset(url_filter.tokens_of(u)) for u in urls]
    rules = []
    for verdict in ("allow", "block"):
        for items in {frozenset(c) for s in set(sets) for c in [*([t] for t in s), *([t, v] for t in s for v in s if t < v)]}:
            rows = [y for s, (_, y) in zip(sets, known, strict=True) if items <= s]
            hits = sum(y == verdict for y in rows)
            if hits >= 0.05 * len(urls) and hits / len(rows) >= 0.9:
                rules.append((items, verdict))
    for i, s in enumerate(sets):
        fits = {v for items, v in rules if items <= s}
        assert out[i].verdict in fits if fits else out[i].verdict == "allow"
    assert sum(out[i].verdict == label(u) for i, u in enumerate(urls)) > 0.97 * len(urls)
    assert out[900].verdict == out[901].verdict == out[902].verdict == "allow" and out[900].host == ""


def test_a_value_of_many_repositories_is_an_example(spark):
    """One owner's value in many repositories is copied about; in few it may be live."""
    few, many, own = "Aa1Bb2Cc3Dd4Ee5Ff6Gg7", "Zz9Yy8Xx7Ww6Vv5Uu4Tt3", "password=onlyhereABCDEF"
    rows = [(i, f"{few if i < secrets.WIDE - 1 else ''} {many} {own if i == 0 else ''}", "one") for i in range(secrets.WIDE)] + [(50, f"{own}x", "two"), (None, "?" + own, "one"), (51, None, None)]
    out = {r.doc_id: r.spans for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [(s.verdict, s.n_owners, s.n_repos) for s in out[1]] == [("live", 1, secrets.WIDE - 1)]
    assert [s.verdict for s in out[0]] == ["live", "live"] and out[secrets.WIDE - 1] == []
    assert len(out[None]) == 1 and out[51] == []
    by_repo = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("repo", F.lit("r")), repo_col="repo")
    assert sum(s.n_repos == 1 and s.verdict == "live" for r in by_repo.collect() for s in r.spans if s.kind == 3) == 2 * secrets.WIDE - 1


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda key: None)

        class sparkContext:
            master, applicationId = "spark://somewhere", "x"

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(Session)
