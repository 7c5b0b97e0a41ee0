"""The registered queries and the pipeline: against their SQL, against plain versions, and over a table with nulls and clashing names."""

import math
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from pagemill.llm import quality, registry, similar, tokens
from tests import oracle
from tests.llm import brute
from tests.llm.test_texts import library, plain_mix


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, name):
    oracle.check(spark, registry.QUERIES[name], registry.ORACLES[name])


def table(name):
    return oracle.connect().execute(f"SELECT * FROM {name}").df()


def test_op3_contract(spark):
    out = registry.QUERIES["op3_quality"](spark, oracle.SF).toPandas()
    docs = table("documents")
    assert sorted(out.doc_id) == sorted(docs.doc_id)
    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.3)).all()


def test_op3_accuracy_on_held_out(spark):
    sf = oracle.SF.replace("0.001", "0.01")
    out = registry.QUERIES["op3_quality"](spark, sf).toPandas()
    y = oracle.connect(sf).execute("SELECT * FROM labels").df().merge(out, on="doc_id")
    y = y[y.held_out]
    assert (y.predicted == y.quality).mean() > 0.95


def test_op6_contract(spark):
    out = registry.QUERIES["op6_embedding_dedup"](spark, oracle.SF).toPandas().sort_values("vec_id")
    v = table("embeddings").sort_values("vec_id")
    links = brute.cosine_links(np.stack([np.asarray(x, float) for x in v.embedding]))
    assert (out.n_links.to_numpy() <= links.sum(1)).all() and out.n_links.sum() >= 0.9 * links.sum()
    ids = v.vec_id.tolist()
    assert out.component_id.tolist() == brute.classes(ids, lambda i, j: links[i, j]) and (out.kept == (out.vec_id == out.component_id)).all()


def test_op8_contract(spark):
    out = registry.QUERIES["op8_token_output"](spark, oracle.SF).toPandas().sort_values("doc_id")
    docs = table("documents").sort_values("doc_id")
    ids = [[*e.ids, tokens.END_ID] for e in library(docs.text.fillna("").tolist())]
    assert out.n_tokens.tolist() == [len(x) for x in ids]
    assert out.start.tolist() == [0, *np.cumsum([len(x) for x in ids]).tolist()][:-1]
    assert out.ids_crc32.tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]


def test_op10_contract(spark):
    out = registry.QUERIES["op10_simhash"](spark, oracle.SF).toPandas().sort_values("doc_id")
    docs = table("documents").sort_values("doc_id")
    fps = [brute.simhash(t) for t in docs.text]
    assert out.fingerprint.tolist() == [f"{f:016x}" for f in fps]
    assert out.component_id.tolist() == brute.classes(docs.doc_id.tolist(), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)


def test_op2_deletes_only_what_repeats(spark):
    out = registry.QUERIES["op2_line_dedup"](spark, oracle.SF).toPandas().set_index("doc_id")
    docs = [(r.doc_id, r.text) for r in table("documents").sort_values("doc_id").itertuples()]
    most = brute.repeated(docs)
    for d, t in docs:
        gone = {int(x) for x in out.removed[d].split(",") if x}
        assert gone <= most[d] and out.n_removed[d] == len(gone) and out.n_lines[d] == t.count("\n") + 1


def test_op9_contract(spark):
    out = registry.QUERIES["op9_url_filter"](spark, oracle.SF).toPandas()
    rules = {("net", "/"): "block", ("example.net", "/en/"): "allow", ("example.com", "/de/"): "block", ("org", "/fr/"): "allow"}
    urls = table("pages").set_index("page_id").url
    for r in out.itertuples():
        _, mark, rest = urls[r.page_id].partition("://")
        host, path = (re.match("[^/?#]*", rest)[0].lower(), re.match("[^/?#]*([^?#]*)", rest)[1]) if mark else ("", "")
        fits = [h + p for h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits, key=len, default=None)
        assert (r.host, r.path, r.rule) == (host, path, want)
        assert r.verdict == next((v for (h, p), v in rules.items() if h + p == want), r.verdict) and r.verdict in ("allow", "block")


def stages(spark, sf_dir):
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, f in corpus_pipeline.STAGES:
        seen.append(docs.toPandas().sort_values(["doc_id"]).reset_index(drop=True))
        docs = f(spark, docs, sf_dir)
    return seen, docs.toPandas()


def test_pipeline_stage_by_stage(spark):
    seen, out = stages(spark, oracle.SF)
    assert all(list(s.columns) == list(seen[0].columns) for s in seen)
    docs = spark.read.parquet(f"{oracle.SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{oracle.SF}/labels.parquet"))
    good = model.scores([t.encode() for t in seen[0].text]) >= 0.3
    assert seen[1].doc_id.tolist() == seen[0].doc_id[good].tolist() and not good.all()
    ring = similar.Wide()
    fps = [np.frombuffer(similar.fingerprint(similar.shingles(t.encode()), ring.bits), np.uint8) for t in seen[1].text]
    low = brute.classes(seen[1].doc_id.tolist(), lambda i, j: np.bitwise_count(fps[i] ^ fps[j]).sum() <= ring.most)
    assert seen[2].doc_id.tolist() == sorted(set(low)) and len(seen[2]) < len(seen[1])
    items = [(r.item_id, r.text) for r in table("benchmark").itertuples()]
    clean = [d for d, t in zip(seen[2].doc_id, seen[2].text, strict=True) for _, hit, _ in [brute.windows_in(t, items)] if not hit]
    assert seen[3].doc_id.tolist() == clean
    total, target = plain_mix(list(zip(seen[3].doc_id, seen[3].source, seen[3].text, strict=True)))
    size = seen[4].text.map(lambda t: len(re.findall("[^\x20\x09-\x0d]+", t)))
    taken = size.groupby(seen[4].source).sum().to_dict()
    largest = size.max()
    assert all(abs(taken.get(s, 0) - target[s]) <= 2 * largest for s in total) and seen[4].doc_id.value_counts().max() <= 3
    want = sorted((d, len(e.ids) + 1) for d, e in zip(seen[4].doc_id, library(seen[4].text.tolist()), strict=True))
    assert sorted(zip(out.doc_id, out.n_tokens, strict=True)) == want and sorted(out.start)[0] == 0


def test_pipeline_drops_a_passage_in_a_long_document(spark, tmp_path):
    """A benchmark passage is a leak however little of the document it is; clean documents of any length stay."""
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    item = text(20)
    docs = [(1, f"{text(1000)} {item} {text(1000)}", "k"), (2, text(2000), "k"), (3, text(12), None), (4, None, "k"), (5, "", "k"), (6, " ".join(item.split()[:12]), "k")]
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.uncontaminated(spark, spark.createDataFrame(docs, "doc_id long, text string, N_Hit string"), str(tmp_path))
    assert {tuple(r) for r in out.collect()} == {d for d in docs if d[0] != 1}
    assert out.columns == ["doc_id", "text", "N_Hit"]


def test_pipeline_over_an_odd_table(spark, tmp_path):
    rng = random.Random(1)
    word = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    rows = [(i, word(rng.randrange(5, 80)), rng.choice(["a", "b", None]), None, 1) for i in range(60)]
    rows += [(60, None, None, None, None), (61, "", "a", None, 0), (61, "", "a", None, 0), (None, word(9), "b", None, 2), (3, rows[3][1], rows[3][2], None, 1)]
    names = "doc_id long, text string, source string, component_id long, Score int"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1 if i % 3 else None, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, rows[5][1]), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert len(out) > 40 and 5 not in set(out.doc_id.dropna()) and not any(math.isnan(x) for x in out.n_tokens)
    assert {name: f is not None for name, f in corpus_pipeline.STAGES}.keys() == {"quality", "near_duplicates", "decontaminate", "mix", "tokens"}


def test_pipeline_over_nothing(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{oracle.SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
