"""Held-out accuracy; what a model may see; gradients by hand."""

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from annalist.llm import ftrl, quality, queries, toxicity
from annalist.llm.ngrams import Grams, features

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name, label, folds, fold, least, good, bad", [("op8_quality_scores", "quality", 4, 2, 0.7, 0.98, 0.9), ("op10_toxicity_scores", "toxic", 5, 0, 0.5, 0.7, 0.98)])
def test_held_out(spark, name, label, folds, fold, least, good, bad):
    rows = queries.QUERIES[name](spark, SF).collect()
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    right = {0: [0, 0], 1: [0, 0]}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= least)
        if r.held_out and r.doc_id in labels:
            right[labels[r.doc_id]][0] += r.predicted == labels[r.doc_id]
            right[labels[r.doc_id]][1] += 1
    assert right[1][0] >= good * right[1][1] and right[0][0] >= bad * right[0][1]


DOCS = "doc_id long, text string, score string, __label string"


@pytest.mark.parametrize("module", [quality, toxicity])
def test_edges(spark, module):
    rows = [(i, ("bad " if i % 2 else "fine ") * 3 + f"word{i % 7}", "s", "") for i in range(60)] + [(3, "bad again", "s", ""), (None, "bad", "s", ""), (100, None, "s", ""), (101, "", "s", ""), (102, "?!", "s", ""), (103, "bad " * 50_000, "s", "")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 0), (None, 1), (4, None), (999, 1), (100, None)], "doc_id long, lab int")
    settings = ftrl.Settings(**{**module.SETTINGS.__dict__, "l1": 0.1, "least_docs": 2, "epochs": 5})
    model = module.fit(docs, labels, "lab", settings=settings)
    got = module.scored(docs, model)
    assert got.columns == ["doc_id", "text", "__label", "score"] or got.columns == docs.columns
    score = {(r.doc_id, r.text): r.score for r in got.collect()}
    assert all((s > 0.5) == t.startswith("bad") for (i, t), s in score.items() if t and 5 < len(t) < 100 and "again" not in t)
    assert score[100, None] == score[101, ""] == pytest.approx(1 / (1 + math.exp(-model.bias)))
    assert module.scored(docs.where("false"), model).collect() == []
    blank = module.fit(docs.where("false"), labels, "lab")
    assert {r.score for r in module.scored(docs, blank).collect()} == {0.5}


def test_shards_are_averaged_and_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "bad one" if i % 2 else "good one", "", "") for i in range(200)], DOCS)
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS lab")
    settings = ftrl.Settings(Grams(bits=12), presence=True, l1=0.1, least_docs=1, sample=40, shards=2)
    model = ftrl.fit(docs, labels, "lab", "doc_id", "text", settings)
    again = ftrl.fit(docs, labels, "lab", "doc_id", "text", settings)
    assert model.codes.tolist() == again.codes.tolist() and model.weights.tolist() == again.weights.tolist()
    got = [r.score for r in docs.withColumn("score", ftrl.score(docs, model, docs.text)).orderBy("doc_id").collect()]
    assert all((s > 0.5) == bool(i % 2) for i, s in enumerate(got))


def test_updates_follow_the_closed_form():
    settings = ftrl.Settings(Grams(bits=4), presence=True, alpha=0.5, beta=1.0, l1=0.3, l2=0.2, epochs=2, least_docs=1)
    rng = np.random.default_rng(0)
    examples = [(np.unique(rng.integers(0, 16, 5)).astype(np.int32), int(rng.random() < 0.5)) for _ in range(30)]
    z, n = [0.0] * 17, [0.0] * 17

    def weight(i):
        l1 = 0.0 if i == 16 else 0.3
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((1 + math.sqrt(n[i])) / 0.5 + 0.2)

    order = np.random.default_rng(7)
    for _ in range(2):
        for k in order.permutation(30):
            codes, y = examples[k]
            own = [*codes.tolist(), 16]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in own:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.5
                z[i] += g - sigma * w[i]
                n[i] += g * g
    flat = np.concatenate([c for c, _ in examples])
    sparse = ftrl.Sparse(flat, np.ones(len(flat), np.float32), np.r_[0, np.cumsum([len(c) for c, _ in examples])])
    codes, weights, bias = ftrl.fit_shard(sparse, np.array([y for _, y in examples]), settings, 7)
    want = {i: weight(i) for i in range(16) if weight(i)}
    assert dict(zip(codes.tolist(), weights.tolist(), strict=True)) == pytest.approx(want) and bias == pytest.approx(weight(16))


def test_grams():
    def grams(text, **kw):
        return sorted(next(features(pa.array([text]), Grams(**kw)))[0].tolist())

    assert grams("a b c") == grams("A  B\nC") == grams("a b c", lower=False) != grams("A b c", lower=False)
    assert len(grams("a b c")) == 5 and len(grams("a b c", skips=1)) == 6 and len(grams("a b c", stem=2)) == 8
    assert len(grams("a!! (b)", marks=True)) == 5 and grams("a a a", marks=True) == grams("a a a", marks=True)
    codes, docs, rows = next(features(pa.array(["x y", None, "", "z"]), Grams()))
    assert rows.tolist() == [0, 1, 2, 3] and sorted(docs.tolist()) == [0, 0, 0, 3]


def test_samples_hold_as_many_labels_as_the_readme_says():
    assert quality.SETTINGS.sample >= 8_000 and toxicity.SETTINGS.sample >= 8_000
