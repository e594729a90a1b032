import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import quality, toxicity
from tests.llm.helpers import ODD, empty, odd

BASE = "the of and river stone market window letter garden number winter summer paper bottle village doctor".split()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    texts, labels = [], []
    for i in range(900):
        w = [rng.choice(BASE) + rng.choice(["", "s", "ing", "ton"]) for _ in range(rng.randint(25, 120))]
        good, toxic = int(rng.random() < 0.8), int(rng.random() < 0.15)
        if toxic:
            for _ in range(max(2, len(w) // 20)):
                w.insert(rng.randrange(len(w)), rng.choice(["blockhead", "nitwit", "dimwitted"]))
        t = " ".join(w)
        t = t if good else " ".join(x + "$$$" for x in w) if i % 2 else t.upper().replace(" ", "!! ")
        texts.append((i, t, "src", "x"))
        if i % 3:
            labels.append((i, good, toxic))
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string, score string").repartition(4).cache()
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (g, x) for i, g, x in labels}


def _hits(rows, truth, k, parts, part):
    held = [r for r in rows if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % parts == part]
    return np.mean([r["predicted"] == truth[r["doc_id"]][k] for r in held])


def test_quality_on_held_out_documents(spark, corpus):
    docs, labels, truth = corpus
    learn = ~F.coalesce(quality.crc_mod("doc_id", 3) == 1, F.lit(False))
    net = quality.train(docs, labels, learn)
    rows = quality.score(docs, net).select("row.doc_id", "score", "predicted").collect()
    assert _hits(rows, truth, 0, 3, 1) > 0.95
    again = quality.score(docs, quality.train(docs, labels, learn)).select("row.doc_id", "score").collect()
    assert {r["doc_id"]: r["score"] for r in rows} == {r["doc_id"]: r["score"] for r in again}


def _reference_risk(positive, unlabelled, prior, seed):
    """The fit written out again row by row: weights after a few steps of non-negative risk."""
    net = quality.Network(np.concatenate([positive, unlabelled]), quality.HIDDEN, seed)
    draw = np.random.default_rng(seed)
    soft = lambda z: float(np.log1p(np.exp(-abs(z))) + max(z, 0.0))
    for _ in range(quality.STEPS):
        p = positive[draw.integers(0, len(positive), min(quality.BATCH, len(positive)))]
        u = unlabelled[draw.integers(0, len(unlabelled), min(2 * quality.BATCH, len(unlabelled)))]
        zp, zu = [float(z) for z in net.forward(p)[2]], [float(z) for z in net.forward(u)[2]]
        up = lambda z: 1 / (1 + np.exp(-z))
        if sum(map(soft, zu)) / len(zu) < prior * sum(map(soft, zp)) / len(zp):
            slopes = [prior * up(z) / len(zp) for z in zp] + [-up(z) / len(zu) for z in zu]
        else:
            slopes = [-prior * up(z) / len(zp) - prior * up(-z) / len(zp) for z in zp] + [up(z) / len(zu) for z in zu]
        net.step(np.concatenate([p, u]), np.array(slopes))
    return net


def test_fit_is_the_written_out_risk(monkeypatch):
    monkeypatch.setattr(quality, "STEPS", 40)
    monkeypatch.setattr(quality, "BATCH", 32)
    rng = np.random.default_rng(3)
    p, u = rng.normal(1, 1, (60, 3)), np.concatenate([rng.normal(1, 1, (60, 3)), rng.normal(-1, 1, (40, 3))])
    for prior in (0.3, 0.9):  # with the second the negative part falls below zero
        a, b = quality.fit(p, u, prior, 5), _reference_risk(p, u, prior, 5)
        assert np.allclose(a.score(u), b.score(u), atol=1e-9)


def test_negative_labels_are_never_read(spark, corpus):
    docs, labels, _ = corpus
    learn = F.lit(True)
    only = quality.train(docs, labels.filter("quality = 1"), learn)
    both = quality.train(docs, labels, learn)
    x = np.array([quality.features("a b c"), quality.features("A!! B$$")])
    assert only.score(x).tolist() == both.score(x).tolist()


def test_prior():
    rng = np.random.default_rng(6)
    p = rng.normal(3, 1, (500, 2))
    u = np.concatenate([rng.normal(3, 1, (700, 2)), rng.normal(-3, 1, (300, 2))])
    assert abs(quality.estimate_prior(p, u[rng.permutation(1000)]) - 0.7) < 0.1


def test_toxicity_on_held_out_documents(spark, corpus):
    docs, labels, truth = corpus
    learn = ~F.coalesce(quality.crc_mod("doc_id", 5) == 0, F.lit(False))
    model = toxicity.train(docs, labels, learn)
    rows = toxicity.score(docs, model).select("row.doc_id", "predicted").collect()
    assert _hits(rows, truth, 1, 5, 0) > 0.93


def test_coding_marks_word_beginnings():
    a, b = toxicity.coded("river stone"), toxicity.coded("x river")
    assert a[:10] in b and len(a) == 2 * 11
    long = "word " * 100_000
    assert len(toxicity.coded(long)) == 2 * len(long) and toxicity.coded(long)[:10] * 3 == toxicity.coded(long)[-30:]
    assert toxicity.coded("") == b"" and toxicity.coded("z" * 600_000)[:4] == toxicity.coded("zz")


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows_and_no_labels(spark, module):
    labels = spark.createDataFrame([(8, 1, 0), (9, 0, 1), (None, 1, 1), (8, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    for got in (labels, labels.limit(0)):
        model = module.train(odd(spark), got, F.lit(True))
        clash = odd(spark).withColumnsRenamed({"extra": "predicted", "source": "score"}).withColumn("row", F.lit("r"))
        scored = module.score(clash, model)
        assert sorted((tuple(r) for r in scored.select("row.*").collect()), key=repr) == sorted((tuple(r) for r in clash.collect()), key=repr)
        rows = scored.collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert module.score(empty(spark), module.train(empty(spark), labels, F.lit(True))).count() == 0
