import numpy as np
import pytest

from lodestar.operators import embedding as E
from lodestar.operators import geometry as G
from lodestar.operators.quality import ContractError

ITEMS = [("a", b"xx", "pending"), ("b", b"xx", "pending"), ("c", b"bad", "pending"), ("d", b"y" * 40, "pending"), ("e", None, "pending"), ("f", b"xx", "unsupported"), ("g", b"nan", "pending")]


def _items(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item string, payload binary, status string").repartition(3)


def _load():
    def model(payloads):
        if any(p == b"bad" for p in payloads):
            raise ValueError("refused")
        return [np.array([len(p), np.nan if p == b"nan" else 1.0]) for p in payloads]

    return model


def test_each_content_once(spark):
    got = {r["item"]: r for r in E.stage(_items(spark), "item", "m1", _load, size=2).collect()}
    assert {i: (r["status"], r["origin"], r["representative"]) for i, r in got.items()} == {
        "a": ("success", "computed", "a"), "b": ("success", "alias", "a"), "c": ("failed", "", "c"), "d": ("success", "computed", "d"), "e": ("failed", "", None), "f": ("unsupported", "", None), "g": ("failed", "", "g"),
    }
    assert got["b"]["embedding"] == got["a"]["embedding"] == [2.0, 1.0]
    assert (got["c"]["error_message"], got["e"]["error_message"], got["g"]["error_message"]) == ("ValueError: refused", "no payload", "ValueError: the vector is not finite")
    assert E.stage(_items(spark, []), "item", "m1", _load).collect() == []


def test_a_model_that_does_not_load_fails_all(spark):
    def load():
        raise RuntimeError("no weights")

    got = E.stage(_items(spark, ITEMS[:2]), "item", "m2", load).collect()
    assert {r["error_message"] for r in got} == {"RuntimeError: no weights"} and {r["status"] for r in got} == {"failed"}


def test_cache_of_the_same_making(spark):
    digest = {r["item"]: r["digest"] for r in E.stage(_items(spark), "item", "m1", _load).collect()}
    rows = [(digest["a"], "v1", [5.0, 5.0]), (digest["d"], "v0", [6.0, 6.0]), (digest["c"], "v1", None)]
    cache = spark.createDataFrame(rows, "digest string, checkpoint string, embedding array<double>")
    got = {r["item"]: (r["origin"], r["embedding"]) for r in E.stage(_items(spark), "item", "m1", _load, cache, {"checkpoint": "v1"}).collect()}
    assert got["a"] == got["b"] == ("cache", [5.0, 5.0]) and got["d"] == ("computed", [40.0, 1.0])
    twice = cache.unionByName(spark.createDataFrame([(digest["a"], "v1", [5.0, 5.1])], cache.schema))
    with pytest.raises(ContractError, match="unlike vectors"):
        E.stage(_items(spark), "item", "m1", _load, twice, {"checkpoint": "v1"})


def test_batches_are_bounded():
    sizes = sorted([1, 5, 7, 7, 30, 100, 3, 8])
    runs = list(E._batches(sizes, 32))
    assert [k for r in runs for k in r] == list(range(len(sizes)))
    assert all(len(r) == 1 or max(sizes[k] for k in r) * len(r) <= 32 for r in runs) and len(runs) < len(sizes)
    assert list(E._batches([], 10)) == []


def _unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def _works(spark, seed=3, n=14):
    rng = np.random.default_rng(seed)
    v = _unit(rng.standard_normal((n, 5)))
    rows = [(k, int(k % 3), int(k % 2), v[k].tolist()) for k in range(n)]
    return rows, spark.createDataFrame(rows, "work int, label int, stratum int, vector array<double>")


def test_axes_of_all_folds(spark):
    rows, df = _works(spark)
    two = [r for r in rows if r[1] < 2]
    got = {r["work"]: np.array(r["axis"]) for r in G.fold_axes(df, "work", "label", 0, 1).collect()}
    for w, *_ in two:
        a, b = (_unit(np.mean([r[3] for r in two if r[1] == k and r[0] != w], axis=0)) for k in (0, 1))
        assert np.allclose(got[w], _unit(a - b))
    assert got.keys() == {r[0] for r in two}
    alone = df.filter("label = 0 or work = 1")
    assert {r["work"] for r in G.fold_axes(alone, "work", "label", 0, 1).collect()} == {r[0] for r in rows if r[1] == 0}
    assert G.fold_axes(df.filter("label = 0"), "work", "label", 0, 1).collect() == []


def test_products_with_a_few(spark, monkeypatch):
    rows, df = _works(spark)
    few = df.filter("work < 3").selectExpr("work as prompt", "vector as pv")
    got = {(r["work"], r["prompt"]): r["score"] for r in G.against_few(df, few, "work", "vector", "prompt", "pv").collect()}
    assert got == {(i, j): pytest.approx(float(np.dot(v, rows[j][3])), abs=1e-6) for i, _, _, v in rows for j in range(3)}
    assert G.against_few(df, few.filter("false"), "work", "vector", "prompt", "pv").collect() == []
    monkeypatch.setattr(G, "FEW", 2)
    with pytest.raises(ValueError, match="at most 2"):
        G.against_few(df, few, "work", "vector", "prompt", "pv")


def test_strata_by_all_pairs(spark):
    rows, df = _works(spark)
    got = {r["stratum"]: r for r in G.stratum_measures(df.filter("not (stratum = 1 and label = 1)"), "stratum", "label", 0, 1).collect()}
    assert set(got) == {0}
    own = [r for r in rows if r[2] == 0]
    pairs = [(a[1] == b[1], float(np.dot(a[3], b[3]))) for i, a in enumerate(own) for b in own[:i]]
    assert got[0]["within_mean"] == pytest.approx(np.mean([s for same, s in pairs if same]), abs=1e-6)
    assert got[0]["between_mean"] == pytest.approx(np.mean([s for same, s in pairs if not same]), abs=1e-6)
    nearer = 0
    for w, label, _, v in own:
        if label < 2:
            c = [_unit(np.sum([r[3] for r in own if r[1] == k and r[0] != w], axis=0)) for k in (0, 1)]
            nearer += np.dot(v, c[label]) > np.dot(v, c[1 - label])
    assert got[0]["nearer"] == nearer and got[0]["units"] == len(own)
