import math

import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import neighbours


def _rows(spark, ids, vectors, n=4):
    data = [(None if i is None else int(i), None if v is None else [None if x is None else float(x) for x in v], "c") for i, v in zip(ids, vectors, strict=True)]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, bucket string").repartition(n)


def _brute(ids, vectors, k, step):
    x = np.asarray(vectors, np.float32).astype(float)
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % step == 0:
            order = sorted(((-float((q * y).sum()), j) for j, y in zip(ids, x, strict=True) if j != i))
            out[i] = [(j, -s) for s, j in order[:k]]
    return out


def _got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def _recall(got, want):
    return sum(len({j for j, _ in got.get(i, [])} & {j for j, _ in w}) for i, w in want.items()) / sum(map(len, want.values()))


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 24))
    v = centres[rng.integers(0, 40, 3000)] + 0.35 * rng.standard_normal((3000, 24))
    ids = list(range(3000))
    got, want = _got(neighbours.nearest(_rows(spark, ids, v), F.col("vec_id") % 20 == 0)), _brute(ids, v, 20, 20)
    assert got.keys() == want.keys() and all(len(g) == 20 for g in got.values())
    assert _recall(got, want) >= 0.9
    x = np.asarray(v, np.float32).astype(float)
    for i, g in got.items():
        assert g == sorted(g, key=lambda t: (-t[1], t[0])) and all(abs(s - float(x[i] @ x[j])) < 1e-9 for j, s in g)


def test_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    data = rows.select("vec_id", "embedding").collect()
    got = _got(neighbours.nearest(rows, F.col("vec_id") % 20 == 0))
    assert _recall(got, _brute([r[0] for r in data], [r[1] for r in data], 20, 20)) >= 0.9


def test_clusters_are_searched_in_few_buckets():
    """Where neighbours stand apart, the fit takes deep tables and visits a small part of the rows."""
    rng = np.random.default_rng(6)
    v = (rng.standard_normal((400, 32))[:, None] * 3 + 0.1 * rng.standard_normal((400, 20, 32))).reshape(-1, 32)
    norm = np.linalg.norm(v, axis=1).max()
    own = np.arange(0, 8000, 100)
    h = neighbours.fit(v, v[own], own[:, None] == np.arange(8000)[None], 8000, 20, norm, 2, 0.96, 1)
    assert h.directions.shape[1] >= 2
    place = neighbours._slots(v, np.sqrt(norm**2 - (v * v).sum(1)), h.directions, h.offsets, h.slot)
    asked = neighbours._slots(v[own], np.zeros(len(own)), h.directions, h.offsets, h.slot)
    seen = np.zeros((len(own), 8000), bool)
    for t in range(2):
        steps, _ = neighbours._probes(neighbours._chances(asked[:, t], h.slot, h.distance), h.probes)
        wanted = neighbours._keys(np.floor(asked[:, t])[:, None] + steps, t, 32)
        seen |= (neighbours._keys(np.floor(place[:, t]), t, 32)[None, :, None] == wanted[:, None, :]).any(2)
    assert seen.mean() < 0.5


def test_probes_come_in_order_of_their_chances():
    rng = np.random.default_rng(7)
    chances = np.log(rng.random((3, 3, 7)))
    steps, score = neighbours._probes(chances, 50)
    for r in range(3):
        every = sorted((-(chances[r, 0, a] + chances[r, 1, b] + chances[r, 2, c]) for a in range(7) for b in range(7) for c in range(7)))
        assert np.allclose(-score[r], every[:50])
        assert len({tuple(s) for s in steps[r]}) == 50
        assert np.allclose(score[r], [sum(chances[r, f, s[f] + 3] for f in range(3)) for s in steps[r]])
    assert abs(float(neighbours._normal(np.array([1.0]))[0]) - 0.5 * (1 + math.erf(1 / math.sqrt(2)))) < 1e-6


def test_blocks_of_hot_buckets_and_copies(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 50)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(8)
    v = rng.standard_normal((300, 6))
    v[100:220] = v[100]  # copies, more than an answer holds
    v[220:280] = v[220] + 1e-3 * rng.standard_normal((60, 6))
    ids = list(range(1, 301))
    got, want = _got(neighbours.nearest(_rows(spark, ids, v), F.col("vec_id") % 10 == 0, recall=1.0)), _brute(ids, v, 20, 10)
    assert _recall(got, want) >= 0.98
    for i in range(110, 221, 10):  # a copy's answers are the smallest other ids among the copies, unless something is longer
        assert [j for j, _ in got[i]] == [j for j, _ in want[i]]


def test_odd_rows(spark):
    v = [[1, 0], [0, 1], None, [0, 0], [float("nan"), 1], [None, 1], [float("inf"), 1], [], [1, 1], [1, 1, 1], [2, 2, 2], [1, 0], [1, 0]]
    ids = [0, 20, 40, 60, 80, 100, 120, 140, None, 160, 1, 2, 2]
    got = _got(neighbours.nearest(_rows(spark, ids, v), F.col("vec_id") % 20 == 0))
    assert {i: [j for j, _ in g] for i, g in got.items()} == {0: [2, 20], 20: [0, 2], 160: [1]}
    none = _rows(spark, ids, v).filter("false")
    out = neighbours.nearest(none, F.col("vec_id") % 20 == 0)
    assert out.columns == ["query_id", "rank", "vec_id", "score"] and out.collect() == []
    alone = _rows(spark, [0], [[1, 2]])
    assert neighbours.nearest(alone, F.col("vec_id") % 20 == 0).collect() == []
