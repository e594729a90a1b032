import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions.vectors import cosine, is_sound, unit
from lodestar.operators import geometry as G


def _frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, vector array<double>")


def test_cosine_of_literals(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = [r[0] for r in rows.select(cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 1.0 and math.isclose(got[1], math.sqrt(0.5)) and got[2] is None
    assert [r[0] for r in rows.select(is_sound(F.col("a"), 2)).collect()] == [True, True, False]
    assert rows.select(unit(F.col("a"))).collect()[2][0] is None


def test_mean_vector_is_normalised(spark):
    df = _frame(spark, [(1, 0, [2.0, 0.0]), (2, 0, [0.0, 2.0]), (3, 1, [0.0, -3.0])])
    got = {r["label"]: (r["vector"], r["n"]) for r in G.mean_vectors(df, ["label"], "vector").collect()}
    assert got[0][0] == pytest.approx([math.sqrt(0.5)] * 2) and got[0][1] == 2 and got[1][0] == [0.0, -1.0]


def test_leave_one_out_equals_the_direct_join(spark):
    rng = random.Random(3)
    rows = [(i, i % 3, [rng.gauss(0, 1) for _ in range(5)]) for i in range(12)] + [(99, 7, [1.0] * 5)]
    rows = [(i, g, (np.array(v) / np.linalg.norm(v)).tolist()) for i, g, v in rows]
    got = {(r["vec_id"], r["other"]): r["similarity"] for r in G.leave_one_out(_frame(spark, rows), "vec_id", "label").collect()}
    for i, _, v in rows:
        for other in {r[1] for r in rows}:
            rest = [np.array(w) for j, h, w in rows if h == other and j != i]
            if not rest:
                assert (i, other) not in got
                continue
            c = np.sum(rest, 0)
            assert got[i, other] == pytest.approx(float(np.dot(v, c) / np.linalg.norm(c)), abs=2e-6)


@pytest.mark.parametrize("block", [3, 100])
def test_nearest_is_brute_force(spark, block):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 4))
    x[5] = x[4]  # a tie
    df = _frame(spark, [(i, 0, v.tolist()) for i, v in enumerate(x)])
    got = {(r["vec_id"], r["rank"]): (r["neighbour"], r["similarity"]) for r in G.nearest(df, 3, "vec_id", "vector", block).collect()}
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(20):
        want = sorted(((-round(float(y[i] @ y[j]), 6), j) for j in range(20) if j != i))[:3]
        assert [got[i, k + 1] for k in range(3)] == [(j, -s) for s, j in want]


@pytest.mark.parametrize("block", [4, 100])
def test_pairs_are_counted_once(spark, block):
    rng = np.random.default_rng(2)
    df = _frame(spark, [(i, i % 2, rng.normal(size=3).tolist()) for i in range(15)])
    got = {r["within"]: r["n"] for r in G.pair_similarities(df, "vec_id", "label", "vector", block).groupBy("within").agg(F.sum("n").alias("n")).collect()}
    assert got == {True: 8 * 7 // 2 + 7 * 6 // 2, False: 8 * 7}


def test_nearest_of_an_empty_table(spark):
    assert G.nearest(_frame(spark, []), 2, "vec_id", "vector").count() == 0


def test_kernels_when_only_their_rows_are_counted(spark):
    """Unused columns are pruned around a cogroup of a table with itself; what the kernel reads must stay."""
    rng = np.random.default_rng(1)
    rows = [(i, i % 3, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 6)))]
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<double>")
    x = np.array([r[2] for r in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    assert G.nearest(df, 2, "vec_id", "vector", 9).count() == 80
    h = G.pair_similarities(df, "vec_id", "label", "vector", 9)
    assert h.groupBy("within").count().count() == 2 and h.agg(F.sum("n")).first()[0] == 780
    c = G.cross_similarities(df.filter("label = 0"), df.filter("label = 1"), "vector", 5)
    assert c.groupBy().count().first()[0] == len(np.unique(s[::3, 1::3])) and c.agg(F.sum("n")).first()[0] == 14 * 13
    t = G.top_across(df, "label", "vec_id", 4, "vector", 9)
    assert t.count() == 12
    for a, b in ((0, 1), (0, 2), (1, 2)):
        want = sorted(((-s[i, j], i, j) for i in range(a, 40, 3) for j in range(b, 40, 3)))[:4]
        got = t.filter(f"group_a = {a} and group_b = {b}").orderBy("rank").collect()
        assert [(r["item_a"], r["item_b"]) for r in got] == [(i, j) for _, i, j in want]


@pytest.fixture
def spread(spark):
    """Every partition of an exchange is a task of its own, as with large tables."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_blocks_meet_in_whichever_task_they_are(spark, spread):
    rng = np.random.default_rng(7)
    rows = [(i, i % 3, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 6)))]
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<double>")
    x = np.array([r[2] for r in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    got = {(r["vec_id"], r["rank"]): r["neighbour"] for r in G.nearest(df, 2, "vec_id", "vector", 9).collect()}
    assert got == {(i, k + 1): j for i in range(60) for k, (_, j) in enumerate(sorted((-s[i, j], j) for j in range(60) if j != i)[:2])}
    assert G.pair_similarities(df, "vec_id", "label", "vector", 9).agg(F.sum("n")).first()[0] == 60 * 59 // 2
    assert G.cross_similarities(df.filter("label = 0"), df.filter("label = 1"), "vector", 5).agg(F.sum("n")).first()[0] == 20 * 20
    want = sorted((-s[i, j], i, j) for i in range(0, 60, 3) for j in range(1, 60, 3))[:4]
    top = G.top_across(df, "label", "vec_id", 4, "vector", 9).filter("group_a = 0 and group_b = 1").orderBy("rank").collect()
    assert [(r["item_a"], r["item_b"]) for r in top] == [(i, j) for _, i, j in want]


def test_the_norm_is_made_once_a_vector(spark):
    """Inside the lambda over its elements it would be made for each of them."""
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "a array<double>").select(unit(F.col("a")).alias("u"))
    assert [r["u"] for r in df.collect()] == [[0.6, 0.8], None, None]
    assert df._jdf.queryExecution().analyzed().toString().lower().count("sqrt(") == 1


def test_large_blocks_are_met_in_tiles(spark, monkeypatch):
    """A block is as large as its bytes allow, so that a row is copied to few; what is held at a time does not grow with it."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(5000, 4))
    x[100:400] = x[100]  # many of one similarity: the lowest ids are the nearest
    df = _frame(spark, [(i, i % 3, v.tolist()) for i, v in enumerate(x)])
    assert G._extent(df, "vector", None) == (5000, G.BLOCK_BYTES // 32)
    made = []
    grid = G._grid
    monkeypatch.setattr(G, "_grid", lambda n, tasks, most: made.append((n, most)) or grid(1, tasks, n))
    got = {(r["vec_id"], r["rank"]): (r["neighbour"], r["similarity"]) for r in G.nearest(df, 3, "vec_id", "vector").collect()}
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(y @ y.T, 6)
    np.fill_diagonal(s, -2)
    order = np.argsort(-s, axis=1, kind="stable")[:, :3]
    assert all([got[i, k + 1][0] for k in range(3)] == order[i].tolist() for i in range(5000))
    assert all(got[i, k + 1][1] == pytest.approx(s[i, order[i, k]], abs=1e-9) for i in range(5000) for k in range(3))
    h = {(r["within"], round(r["similarity"] * 1e6)): r["n"] for r in G.pair_similarities(df, "vec_id", "label", "vector").collect()}
    i, j = np.triu_indices(5000, 1)
    for within in (True, False):
        use = (i % 3 == j % 3) == within
        values, counts = np.unique(np.rint(s[i[use], j[use]] * 1e6).astype(int), return_counts=True)
        assert {v: n for (w, v), n in h.items() if w == within} == dict(zip(values.tolist(), counts.tolist(), strict=True))
    assert made == [(5000, G.BLOCK_BYTES // 32)] * 2


def test_a_row_is_copied_to_few_blocks(spark):
    """Twenty blocks of a few thousand rows would be twenty copies of the table; by their bytes these rows are one block."""
    df = spark.range(60_000).select(F.col("id").alias("vec_id"), F.lit(0).alias("label"), F.expr("array(cast(id as double), 1d)").alias("vector"))
    n, most = G._extent(df, "vector", None)
    assert G._grid(n, 1, most) <= 2 < -(-n // 4096)


@pytest.mark.parametrize("block", [3, 1024])
def test_matched_is_the_join(spark, block):
    rng = np.random.default_rng(5)
    vectors = [v.tolist() for v in rng.normal(size=(40, 3))]
    vectors[4], vectors[9], vectors[7] = None, [1.0, 2.0], [-1e-9, 0.0, 0.0]
    rows = [(i, None if i == 12 else i % 7 // 3, v) for i, v in enumerate(vectors)] + [(2, 0, vectors[3]), (1000, 8, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, work_id long, vector array<double>")
    a, b = (df.filter(f"vec_id % 2 = {k}").withColumnRenamed("vec_id", c) for k, c in ((0, "x"), (1, "y")))
    got = sorted((r["x"], r["y"], r["work_id"], r["similarity"] is None, r["similarity"] or 0.0) for r in G.matched(a, b, "work_id", "x", "y", block_rows=block).collect())
    dot = lambda u, v: None if u is None or v is None or len(u) != len(v) else round(float(np.dot(u, v)), 6)
    pairs = [(i, j, g, dot(u, v)) for i, g, u in rows for j, h, v in rows if g is not None and g == h and i % 2 == 0 and j % 2 == 1]
    want = sorted((i, j, g, s is None, s or 0.0) for i, j, g, s in pairs)
    assert [r[:4] for r in got] == [r[:4] for r in want] and [r[4] for r in got] == pytest.approx([r[4] for r in want], abs=1.1e-6)
    assert G.matched(a.limit(0), b, "work_id", "x", "y").count() == 0


def test_a_large_work_is_met_in_blocks(spark, spread):
    """One work of many rows is dealt out: no task makes all of its pairs."""
    df = spark.range(400).select(F.col("id").alias("vec_id"), F.lit(1).cast("long").alias("work_id"), F.expr("array(1d, 0d)").alias("vector"))
    a, b = (df.filter(f"vec_id % 2 = {k}").withColumnRenamed("vec_id", c) for k, c in ((0, "x"), (1, "y")))
    per = G.matched(a, b, "work_id", "x", "y", block_rows=20).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in per) == 200 * 200 and len(per) > 2
