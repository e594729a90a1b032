import itertools
import statistics

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.operators import decomposition as D
from lodestar.operators import ranks as R
from lodestar.operators import stats as S


def _units(spark, a, b):
    return spark.createDataFrame([(1, s, k, x) for s, xs in ((0, a), (1, b)) for k, x in enumerate(xs, 10 * s)], "key int, side int, unit int, x double")


def test_contrast_by_hand(spark):
    row = S.contrast(_units(spark, [0.8, 0.7], [0.2, 0.3]), ["key"], "side", 0, 1, "x").first()
    assert row["difference"] == 0.5 and row["hedges_g"] == pytest.approx(4.0406, abs=1e-4)
    p = S.permutation_test(_units(spark, [0.8, 0.7], [0.2, 0.3]), ["key"], "unit", "side", 0, 1, "x", 100).first()
    assert p["tested"] == 6 and p["p_value"] == pytest.approx(1 / 3, abs=1e-6)


def test_hedges_g_without_variance(spark):
    assert S.contrast(_units(spark, [1.0, 1.0], [1.0, 1.0]), ["key"], "side", 0, 1, "x").first()["hedges_g"] == 0.0
    assert S.contrast(_units(spark, [2.0, 2.0], [1.0, 1.0]), ["key"], "side", 0, 1, "x").first()["hedges_g"] is None
    assert S.contrast(_units(spark, [2.0], [1.0, 1.0]), ["key"], "side", 0, 1, "x").first()["hedges_g"] is None


def test_exact_permutation_is_brute_force(spark):
    a, b = [0.3, 0.9, 0.4], [0.1, 0.2, 0.8, 0.05]
    every = a + b
    seen = abs(statistics.mean(a) - statistics.mean(b))
    splits = list(itertools.combinations(range(7), 3))
    hits = sum(abs(statistics.mean([every[i] for i in s]) - statistics.mean([every[i] for i in range(7) if i not in s])) >= seen - 1e-12 for s in splits)
    got = S.permutation_test(_units(spark, a, b), ["key"], "unit", "side", 0, 1, "x", 100).first()
    assert (got["tested"], got["p_value"]) == (35, pytest.approx(hits / 35, abs=1e-6))


def test_adjusted_p_values(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.5), (5, None)], "k int, p double")
    got = {r["k"]: r["q"] for r in S.benjamini_hochberg(df, "p").collect()}
    assert [got[k] for k in (1, 2, 3, 4)] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5]) and got[5] is None


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0, 1, allow_nan=False), min_size=1, max_size=12))
def test_adjusted_p_values_rise(spark, ps):
    df = spark.createDataFrame([(float(p),) for p in ps], "p double")
    rows = sorted((r["p"], r["q"]) for r in S.benjamini_hochberg(df, "p").collect())
    assert all(q >= p - 1e-12 and q <= 1 for p, q in rows) and [q for _, q in rows] == sorted(q for _, q in rows)


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "x double, y double")
    assert df.agg(S.pearson(F.col("x"), F.col("y"))).first()[0] is None
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (None, 1.0)], "x double, y double")
    assert df.agg(S.pearson(F.col("x"), F.col("y"))).first()[0] == pytest.approx(1.0)


def test_ranks_sum(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 3.0), (1, 1.0), (1, None)], "g int, x double")
    got = [r["r"] for r in R.with_average_rank(df, ["g"], "x", "r").collect()]
    assert sorted(x for x in got if x is not None) == [1.0, 2.5, 2.5] and got.count(None) == 1


def test_description_of_one_value(spark):
    row = S.describe(spark.createDataFrame([(1, 2.0), (1, float("nan"))], "g int, x double"), ["g"], "x").first()
    assert (row["n"], row["std"], row["median"]) == (1, 0.0, 2.0)


def test_monte_carlo_and_bootstrap_are_sane(spark):
    u = _units(spark, [0.8, 0.7, 0.75, 0.9], [0.2, 0.3, 0.25, 0.1])
    p = S.hashed_permutation(u, ["key"], "unit", "side", 0, 1, "x", 300).first()["p_value"]
    exact = S.permutation_test(u, ["key"], "unit", "side", 0, 1, "x", 100).first()["p_value"]
    assert abs(p - exact) < 0.05
    ci = S.hashed_bootstrap(u, ["key"], "unit", "side", 0, 1, "x", 200).first()
    assert ci["ci_low"] <= 0.575 <= ci["ci_high"]


def test_principal_components(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 4)) * [3, 2, 1, 0.5] + 5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    want = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2 / 59
    got = [r["eigenvalue"] for r in D.spectrum(df, "v", 4).orderBy("component").collect()]
    assert got == pytest.approx(want.tolist())
    scores = D.project(df, "id", "v", 2).groupBy("component").agg(F.avg("score").alias("m"), F.var_samp("score").alias("v")).orderBy("component").collect()
    assert [r["v"] for r in scores] == pytest.approx(want[:2].tolist(), rel=1e-4) and abs(scores[0]["m"]) < 1e-5


def test_clusters_of_three_directions(spark):
    rng = np.random.default_rng(5)
    x = np.repeat(np.eye(3), 5, 0) + rng.normal(scale=0.05, size=(15, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    best = D.clusterings(df, "id", "v", range(2, 6)).filter("best").orderBy("id").collect()
    assert {r["k"] for r in best} == {3} and [r["cluster"] for r in best] == [0] * 5 + [1] * 5 + [2] * 5
    labels = spark.createDataFrame([(r["cluster"], r["id"] // 5) for r in best], "a int, b long")
    assert D.rand_index(labels, "a", "b").first()[0] == 1.0


def test_entropy(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (1, "b"), (2, "a")], "g int, x string")
    assert {r["g"]: r["entropy"] for r in S.entropy(df, ["g"], "x").collect()} == {1: 1.0, 2: 0.0}


def test_description_by_frequencies(spark):
    values = [1.0, 1.0, 2.0, 5.0, 5.0, 5.0, 9.0]
    plain = S.describe(spark.createDataFrame([(1, v) for v in values], "g int, x double"), ["g"], "x").first()
    hist = spark.createDataFrame([(1, v, values.count(v)) for v in set(values)] + [(2, 3.0, 1)], "g int, similarity double, n long")
    got = {r["g"]: r for r in S.weighted_describe(hist, ["g"]).collect()}
    assert got[1].asDict() == plain.asDict() and got[2]["median"] == 3.0 and got[2]["std"] == 0.0


def test_a_constant_has_no_correlation_however_rows_are_dealt(spark):
    rows = spark.range(0, 98, 1, 2).select(F.lit(1.0).alias("x"), (F.col("id") % 13).cast("double").alias("y"))
    assert rows.agg(F.stddev_pop("x")).first()[0] > 0  # from merging 49 rows' moments, since 49 * (1 / 49) < 1
    assert tuple(rows.agg(S.pearson(F.col("x"), F.col("y")).alias("a"), S.pearson(F.col("y"), F.col("x")).alias("b")).first()) == (None, None)
