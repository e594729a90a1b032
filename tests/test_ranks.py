import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import ranks as R
from lodestar.operators import stats as S


def _rows(seed, n):
    rng = random.Random(seed)
    kinds = [lambda: None, lambda: 0.5, lambda: round(rng.random(), 1), rng.random, lambda: -0.0, lambda: 0.0]
    return [(rng.choice(["a", "b", None]), rng.choice(kinds)(), k) for k in range(n)]


def _groups(rows):
    out = {}
    for g, x, k in rows:
        out.setdefault(g, []).append((x, k))
    return out


def test_average_ranks_by_hand(spark):
    rows = _rows(1, 400)
    got = {r["k"]: (r["r"], r["t"]) for r in R.with_average_rank(spark.createDataFrame(rows, "g string, x double, k int").repartition(5), ["g"], "x", "r", "t").collect()}
    for own in _groups(rows).values():
        values = sorted(x for x, _ in own if x is not None)
        for x, k in own:
            if x is None:
                assert got[k] == (None, None)
            else:
                places = [i + 1 for i, y in enumerate(values) if y == x]
                assert got[k] == (statistics.mean(places), len(values))


def test_adjusted_p_values_by_hand(spark):
    rows = [(g, None if x is None else abs(x), k) for g, x, k in _rows(2, 300)]
    got = {r["k"]: r["q"] for r in R.step_up(spark.createDataFrame(rows, "g string, x double, k int").repartition(5), "x", "q", ["g"]).collect()}
    for own in _groups(rows).values():
        some = sorted((x, k) for x, k in own if x is not None)
        least = 1.0
        want = {}
        for i in range(len(some), 0, -1):
            least = min(least, some[i - 1][0] * len(some) / i)
            want[some[i - 1][1]] = least
        for x, k in own:
            assert got[k] is None if x is None else got[k] == pytest.approx(want[k])


@pytest.mark.parametrize("units", [21, 200])
def test_large_tests_pass_through_the_false_discovery_rate(spark, units):
    """More units than can be divided in all ways: drawn divisions, and no p-value is missing in the family."""
    rng = random.Random(units)
    rows = [(key, k % 2, k, rng.random() + (0.5 if key == 1 and k % 2 else 0)) for key in range(3) for k in range(units)]
    df = spark.createDataFrame(rows, "key int, side int, unit int, x double")
    p = S.permutation_test(df, ["key"], "unit", "side", 0, 1, "x", 99)
    got = {r["key"]: r for r in S.benjamini_hochberg(p, "p_value").collect()}
    assert {r["method"] for r in got.values()} == {"monte_carlo"} and all(r["q"] is not None and r["q"] >= r["p_value"] for r in got.values())
    assert got[1]["p_value"] == min(r["p_value"] for r in got.values())


def test_quantiles_are_numpys(spark):
    rows = _rows(3, 500)
    probabilities = (0.0, 0.05, 0.5, 0.77, 1.0)
    got = {r["g"]: r["q"] for r in R.quantiles(spark.createDataFrame(rows, "g string, x double, k int").repartition(5), ["g"], "x", probabilities).collect()}
    for g, own in _groups(rows).items():
        assert got[g] == pytest.approx(list(np.quantile([x for x, _ in own if x is not None], probabilities)))


def test_numbers_within_groups(spark):
    rows = _rows(4, 300)
    df = spark.createDataFrame(rows, "g string, x double, k int").repartition(5)
    got = {r["k"]: r["row"] for r in R.numbered_within(df, ["g"], [F.desc_nulls_last("x"), F.col("k")]).collect()}
    for own in _groups(rows).values():
        order = sorted(own, key=lambda t: (t[0] is None, -(t[0] or 0.0), t[1]))
        assert [got[k] for _, k in order] == list(range(1, len(own) + 1))
    whole = R.numbered_within(df, [], [F.col("k")]).collect()
    assert sorted((r["k"], r["row"]) for r in whole) == [(k, k + 1) for k in range(300)]


def test_nothing_to_rank(spark):
    none = spark.createDataFrame([("a", None)], "g string, x double")
    assert R.with_average_rank(none, ["g"], "x").first()["rank"] is None and R.step_up(none, "x", "q").first()["q"] is None
    assert R.quantiles(none.filter("false"), ["g"], "x", (0.5,)).collect() == []
