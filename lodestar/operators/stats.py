"""Descriptive and inferential statistics as grouped expressions."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators import ranks


def number(c: Column) -> Column:
    """A double with NaN as null: one marker for what is missing."""
    return F.when(~F.isnan(c.cast("double")), c.cast("double"))


def describe(df: DataFrame, keys: Sequence[str], value: str, digits: int = 6) -> DataFrame:
    """Count, mean, sample deviation (0 for one value), median and linear quantiles per group."""
    rows = df.select(*keys, number(F.col(value)).alias("__x"))
    n = F.count("__x")
    basic = rows.groupBy(*keys).agg(n.alias("n"), F.avg("__x").alias("mean"), F.when(n == 1, 0.0).otherwise(F.stddev_samp("__x")).alias("std"))
    found = ranks.quantiles(rows, keys, "__x", (0.05, 0.25, 0.5, 0.75, 0.95)).select(*[F.col(k).alias(f"__{k}") for k in keys], "q")
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.lit(True))
    names = ("q05", "q25", "median", "q75", "q95")
    return basic.join(found, same, "left").select(
        *keys, "n", F.round("mean", digits).alias("mean"), F.round("std", digits).alias("std"),
        *[F.round(F.col("q")[i], digits).alias(k) for i, k in enumerate(names)],
    )


def weighted_describe(hist: DataFrame, keys: Sequence[str], value: str = "similarity", weight: str = "n", digits: int = 6) -> DataFrame:
    """:func:`describe` of distinct values given with their frequencies.

    A quantile lies between the values at two places of the sorted whole; running sums of the frequencies say which
    rows hold those places, so nothing is expanded.
    """
    w, x = F.col(weight), F.col(value)
    group = Window.partitionBy(*keys)
    total = F.sum(w).over(group)
    rows = hist.withColumns({"__until": F.sum(w).over(group.orderBy(value)), "__total": total})
    probabilities = (0.05, 0.25, 0.5, 0.75, 0.95)
    at = {f"{side}{k}": F.floor(p * (F.col("__total") - 1)) + step for k, p in enumerate(probabilities) for side, step in (("l", 0), ("h", 1))}
    holds = {c: (F.col("__until") > place) & (F.col("__until") - w <= place) for c, place in at.items()}
    first, second = F.sum(w * x), F.sum(w * x * x)
    n = F.max("__total")
    std = F.when(n == 1, 0.0).otherwise(F.sqrt(F.greatest(F.try_divide(second - first * first / n, n - 1), F.lit(0.0))))
    out = rows.groupBy(*keys).agg(n.alias("n"), (first / n).alias("mean"), std.alias("std"), *[F.max(F.when(h, x)).alias(c) for c, h in holds.items()])
    part = lambda p: p * (F.col("n") - 1) - F.floor(p * (F.col("n") - 1))
    between = lambda k, p: F.col(f"l{k}") + part(p) * (F.coalesce(F.col(f"h{k}"), F.col(f"l{k}")) - F.col(f"l{k}"))
    names = ("q05", "q25", "median", "q75", "q95")
    return out.select(
        *keys, "n", F.round("mean", digits).alias("mean"), F.round("std", digits).alias("std"),
        *[F.round(between(k, p), digits).alias(name) for k, (p, name) in enumerate(zip(probabilities, names, strict=True))],
    )


def hedges_g(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> Column:
    """Hedges' g of two groups from counts, means and sample variances; null for fewer than two values on a side,
    0 for equal means without variance, else null without variance."""
    pooled = F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2)
    correct = 1 - 3.0 / (4 * (n1 + n2) - 9)
    g = F.when(pooled > 0, correct * F.try_divide(m1 - m2, F.sqrt(pooled))).when(m1 == m2, 0.0)
    return F.when((n1 >= 2) & (n2 >= 2), g)


def benjamini_hochberg(df: DataFrame, p: str, out: str = "q", by: Sequence[str] = ()) -> DataFrame:
    """Step-up adjusted p-values within families ``by``; null p-values are no part of the family and stay null.
    """
    return ranks.step_up(df, p, out, by)


def pearson(x: Column, y: Column) -> Column:
    """Correlation over complete finite pairs as an aggregate; null for fewer than three pairs or no variance.

    From the sums of centred products: unlike ``corr`` it does not raise where a column is constant. Whether one is constant
    is told by its extremes, since moments of parts that are merged leave a constant a tiny deviation.
    """
    both = x.isNotNull() & y.isNotNull()
    n, cov = F.count(F.when(both, 1)), F.covar_pop(F.when(both, x), F.when(both, y))
    sx, sy = F.stddev_pop(F.when(both, x)), F.stddev_pop(F.when(both, y))
    varies = lambda c: F.min(F.when(both, c)) < F.max(F.when(both, c))
    return F.when((n >= 3) & varies(x) & varies(y) & (sx > 0) & (sy > 0), F.try_divide(cov, sx * sy))


def contrast(units: DataFrame, keys: Sequence[str], side: str, positive, negative, value: str) -> DataFrame:
    """Counts, means, difference and Hedges' g of two sides per key."""
    on = lambda k: F.when(F.col(side) == k, number(F.col(value)))
    rows = units.groupBy(*keys).agg(
        F.count(on(positive)).alias("n_a"), F.count(on(negative)).alias("n_b"), F.avg(on(positive)).alias("mean_a"), F.avg(on(negative)).alias("mean_b"),
        F.var_samp(on(positive)).alias("var_a"), F.var_samp(on(negative)).alias("var_b"),
    )
    g = hedges_g(*[F.col(f"{c}_{s}") for s in "ab" for c in ("n", "mean", "var")])
    return rows.select(
        *keys, "n_a", "n_b", F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"),
        F.round(F.col("mean_a") - F.col("mean_b"), 6).alias("difference"), F.round(g, 6).alias("hedges_g"),
    )


def draw(*parts: Column | str) -> Column:
    """A reproducible 32-bit number from the md5 of its parts, the same in any engine."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hashed_permutation(units: DataFrame, keys: Sequence[str], unit_id: str, side: str, positive, negative, value: str, rounds: int) -> DataFrame:
    """Monte Carlo p-value (hits + 1) / (rounds + 1): in each round the units in hash order are dealt to the sides."""
    rows = units.filter(F.col(side).isin(positive, negative)).select(*keys, F.col(unit_id).alias("__u"), (F.col(side) == positive).alias("__a"), number(F.col(value)).alias("x")).filter("x is not null")
    dealt = rows.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds))))
    w = Window.partitionBy(*keys, "round")
    order = w.orderBy(draw(F.col("round").cast("string"), F.col("__u").cast("string")), "__u")
    k = F.count_if("__a").over(w)
    # round 0 is the observed division
    dealt = dealt.withColumn("__side", F.when(F.col("round") == 0, F.col("__a")).otherwise(F.row_number().over(order) <= k))
    means = dealt.groupBy(*keys, "round").agg(F.abs(F.avg(F.when(F.col("__side"), F.col("x"))) - F.avg(F.when(~F.col("__side"), F.col("x")))).alias("d"))
    seen = F.max(F.when(F.col("round") == 0, F.col("d"))).over(Window.partitionBy(*keys))
    means = means.withColumn("seen", seen).filter("round > 0")
    return means.groupBy(*keys).agg(F.round((F.count_if(F.col("d") >= F.col("seen") - 1e-12) + 1) / (F.lit(rounds) + 1), 6).alias("p_value"))


def hashed_bootstrap(units: DataFrame, keys: Sequence[str], unit_id: str, side: str, positive, negative, value: str, rounds: int) -> DataFrame:
    """Percentile interval of the mean difference, resampling units within their side by hashed positions."""
    rows = units.filter(F.col(side).isin(positive, negative)).select(*keys, F.col(side).alias("__s"), F.col(unit_id).alias("__u"), number(F.col(value)).alias("x")).filter("x is not null")
    packed = rows.groupBy(*keys, "__s").agg(F.transform(F.sort_array(F.collect_list(F.struct("__u", "x"))), lambda s: s["x"]).alias("u"))
    packed = packed.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    n = F.size("u")
    at = lambda i: (draw(F.col("round").cast("string"), F.col("__s").cast("string"), i.cast("string")) % n + 1).cast("int")
    drawn = F.aggregate(F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at("u", at(i))), F.lit(0.0), lambda s, x: s + x) / n
    means = packed.select(*keys, "__s", "round", drawn.alias("m"))
    diff = means.groupBy(*keys, "round").agg((F.max(F.when(F.col("__s") == positive, F.col("m"))) - F.max(F.when(F.col("__s") == negative, F.col("m")))).alias("d"))
    q = F.percentile("d", F.array(F.lit(0.025), F.lit(0.975)))
    return diff.groupBy(*keys).agg(q.alias("q")).select(*keys, F.round(F.col("q")[0], 6).alias("ci_low"), F.round(F.col("q")[1], 6).alias("ci_high"))


def entropy(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Shannon entropy in bits of a value's distribution per group."""
    counts = df.groupBy(*keys, value).count()
    total = F.sum("count").over(Window.partitionBy(*keys))
    p = F.col("count") / total
    return counts.withColumn("t", -p * F.log2(p)).groupBy(*keys).agg(F.round(F.sum("t"), 6).alias("entropy"))


def _divisions(n: Column, k: Column) -> Column:
    """In how many ways ``k`` of ``n`` can be picked, as a double."""
    m = F.least(k, n - k)
    return F.when(m <= 0, 1.0).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), F.lit(1.0), lambda s, i: s * (n - m + i) / i))


def _all_picks(rows: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """(keys, pick) for every choice of the smaller side's size from each key's units, as arrays of places in rising order.

    Choices grow by one place at a time; ``most`` bounds the size of the smaller side.
    """
    picks = rows.select(*keys, "n", "m", F.array().cast("array<int>").alias("pick"))
    for level in range(most):
        last = F.coalesce(F.try_element_at("pick", F.lit(-1)), F.lit(-1))
        room = F.col("n") - F.col("m") + level  # the last place that leaves room for the others
        longer = F.transform(F.when(last + 1 <= room, F.sequence(last + 1, room)).otherwise(F.array().cast("array<int>")), lambda i: F.concat("pick", F.array(i)))
        picks = picks.select(*keys, "n", "m", F.explode(F.when(F.col("m") > level, longer).otherwise(F.array("pick"))).alias("pick"))
    return picks.drop("n", "m")


def permutation_test(units: DataFrame, keys: Sequence[str], unit_id: str, side: str, positive, negative, value: str, rounds: int) -> DataFrame:
    """Two-sided p-value of the absolute mean difference per key: (keys, p_value, tested, method).

    All divisions of the units are tested if there are at most ``rounds`` (exact: hits / tested), else so many divisions in
    hash order (monte_carlo: (hits + 1) / (tested + 1)). Any number of units will do.
    """
    rows = units.filter(F.col(side).isin(positive, negative)).withColumn("x", number(F.col(value))).filter("x is not null")
    a = F.col(side) == positive
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_if(a).cast("int").alias("k")).filter("k > 0 and k < n")
    sizes = sizes.withColumns({"m": F.least("k", F.col("n") - F.col("k")), "__all": _divisions(F.col("n"), F.col("k"))})
    exact = sizes.filter(F.col("__all") <= rounds)
    most = exact.agg(F.max("m")).first()[0] or 0  # at most the binary logarithm of the rounds
    packed = rows.join(exact.select(*keys), list(keys), "left_semi").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((~a).alias("b"), "x"))).alias("u"))
    packed = packed.join(exact.select(*keys, "n", "k", "m"), list(keys))
    total = F.aggregate("u", F.lit(0.0), lambda s, e: s + e["x"])
    own = F.aggregate(F.filter("u", lambda e: ~e["b"]), F.lit(0.0), lambda s, e: s + e["x"])
    # the difference is the same whichever side is picked, so the smaller one is
    seen = F.when(F.col("k") == F.col("m"), own).otherwise(total - own)
    tried = _all_picks(packed, keys, most).join(packed.select(*keys, "u", "n", "m", total.alias("t"), seen.alias("o")), list(keys))
    apart = lambda s: F.abs(s / F.col("m") - (F.col("t") - s) / (F.col("n") - F.col("m")))
    picked = F.aggregate("pick", F.lit(0.0), lambda s, i: s + F.get("u", i)["x"])
    hits = F.count_if(apart(picked) >= apart(F.col("o")) - 1e-12)
    one = tried.groupBy(*keys).agg(F.round(hits / F.count(F.lit(1)), 6).alias("p_value"), F.count(F.lit(1)).alias("tested")).withColumn("method", F.lit("exact"))
    many = units.join(sizes.filter(F.col("__all") > rounds).select(*keys), list(keys), "left_semi")
    drawn = hashed_permutation(many, keys, unit_id, side, positive, negative, value, rounds)
    return one.unionByName(drawn.select(*keys, "p_value", F.lit(rounds).cast("long").alias("tested"), F.lit("monte_carlo").alias("method")))


def contrasts(units: DataFrame, keys: Sequence[str], unit_id: str, side: str, positive, negative, value: str, bootstraps: int, permutations: int) -> DataFrame:
    """One row per key: counts, means, difference, interval, Hedges' g, permutation test and its false discovery rate.

    A key with fewer than two units on a side is skipped, with its reason, and is no part of the family of tests.
    """
    base = contrast(units, keys, side, positive, negative, value)
    short = (F.col("n_a") < 2) | (F.col("n_b") < 2)
    able = units.join(base.filter(~short).select(*keys), list(keys), "left_semi")
    interval = hashed_bootstrap(able, keys, unit_id, side, positive, negative, value, bootstraps)
    tests = permutation_test(able, keys, unit_id, side, positive, negative, value, permutations)
    rows = base.join(interval, list(keys), "left").join(tests, list(keys), "left")
    rows = benjamini_hochberg(rows, "p_value", "__q")
    status, reason = F.when(short, "skipped").otherwise("ok"), F.when(short, "fewer than two units on a side").otherwise("")
    return rows.select(
        *keys, status.alias("status"), reason.alias("reason"), "n_a", "n_b", "mean_a", "mean_b", F.when(~short, F.col("difference")).alias("difference"), "ci_low", "ci_high",
        "hedges_g", "p_value", "tested", "method", F.round("__q", 6).alias("q_value"),
    )
