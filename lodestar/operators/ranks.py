"""Ranks, running extremes and quantiles of groups of any size, without a window or a buffer over a whole group.

The distinct values of all groups are counted (equal values combine before they move), range-sorted by group and value,
and written once, so that a partition is a range. Of every range and group only a sum or an extreme is added up over the
ranges before (or after) it; the rest happens inside the ranges. Ties need no care: they are one row with a count.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.sources.workspace import materialize


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str], suffix: str) -> Column:
    return functools.reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"{k}{suffix}"]) for k in keys])


def distribution(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, value, n, below, total, range): each group's distinct values that are not null, how many rows hold one, how many
    hold a smaller one, the group's rows, and the range in which the value lies."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    dealt = materialize(counts.repartitionByRange(*by, value).withColumn("range", F.spark_partition_id()), "distribution")
    sums = dealt.groupBy("range", *by).agg(F.sum("n").alias("__s"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.sum("__s").over(group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("range", *[F.col(c).alias(f"{c}__o") for c in by], F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__s").over(group).alias("total"))
    inside = F.sum("n").over(Window.partitionBy("range", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    here = dealt.withColumn("__inside", F.coalesce(inside, F.lit(0)))
    match = here["range"] == offsets["range"]
    rows = here.join(offsets, match & _same(here, offsets, by, "__o") if by else match)
    return rows.select(*[here[c] for c in by], here[value], "n", (F.col("__inside") + F.col("__before")).alias("below"), "total", here["range"])


def _back(df: DataFrame, found: DataFrame, by: Sequence[str], value: str, out: Sequence[str]) -> DataFrame:
    """``df`` with columns of its values' rows in ``found``; null values get null. Few rows share what many rows ask for, so
    a hot value is split by the planner's skew join."""
    keys = [*by, value]
    named = found.select(*[F.col(c).alias(f"{c}__v") for c in keys], *out)
    return df.join(named, _same(df, named, by, "__v") & (df[value] == named[f"{value}__v"]) if by else df[value] == named[f"{value}__v"], "left").drop(*[f"{c}__v" for c in keys])


def with_average_rank(df: DataFrame, by: Sequence[str], value: str, out: str = "rank", total: str | None = None) -> DataFrame:
    """``df`` with the average rank of each value in its group, from 1 for the smallest; null stays null.

    ``total`` names a column for the number of the group's values.
    """
    found = distribution(df, by, value)
    named = [(F.col("below") + (F.col("n") + 1) / 2.0).alias(out), *([F.col("total").alias(total)] if total else [])]
    return _back(df, found.select(*by, value, *named), by, value, [out, *([total] if total else [])])


def step_up(df: DataFrame, p: str, out: str = "q", by: Sequence[str] = ()) -> DataFrame:
    """``df`` with Benjamini-Hochberg's adjusted p-values within families ``by``; null is no part of a family and stays null.

    At a p-value that ``c`` of ``m`` do not exceed, ``p * m / c`` is met by all its ties; the adjusted value is the least of
    this and of those above: inside the range by a window, beyond it by the least of each later range.
    """
    raw = F.least(F.lit(1.0), F.col(p) * F.col("total") / (F.col("below") + F.col("n")))
    rows = distribution(df, by, p).withColumn("__raw", raw)
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    least = rows.groupBy("range", *by).agg(F.min("__raw").alias("__least"))
    later = F.min("__least").over(group.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1))
    beyond = least.select(F.col("range").alias("range__o"), *[F.col(c).alias(f"{c}__o") for c in by], later.alias("__later"))
    down = Window.partitionBy("range", *by).orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    here = rows.withColumn("__down", F.min("__raw").over(down))
    rows = here.join(beyond, _same(here, beyond, ["range", *by], "__o"))
    adjusted = F.greatest(F.lit(0.0), F.least("__down", F.coalesce("__later", F.lit(1.0))))
    return _back(df, rows.select(*[here[c] for c in by], here[p], adjusted.alias(out)), by, p, [out])


def quantiles(df: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """(by, q): linear quantiles of each group as an array, exact. Each lies between the values at two places of the sorted
    group, and the rows that hold those places are known by their counts."""
    rows = distribution(df, by, value)
    at = lambda p: F.lit(p) * (F.col("total") - 1)
    holds = lambda place: (F.col("below") <= place) & (place < F.col("below") + F.col("n"))
    pick = lambda place: F.max(F.when(holds(place), F.col(value)))
    found = rows.groupBy(*by).agg(F.max("total").alias("__t"), *[pick(f(at(p))).alias(f"__{k}{side}") for k, p in enumerate(probabilities) for side, f in (("l", F.floor), ("h", F.ceil))])
    share = lambda p: F.lit(p) * (F.col("__t") - 1) - F.floor(F.lit(p) * (F.col("__t") - 1))
    between = lambda k, p: (1 - share(p)) * F.col(f"__{k}l") + share(p) * F.col(f"__{k}h")
    return found.select(*by, F.array(*[between(k, p) for k, p in enumerate(probabilities)]).alias("q"))


def numbered_within(df: DataFrame, by: Sequence[str], order: Sequence[Column], out: str = "row") -> DataFrame:
    """``df`` with the rank from 1 of each row in its group by an order without ties.

    Rows are range-sorted by group and order and written once; ranges before a row's own add their counts.
    """
    dealt = materialize(df.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()), "numbered")
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    sums = dealt.groupBy("__range", *by).agg(F.count(F.lit(1)).alias("__s"))
    before = F.sum("__s").over(group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(F.col("__range").alias("__range__o"), *[F.col(c).alias(f"{c}__o") for c in by], F.coalesce(before, F.lit(0)).alias("__before"))
    here = dealt.withColumn("__inside", F.row_number().over(Window.partitionBy("__range", *by).orderBy(*order)))
    rows = here.join(offsets, _same(here, offsets, ["__range", *by], "__o"))
    return rows.withColumn(out, (F.col("__inside") + F.col("__before")).cast("long")).select(*[here[c] for c in df.columns], out)
