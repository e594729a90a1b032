"""Data-quality rules as columns, and reports of counters with their severity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """Rows that break a contract."""


def broken(rules: Mapping[str, Column]) -> Column:
    """The names of the rules that a row breaks; an unknown outcome counts as kept."""
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))


def violations(df: DataFrame, item: str, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, n, first_id) over all broken rules, in one pass."""
    rows = df.select(F.col(item), F.explode(broken(rules)).alias("rule"))
    return rows.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min(item).alias("first_id"))


def require(df: DataFrame, item: str, rules: Mapping[str, Column]) -> DataFrame:
    """``df`` itself; raises with the first broken rule of the smallest item."""
    bad = df.select(F.col(item), broken(rules).alias("rules")).filter("size(rules) > 0").orderBy(item).limit(1).collect()
    if bad:
        raise ContractError(f"{item} {bad[0][0]}: {'; '.join(bad[0]['rules'])}")
    return df


def report(counters: DataFrame, errors: Sequence[str] = (), warnings: Sequence[str] = ()) -> DataFrame:
    """(metric, value, status) from one row of counters: an error or a warning if its counter is not zero."""
    long = counters.select(*[F.col(c).cast("long").alias(c) for c in counters.columns]).unpivot([], counters.columns, "metric", "value")
    at = lambda names: F.col("metric").isin(*names) if names else F.lit(False)
    status = F.when(at(errors) & (F.col("value") > 0), "error").when(at(warnings) & (F.col("value") > 0), "warning").otherwise("ok")
    return long.select("metric", "value", status.alias("status"))


def worst(rows: DataFrame) -> str:
    """The severity of a whole report: error, then warning, then ok."""
    got = {r["status"] for r in rows.select("status").distinct().collect()}
    return next((s for s in ("error", "warning") if s in got), "ok")


def accounted(selected: DataFrame, succeeded: DataFrame, failed: DataFrame) -> None:
    """Raises unless successes and failures add up to what was selected."""
    a, b, c = selected.count(), succeeded.count(), failed.count()
    if a != b + c:
        raise ContractError(f"{a} rows selected, but {b} succeeded and {c} failed")
