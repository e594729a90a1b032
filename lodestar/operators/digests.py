"""Digests of tables that do not depend on the order of rows, and comparisons that join only where digests differ."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Into how many partitions a table's keys are dealt.
PARTS = 256


def _hash(columns: Sequence[str], seed: int) -> Column:
    """64 bits of a row; each column with whether it is null, since a null leaves a hash as it was."""
    parts = [x for c in columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return F.xxhash64(F.lit(seed), *parts)


def part(keys: Sequence[str], parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in keys]), F.lit(parts)).cast("int")


def by_part(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, parts: int = PARTS) -> DataFrame:
    """(part, n, mark): of each partition by key the number of rows and a digest of them as a multiset.

    Two sums of independent 64-bit hashes of the rows: sums, unlike exclusive ors, tell how often a row stands there. At
    most ``parts`` numbers leave a task, whatever the table's size.
    """
    columns = list(columns or df.columns)
    sums = [F.sum(_hash(columns, seed).cast("decimal(20,0)")).cast("string") for seed in (1, 2)]
    rows = df.groupBy(part(keys, parts).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.concat_ws(",", *sums).alias("mark"))
    return rows.select("part", "n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), "mark"), 256).alias("mark"))


def table_digest(df: DataFrame, columns: Sequence[str] | None = None) -> str:
    """One digest of a whole table as a multiset of rows."""
    rows = by_part(df, list(columns or df.columns), columns).orderBy("part").collect()  # at most PARTS rows
    import hashlib

    return hashlib.sha256("\n".join(f"{r['part']}:{r['mark']}" for r in rows).encode()).hexdigest()


def unlike_parts(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], parts: int = PARTS) -> list[int]:
    """The partitions in which two tables are not the same multiset of rows."""
    x, y = (dict(by_part(t, keys, columns, parts).select("part", "mark").collect()) for t in (a, b))
    return sorted(p for p in x.keys() | y.keys() if x.get(p) != y.get(p))


def differences(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, parts: int = PARTS) -> DataFrame:
    """(keys, side) of rows that differ: ``missing`` (only in ``a``), ``unexpected`` (only in ``b``), ``changed``, or
    ``repeated`` where a key stands several times on one side and not the same rows on both.

    Tables that agree are compared without a join; else only partitions that differ are shuffled.
    """
    columns = list(columns or [c for c in a.columns if c not in keys])
    unlike = unlike_parts(a, b, keys, [*keys, *columns], parts)
    here = part(keys, parts).isin(unlike) if unlike else F.lit(False)
    sums = [F.count(F.lit(1)).alias("n"), F.sum(_hash(columns, 1).cast("decimal(20,0)")).alias("h")]
    x, y = (t.filter(here).groupBy(*keys).agg(*sums).toDF(*[f"{k}{s}" for k in keys], f"n{s}", f"h{s}") for t, s in ((a, "__a"), (b, "__b")))
    same = functools.reduce(lambda p, q: p & q, [x[f"{k}__a"].eqNullSafe(y[f"{k}__b"]) for k in keys])
    rows = x.join(y, same, "full_outer")
    side = F.when(F.col("n__b").isNull(), "missing").when(F.col("n__a").isNull(), "unexpected").when((F.col("n__a") > 1) | (F.col("n__b") > 1), "repeated").otherwise("changed")
    differ = ~(F.col("n__a").eqNullSafe(F.col("n__b")) & F.col("h__a").eqNullSafe(F.col("h__b")))
    return rows.filter(differ).select(*[F.when(F.col("n__a").isNull(), F.col(f"{k}__b")).otherwise(F.col(f"{k}__a")).alias(k) for k in keys], side.alias("side"))


def similarity_problems(similarities: DataFrame, manifest: DataFrame, prompts: DataFrame, primary: Sequence[str] = ()) -> DataFrame:
    """(problem, n) of a long table of similarities against its manifest and its configured prompts, in few passes.

    Rows without a passage, labels that differ from the manifest's, pairs that occur twice, values that are not finite,
    prompts that are missing, not configured or worded otherwise, a number of rows other than passages x prompts, and
    primary prompts without rows. Whether the sets of pairs are complete is told by digests; only unlike parts are joined.
    """
    labels = manifest.select(F.col("passage_id").alias("__p"), F.col("composer").alias("__composer"))
    words = prompts.select(F.col("prompt_id").alias("__q"), F.col("prompt_text").alias("__text"))
    rows = similarities.join(labels, F.col("passage_id") == F.col("__p"), "left").join(words, F.col("prompt_id") == F.col("__q"), "left")
    value = F.col("cosine_similarity")
    unsound = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    one = rows.agg(
        F.count_if(F.col("__p").isNull()).alias("rows without a passage"), F.count_if(F.col("__p").isNotNull() & ~F.col("composer").eqNullSafe(F.col("__composer"))).alias("labels differ"),
        F.count_if(unsound).alias("values are not finite"), F.count_if(F.col("__q").isNull()).alias("rows of prompts that are not configured"),
        F.count_if(F.col("__q").isNotNull() & ~F.col("prompt_text").eqNullSafe(F.col("__text"))).alias("wording differs"),
    )
    long = one.unpivot([], one.columns, "problem", "n")
    pairs = similarities.groupBy("passage_id", "prompt_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    more = [("pairs that occur twice", pairs.agg(F.count(F.lit(1)).alias("n")))]
    seen = similarities.select("prompt_id").distinct()
    more.append(("configured prompts without rows", prompts.select("prompt_id").distinct().join(seen, "prompt_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))))
    size = similarities.agg(F.count(F.lit(1)).alias("r")).crossJoin(manifest.agg(F.count_distinct("passage_id").alias("m"))).crossJoin(prompts.agg(F.count_distinct("prompt_id").alias("q")))
    more.append(("rows beside passages x prompts", size.select(F.abs(F.col("r") - F.col("m") * F.col("q")).alias("n"))))
    if primary:
        wanted = prompts.sparkSession.createDataFrame([(p,) for p in primary], seen.schema)
        more.append(("primary prompts without rows", wanted.join(seen, "prompt_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))))
    for problem, n in more:
        long = long.unionByName(n.select(F.lit(problem).alias("problem"), F.col("n").cast("long").alias("n")))
    return long.filter("n > 0")
