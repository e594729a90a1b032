"""Joins and selections over catalogue tables: star exports, reconciliation, registries, best sources, conflicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.sources.workspace import materialize


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of every key in an order; give an order without ties for a reproducible choice."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def numbered(df: DataFrame, order: Sequence[str], name: str, start: int = 0) -> DataFrame:
    """Rows numbered from ``start`` in an order, without gathering them in one task.

    Rows are range-sorted and written once, so that their partitions stay what they are; only the number of rows of
    each partition is added up in one place.
    """
    dealt = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    dealt = materialize(dealt, "numbered")
    counts = dealt.groupBy("__part").count()
    before = F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return dealt.join(counts, "__part").withColumn(name, inside + F.col("__before") + start).drop("__part", "__before")


def require_unique(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """``df`` itself; raises if a key occurs twice."""
    several = lambda *by: df.groupBy(*by).count().filter("count > 1").limit(3).collect()
    # eight bytes a row show that all keys differ; only where two are alike do the keys themselves move
    twice = several(F.xxhash64(*keys).alias("__hash")) and several(*keys)
    if twice:
        raise ValueError(f"{what}: {', '.join(keys)} is not unique, e.g. {[tuple(r)[:-1] for r in twice]}")
    return df


def labelled_join(facts: DataFrame, labels: DataFrame, keys: Sequence[str], same: Sequence[str] = ()) -> DataFrame:
    """Many-to-one left join that raises for unmatched facts and for columns of ``same`` that differ."""
    require_unique(labels, keys, "labels")
    marked = labels.select(*keys, *[F.col(c).alias(f"__{c}") for c in same], *[c for c in labels.columns if c not in (*keys, *same)], F.lit(True).alias("__hit"))
    rows = facts.join(marked, list(keys), "left")
    wrong = F.col("__hit").isNull()
    for c in same:
        wrong = wrong | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    bad = rows.filter(wrong).limit(1).collect()
    if bad:
        raise ValueError(f"no matching label: {bad[0].asDict()}")
    return rows.drop("__hit", *[f"__{c}" for c in same])


def reconcile(wanted: DataFrame, have: DataFrame, key: str, scope: str) -> DataFrame:
    """Every row of both sides once, with ``status``: matched, unmatched (wanted only) or stale.

    Both sides keep their first row per key. A row of ``have`` without a partner is stale only if its scope (the
    directory) occurs among the wanted; others are none of this reconciliation's business and are left out.
    """
    w = first_by(wanted, [key], [scope]).select(key, F.col(scope).alias("__ws"))
    h = first_by(have, [key], [scope]).select(key, F.col(scope).alias("__hs"))
    scopes = w.select(F.col("__ws").alias("__hs")).distinct()
    matched = w.join(h, key).select(key, F.col("__ws").alias(scope), F.lit("matched").alias("status"))
    unmatched = w.join(h, key, "left_anti").select(key, F.col("__ws").alias(scope), F.lit("unmatched").alias("status"))
    stale = h.join(w, key, "left_anti").join(scopes, "__hs", "left_semi").select(key, F.col("__hs").alias(scope), F.lit("stale").alias("status"))
    return matched.unionByName(unmatched).unionByName(stale)


def conflicts(df: DataFrame, key: str, stable: Sequence[str]) -> DataFrame:
    """Violations of ``key -> column``: (key, field, values) for every stable column with several values in a key.

    Rows that already lie at their key stay there (``unpivot`` would lose where they lie).
    """
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in stable])
    long = df.select(F.col(key).cast("string").alias(key), F.inline(fields))
    pairs = long.filter("value is not null and value <> ''").distinct()  # each value once, before a key's values meet
    sets = pairs.groupBy(key, "field").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("value")).alias("v"))
    return sets.filter("n > 1").select(key, "field", F.array_join("v", ";").alias("values"), "n")


def without_conflicts(df: DataFrame, key: str, stable: Sequence[str]) -> DataFrame:
    """Rows whose key has no conflict."""
    bad = conflicts(df, key, stable).select(F.col(key).alias("__bad")).distinct()
    return df.join(bad, F.col(key).cast("string") == F.col("__bad"), "left_anti")


def new_entries(batch: DataFrame, registry: DataFrame, identity: str, order: Sequence[Column | str]) -> DataFrame:
    """Rows of a batch that a registry lacks, the first of each identity."""
    return first_by(batch, [identity], order).join(registry.select(identity).distinct(), identity, "left_anti")


def aliases(df: DataFrame, content: Column, item: str) -> DataFrame:
    """(item, digest, representative): work on the representative's content serves all of its aliases.

    The smallest item of a digest represents it; a grouped minimum and a join, so a digest with many aliases is not
    gathered.
    """
    rows = df.select(item, F.sha2(content, 256).alias("digest"))
    least = rows.groupBy("digest").agg(F.min(item).alias("representative"), F.count(F.lit(1)).alias("copies"))
    return rows.join(least, "digest").select(item, "digest", "representative", "copies")


def balanced(df: DataFrame, group: str, subgroup: str, item: str, per_subgroup: int, target: int, seed: str) -> DataFrame:
    """The same number of items from every group, spread over subgroups in rounds.

    Items are in hash order inside a subgroup, at most ``per_subgroup`` of each; rounds interleave subgroups in hash
    order; every group gets the target, or as many as the smallest group has.
    """
    h = lambda c: F.sha2(F.concat_ws(":", F.lit(seed), F.col(c).cast("string")), 256)
    rows = df.withColumn("__round", F.row_number().over(Window.partitionBy(group, subgroup).orderBy(h(item), item))).filter(F.col("__round") <= per_subgroup)
    size = rows.groupBy(group).count().agg(F.least(F.min("count"), F.lit(target)).alias("__size"))
    w = Window.partitionBy(group).orderBy("__round", h(subgroup), subgroup)
    return rows.withColumn("selection_order", F.row_number().over(w)).crossJoin(F.broadcast(size)).filter(F.col("selection_order") <= F.col("__size")).drop("__round", "__size")


def narrowed(candidates: DataFrame, keys: Sequence[str], hints: Sequence[Column]) -> DataFrame:
    """The only candidate of a key that is left after each hint in turn; a hint that none meets is ignored, and a key
    with no or several survivors gets none."""
    rows = candidates
    w = Window.partitionBy(*keys)
    for hint in hints:
        flag = F.coalesce(hint, F.lit(False))
        rows = rows.withColumn("__f", flag).withColumn("__any", F.max("__f").over(w)).filter("__f or not __any").drop("__f", "__any")
    return rows.withColumn("__n", F.count(F.lit(1)).over(w)).filter("__n = 1").drop("__n")


def gaps(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, side): rows expected and missing, and rows present and unexpected."""
    e, a = expected.select(*keys).distinct(), actual.select(*keys).distinct()
    return e.subtract(a).withColumn("side", F.lit("missing")).unionByName(a.subtract(e).withColumn("side", F.lit("unexpected")))


def merge_states(live: DataFrame, recorded: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Full outer join of two views of the same jobs; what is live overrides what is recorded."""
    a = live.select(key, *[F.col(c).alias(f"__l_{c}") for c in columns], F.lit(True).alias("__l"))
    b = recorded.select(key, *[F.col(c).alias(f"__r_{c}") for c in columns], F.lit(True).alias("__r"))
    rows = a.join(b, key, "full_outer")
    source = F.when(F.col("__l").isNotNull() & F.col("__r").isNotNull(), "both").when(F.col("__l").isNotNull(), "live").otherwise("recorded")
    return rows.select(key, *[F.coalesce(F.col(f"__l_{c}"), F.col(f"__r_{c}")).alias(c) for c in columns], source.alias("source"))
