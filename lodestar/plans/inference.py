"""Queries of descriptive and inferential statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.operators import decomposition, ranks, stats
from lodestar.plans.catalog import query, table
from lodestar.plans.mapping import VECTORS, prompts, scores

#: Rounds, the reference's.
PERMUTATIONS, BOOTSTRAPS = 10_000, 5_000

#: Work means of similarity per prompt, the inferential unit.
_UNITS = VECTORS + ", u AS (SELECT prompt_id, label, work_id, round(avg(similarity), 8) AS x FROM s GROUP BY ALL), v AS (SELECT * FROM u WHERE label IN (0, 1))"
_CONTRAST = """, c AS (SELECT prompt_id, count(x) FILTER (label = 0) AS n_a, count(x) FILTER (label = 1) AS n_b, avg(x) FILTER (label = 0) AS ma, avg(x) FILTER (label = 1) AS mb,
var_samp(x) FILTER (label = 0) AS va, var_samp(x) FILTER (label = 1) AS vb FROM v GROUP BY prompt_id)"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).groupBy("prompt_id", "label", "work_id").agg(F.round(F.avg("similarity"), 8).alias("x"))


@query("describe_scores", f"""WITH {VECTORS} SELECT prompt_id, count(*) AS n, round(avg(similarity), 6) AS mean, round(CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(similarity) END, 6) AS std,
round(quantile_cont(similarity, 0.05), 6) AS q05, round(quantile_cont(similarity, 0.25), 6) AS q25, round(quantile_cont(similarity, 0.5), 6) AS median, round(quantile_cont(similarity, 0.75), 6) AS q75,
round(quantile_cont(similarity, 0.95), 6) AS q95 FROM s GROUP BY prompt_id""")  # fmt: skip
def describe_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.describe(scores(spark, sf_dir), ["prompt_id"], "similarity")


@query("hedges_g", f"""WITH {_UNITS}{_CONTRAST} SELECT prompt_id, n_a, n_b, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(ma - mb, 6) AS difference,
round((1 - 3.0 / (4 * (n_a + n_b) - 9)) * (ma - mb) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)), 6) AS hedges_g FROM c""")  # fmt: skip
def hedges_g(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.contrast(units(spark, sf_dir), ["prompt_id"], "label", 0, 1, "x")


_EXACT = _UNITS + """, k AS (SELECT prompt_id, list(x ORDER BY label, x) AS u, count(*) FILTER (label = 0) AS k, count(*) AS n, sum(x) AS total, sum(x) FILTER (label = 0) AS seen FROM v GROUP BY prompt_id),
m AS (SELECT prompt_id, u, k, n, total, seen, unnest(range(0, 1 << n::INT)) AS mask FROM k),
q AS (SELECT prompt_id, k, n, total, seen, list_sum(list_transform(u, lambda x, i: CASE WHEN (mask >> (i - 1)) & 1 = 1 THEN x ELSE 0 END)) AS pick FROM m WHERE bit_count(mask) = k),
x AS (SELECT prompt_id, count(*) AS divisions, avg((abs(pick / k - (total - pick) / (n - k)) >= abs(seen / k - (total - seen) / (n - k)) - 1e-12)::INT) AS p FROM q GROUP BY prompt_id)"""


def _tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.permutation_test(units(spark, sf_dir), ["prompt_id"], "work_id", "label", 0, 1, "x", PERMUTATIONS)


@query("exact_permutation", f"WITH {_EXACT} SELECT prompt_id, divisions, round(p, 6) AS p_value FROM x")
def exact_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tested(spark, sf_dir).select("prompt_id", F.col("tested").alias("divisions"), "p_value")


@query("bh_fdr", f"""WITH {_EXACT}, r AS (SELECT prompt_id, round(p, 6) AS p_value FROM x), o AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p_value) AS k FROM r)
SELECT prompt_id, p_value, round(min(least(1.0, p_value * m / k)) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS q_value FROM o""")  # fmt: skip
def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _tested(spark, sf_dir).select("prompt_id", "p_value")
    return stats.benjamini_hochberg(p, "p_value", "q").select("prompt_id", "p_value", F.round("q", 6).alias("q_value"))


@query("primary_family_fdr", f"""WITH {_EXACT}, r AS (SELECT prompt_id, prompt_id < 4 AS is_primary, round(p, 6) AS p_value FROM x), f AS (SELECT * FROM r WHERE is_primary),
o AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p_value) AS k FROM f),
z AS (SELECT prompt_id, round(min(least(1.0, p_value * m / k)) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS q_value FROM o)
SELECT r.prompt_id, is_primary, p_value, q_value FROM r LEFT JOIN z ON z.prompt_id = r.prompt_id""")  # fmt: skip
def primary_family_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _tested(spark, sf_dir).select("prompt_id", "p_value")
    p = p.withColumn("is_primary", F.col("prompt_id") < 4).withColumn("primary_p", F.when(F.col("is_primary"), F.col("p_value")))
    return stats.benjamini_hochberg(p, "primary_p", "q").select("prompt_id", "is_primary", "p_value", F.round("q", 6).alias("q_value"))


_DRAW = "concat('0x', substr(md5({0}), 1, 8))::BIGINT"


@query("bootstrap_ci", f"""WITH {_UNITS}, k AS (SELECT prompt_id, label, list(x ORDER BY work_id) AS u FROM v GROUP BY ALL), b AS (SELECT *, unnest(range(1, {BOOTSTRAPS + 1})) AS r FROM k),
m AS (SELECT prompt_id, label, r, list_sum(list_transform(range(1, len(u) + 1), lambda i: u[({_DRAW.format("concat(r, ':', label, ':', i)")} % len(u) + 1)])) / len(u) AS m FROM b),
d AS (SELECT prompt_id, r, max(m) FILTER (label = 0) - max(m) FILTER (label = 1) AS d FROM m GROUP BY ALL)
SELECT prompt_id, round(quantile_cont(d, 0.025), 6) AS ci_low, round(quantile_cont(d, 0.975), 6) AS ci_high FROM d GROUP BY prompt_id""")  # fmt: skip
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.hashed_bootstrap(units(spark, sf_dir), ["prompt_id"], "work_id", "label", 0, 1, "x", BOOTSTRAPS)


@query("hashed_permutation", f"""WITH {_UNITS}, r AS (SELECT *, unnest(range(0, {PERMUTATIONS + 1})) AS r FROM v),
o AS (SELECT *, row_number() OVER (PARTITION BY prompt_id, r ORDER BY {_DRAW.format("concat(r, ':', work_id)")}, work_id) <= count(*) FILTER (label = 0) OVER (PARTITION BY prompt_id, r) AS side FROM r),
m AS (SELECT prompt_id, r, CASE WHEN r = 0 THEN abs(avg(x) FILTER (label = 0) - avg(x) FILTER (label = 1)) ELSE abs(avg(x) FILTER (side) - avg(x) FILTER (NOT side)) END AS d FROM o GROUP BY prompt_id, r),
z AS (SELECT *, max(d) FILTER (r = 0) OVER (PARTITION BY prompt_id) AS seen FROM m)
SELECT prompt_id, round((count(*) FILTER (d >= seen - 1e-12) + 1) / {PERMUTATIONS + 1}, 6) AS p_value FROM z WHERE r > 0 GROUP BY prompt_id""")  # fmt: skip
def hashed_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.hashed_permutation(units(spark, sf_dir), ["prompt_id"], "work_id", "label", 0, 1, "x", PERMUTATIONS)


@query("robustness_pairs", f"""WITH {_UNITS}{_CONTRAST}, d AS (SELECT prompt_id, ma - mb AS d FROM c)
SELECT a.prompt_id AS prompt_a, b.prompt_id AS prompt_b, round(a.d - b.d, 6) AS effect_difference, sign(a.d) = sign(b.d) AS same_sign FROM d a JOIN d b ON a.prompt_id % 2 = 0 AND b.prompt_id = a.prompt_id + 1""")  # fmt: skip
def robustness_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = units(spark, sf_dir).filter("label in (0, 1)").groupBy("prompt_id").agg(
        (F.avg(F.when(F.col("label") == 0, F.col("x"))) - F.avg(F.when(F.col("label") == 1, F.col("x")))).alias("d")
    )
    a, b = u.toDF("prompt_a", "da"), u.toDF("prompt_b", "db")
    rows = a.filter("prompt_a % 2 = 0").join(b, F.col("prompt_b") == F.col("prompt_a") + 1)
    return rows.select("prompt_a", "prompt_b", F.round(F.col("da") - F.col("db"), 6).alias("effect_difference"), (F.signum("da") == F.signum("db")).alias("same_sign"))


#: Part attributes as features, lineitem aggregates as outcomes; the part is the unit. The discount is missing for some.
_FEATURES = """f AS (SELECT p_partkey AS unit, p_size::DOUBLE AS size, p_retailprice AS price, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE (p_partkey % 11)::DOUBLE END AS gap, 1.0::DOUBLE AS flat FROM part),
o AS (SELECT l_partkey AS unit, round(avg(l_quantity), 6) AS quantity, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY l_partkey),
j AS (SELECT f.*, quantity, discount FROM f JOIN o ON o.unit = f.unit),
x AS (SELECT unit, unnest(['size', 'price', 'gap', 'flat']) AS predictor, unnest([size, price, gap, flat]) AS x FROM j),
y AS (SELECT unit, unnest(['quantity', 'discount']) AS outcome, unnest([quantity, discount]) AS y FROM j)"""


def unit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    f = p.select(
        F.col("p_partkey").alias("unit"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"),
        F.when(F.col("p_partkey") % 7 != 0, (F.col("p_partkey") % 11).cast("double")).alias("gap"), F.lit(1.0).alias("flat"),
    )
    o = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("unit")).agg(
        F.round(F.avg("l_quantity"), 6).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount")
    )
    return f.join(o, "unit")


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = unit_table(spark, sf_dir)
    x = j.unpivot(["unit", "quantity", "discount"], ["size", "price", "gap", "flat"], "predictor", "x")
    return x.unpivot(["unit", "predictor", "x"], ["quantity", "discount"], "outcome", "y")


@query("corr_matrix", f"""WITH {_FEATURES} SELECT predictor, outcome, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n,
round(CASE WHEN predictor = 'flat' THEN NULL ELSE corr(x, y) END, 6) AS r FROM x JOIN y USING (unit) GROUP BY predictor, outcome""")  # fmt: skip
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    return _sides(spark, sf_dir).groupBy("predictor", "outcome").agg(F.count_if(both).alias("n"), F.round(stats.pearson(F.col("x"), F.col("y")), 6).alias("r"))


@query("spearman", f"""WITH {_FEATURES}, rx AS (SELECT unit, predictor, CASE WHEN x IS NOT NULL THEN rank() OVER (PARTITION BY predictor ORDER BY x NULLS LAST) + (count(*) OVER (PARTITION BY predictor, x) - 1) / 2.0 END AS x FROM x),
ry AS (SELECT unit, outcome, rank() OVER (PARTITION BY outcome ORDER BY y) + (count(*) OVER (PARTITION BY outcome, y) - 1) / 2.0 AS y FROM y)
SELECT predictor, outcome, round(CASE WHEN predictor = 'flat' THEN NULL ELSE corr(x, y) END, 6) AS rho FROM rx JOIN ry USING (unit) GROUP BY predictor, outcome""")  # fmt: skip
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks are made before incomplete pairs are dropped, one feature at a time."""
    j = unit_table(spark, sf_dir)
    x = j.unpivot("unit", ["size", "price", "gap", "flat"], "predictor", "v")
    y = j.unpivot("unit", ["quantity", "discount"], "outcome", "v")
    x, y = (ranks.with_average_rank(t, [k], "v", c).select("unit", k, c) for t, k, c in ((x, "predictor", "x"), (y, "outcome", "y")))
    return x.join(y, "unit").groupBy("predictor", "outcome").agg(F.round(stats.pearson(F.col("x"), F.col("y")), 6).alias("rho"))


@query("top_features", f"""WITH {_FEATURES}, c AS (SELECT predictor, outcome, round(abs(corr(x, y)), 6) AS strength FROM x JOIN y USING (unit) WHERE predictor <> 'flat' GROUP BY ALL)
SELECT outcome, predictor, strength, row_number() OVER (PARTITION BY outcome ORDER BY strength DESC, predictor) AS rank FROM c QUALIFY rank <= 2""")  # fmt: skip
def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corr_matrix(spark, sf_dir).filter("r is not null").select("outcome", "predictor", F.abs("r").alias("strength"))
    w = Window.partitionBy("outcome").orderBy(F.desc("strength"), "predictor")
    return c.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 2")


@query("feature_contrasts", """WITH f AS (SELECT p_partkey % 10 AS work, p_partkey % 2 AS side, p_size::DOUBLE AS size, p_retailprice AS price FROM part),
u AS (SELECT work, side, unnest(['size', 'price', 'none']) AS feature, unnest([avg(size), avg(price), NULL]) AS x FROM f GROUP BY work, side),
c AS (SELECT feature, count(x) FILTER (side = 0) AS n_a, count(x) FILTER (side = 1) AS n_b, avg(x) FILTER (side = 0) - avg(x) FILTER (side = 1) AS d FROM u GROUP BY feature)
SELECT feature, CASE WHEN n_a < 2 OR n_b < 2 THEN 'skipped' ELSE 'ok' END AS status, n_a, n_b, round(d, 6) AS difference FROM c""")
def feature_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "part").select((F.col("p_partkey") % 10).alias("work"), (F.col("p_partkey") % 2).alias("side"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), F.lit(None).cast("double").alias("none"))
    u = f.unpivot(["work", "side"], ["size", "price", "none"], "feature", "v").groupBy("work", "side", "feature").agg(F.avg("v").alias("x"))
    c = stats.contrast(u, ["feature"], "side", 0, 1, "x")
    status = F.when((F.col("n_a") < 2) | (F.col("n_b") < 2), "skipped").otherwise("ok")
    return c.select("feature", status.alias("status"), "n_a", "n_b", "difference")


@query("entropy", """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c)
SELECT user_id, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY user_id""")
def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.entropy(table(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("population_spread", "SELECT user_id, round(stddev_pop(value), 6) AS spread FROM events GROUP BY user_id")
def population_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.stddev_pop("value"), 6).alias("spread"))


@query("variance_spectrum")
def variance_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eigenvalues, their shares and running sums; no SQL expresses a decomposition."""
    return decomposition.spectrum(table(spark, sf_dir, "embeddings"), "embedding", 10)


@query("pca_scores")
def pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decomposition.project(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 5)


@query("prompt_clusters")
def prompt_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average-linkage clusters of the prompts for every k with their silhouette, and the best k."""
    p = prompts(spark, sf_dir).select(F.col("prompt_id").alias("vec_id"), F.col("prompt_vector").alias("embedding"))
    return decomposition.clusterings(p, "vec_id", "embedding", range(3, 13))
