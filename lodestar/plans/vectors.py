"""Queries over the ``embeddings`` table: similarities, centroids, axes, leave-one-out probes, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.vectors import dot, is_sound, norm
from lodestar.operators import geometry as G
from lodestar.operators import ranks, stats
from lodestar.plans.catalog import query, table
from lodestar.plans.mapping import LEAVE_OUT, VECTORS, WORKS, passages, prompts, scores, vectors, works


def row_number(w: Window) -> Column:
    """Row numbers of SQL's width."""
    return F.row_number().over(w).cast("long")


def _top(df: DataFrame, by: str, other: str, k: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("similarity"), other)
    return df.withColumn("rank", row_number(w)).filter(F.col("rank") <= k)


@query("cosine_pairs", f"WITH {VECTORS} SELECT vec_id, prompt_id, similarity FROM s")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select("vec_id", "prompt_id", "similarity")


_RANKED = "SELECT vec_id, prompt_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY {0} ORDER BY similarity DESC, {1}) AS rank FROM s) WHERE rank <= 5"


@query("passage_prompt_topk", f"WITH {VECTORS} {_RANKED.format('vec_id', 'prompt_id')}")
def passage_prompt_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(scores(spark, sf_dir), "vec_id", "prompt_id", 5).select("vec_id", "prompt_id", "similarity", "rank")


@query("prompt_passage_topk", f"WITH {VECTORS} {_RANKED.format('prompt_id', 'vec_id')}")
def prompt_passage_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(scores(spark, sf_dir), "prompt_id", "vec_id", 5).select("vec_id", "prompt_id", "similarity", "rank")


@query("family_mean", f"WITH {VECTORS} SELECT vec_id, family, round(avg(similarity), 8) AS mean_similarity, count(*) AS n_prompts FROM s GROUP BY vec_id, family")
def family_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).groupBy("vec_id", "family").agg(F.round(F.avg("similarity"), 8).alias("mean_similarity"), F.count(F.lit(1)).alias("n_prompts"))


@query("family_pivot", f"""WITH {VECTORS} SELECT work_id, round(avg(similarity) FILTER (family = 0), 6) AS family_0, round(avg(similarity) FILTER (family = 1), 6) AS family_1,
round(avg(similarity) FILTER (family = 2), 6) AS family_2 FROM s GROUP BY work_id""")  # fmt: skip
def family_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    pivot = scores(spark, sf_dir).groupBy("work_id").pivot("family", [0, 1, 2]).agg(F.round(F.avg("similarity"), 6))
    return pivot.toDF("work_id", "family_0", "family_1", "family_2")


@query("axis_scores", f"""WITH {VECTORS}, a AS (SELECT vec_id, axis, max(similarity) FILTER (pole = 'positive') AS pos, max(similarity) FILTER (pole = 'negative') AS neg FROM s GROUP BY ALL)
SELECT vec_id, axis, round(pos - neg, 6) AS score FROM a WHERE pos IS NOT NULL AND neg IS NOT NULL""")  # fmt: skip
def axis_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pole = lambda k: F.max(F.when(F.col("pole") == k, F.col("similarity")))
    rows = scores(spark, sf_dir).groupBy("vec_id", "axis").agg(pole("positive").alias("p"), pole("negative").alias("n"))
    return rows.filter("p is not null and n is not null").select("vec_id", "axis", F.round(F.col("p") - F.col("n"), 6).alias("score"))


@query("centroids", f"""WITH {WORKS}, c AS (SELECT label, pos, avg(x) AS x FROM tl GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM c GROUP BY label)
SELECT c.label, (pos - 1)::INT AS pos, round(x / n, 6) AS value FROM c JOIN n ON n.label = c.label""")  # fmt: skip
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = G.mean_vectors(passages(spark, sf_dir), ["label"], "vector")
    return c.select("label", F.posexplode("vector").alias("pos", "value")).withColumn("value", F.round("value", 6))


_CENTROIDS = WORKS + """,
k0 AS (SELECT label, pos, avg(x) AS x FROM tl GROUP BY ALL), kn AS (SELECT label, sqrt(sum(x * x)) AS n FROM k0 GROUP BY label),
k AS (SELECT k0.label, pos, x / n AS x FROM k0 JOIN kn ON kn.label = k0.label)"""


@query("centroid_cosine", f"WITH {_CENTROIDS} SELECT a.label AS a, b.label AS b, round(sum(a.x * b.x), 6) AS similarity FROM k a JOIN k b ON a.pos = b.pos AND a.label < b.label GROUP BY ALL")
def centroid_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = G.mean_vectors(passages(spark, sf_dir), ["label"], "vector")
    a, b = c.select(F.col("label").alias("a"), F.col("vector").alias("va")), c.select(F.col("label").alias("b"), F.col("vector").alias("vb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(dot(F.col("va"), F.col("vb")), 6).alias("similarity"))


@query("composer_axis", f"""WITH {_CENTROIDS}, d AS (SELECT a.pos, a.x - b.x AS x FROM k a JOIN k b ON a.pos = b.pos AND a.label = 0 AND b.label = 1),
n AS (SELECT sqrt(sum(x * x)) AS n FROM d)
SELECT vec_id, tl.label, round(sum(tl.x * d.x) / any_value(n), 6) AS score FROM tl JOIN d USING (pos), n GROUP BY vec_id, tl.label""")  # fmt: skip
def composer_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = passages(spark, sf_dir)
    axis = G.axis_between(G.mean_vectors(p, ["label"], "vector"), "label", 0, 1)
    return p.crossJoin(axis).select("vec_id", "label", F.round(dot(F.col("vector"), F.col("axis")), 6).alias("score"))


@query("prompt_centroid_projection", f"""WITH {_CENTROIDS}, q AS (SELECT prompt_id, unnest(pv) AS y, generate_subscripts(pv, 1) AS pos FROM p),
r AS (SELECT prompt_id, label, round(sum(x * y), 6) AS similarity FROM k JOIN q USING (pos) GROUP BY ALL)
SELECT prompt_id, label, similarity, round(similarity - max(similarity) FILTER (label = 0) OVER (PARTITION BY prompt_id), 6) AS over_first,
row_number() OVER (PARTITION BY prompt_id ORDER BY similarity DESC, label) AS rank FROM r""")  # fmt: skip
def prompt_centroid_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = G.mean_vectors(passages(spark, sf_dir), ["label"], "vector")
    r = G.similarity_to(prompts(spark, sf_dir), c, F.col("prompt_vector"), F.col("vector"))
    w = Window.partitionBy("prompt_id")
    first = F.max(F.when(F.col("label") == 0, F.col("similarity"))).over(w)
    return r.select("prompt_id", "label", "similarity", F.round(F.col("similarity") - first, 6).alias("over_first"), row_number(w.orderBy(F.desc("similarity"), "label")).alias("rank"))


@query("prompt_response_profiles", f"""WITH {VECTORS} SELECT prompt_id, round(avg(similarity) FILTER (label = 0), 6) AS mean_a, round(avg(similarity) FILTER (label = 1), 6) AS mean_b,
round(avg(similarity) FILTER (label = 0) - avg(similarity) FILTER (label = 1), 6) AS difference FROM s WHERE label IN (0, 1) GROUP BY prompt_id""")  # fmt: skip
def prompt_response_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = lambda k: F.avg(F.when(F.col("label") == k, F.col("similarity")))
    rows = scores(spark, sf_dir).filter("label in (0, 1)").groupBy("prompt_id").agg(on(0).alias("a"), on(1).alias("b"))
    return rows.select("prompt_id", F.round("a", 6).alias("mean_a"), F.round("b", 6).alias("mean_b"), F.round(F.col("a") - F.col("b"), 6).alias("difference"))


_HIST = f"""WITH {VECTORS}, d AS (SELECT a.label = b.label AS within, round(list_dot_product(a.v, b.v), 6) AS similarity FROM t a JOIN t b ON a.vec_id < b.vec_id)
SELECT within, count(*) AS n, round(avg(similarity), 6) AS mean, round(CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(similarity) END, 6) AS std,
{', '.join(f'round(quantile_cont(similarity, {q}), 6) AS {n}' for q, n in ((0.05, 'q05'), (0.25, 'q25'), (0.5, 'median'), (0.75, 'q75'), (0.95, 'q95')))} FROM d GROUP BY within"""


@query("pair_geometry", _HIST)
def pair_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.weighted_describe(G.pair_similarities(passages(spark, sf_dir), "vec_id", "label", "vector"), ["within"])


@query("group_distance", f"""WITH {VECTORS} SELECT count(*) AS n, round(avg(1 - round(list_dot_product(a.v, b.v), 6)), 6) AS mean, round(min(1 - round(list_dot_product(a.v, b.v), 6)), 6) AS low,
round(max(1 - round(list_dot_product(a.v, b.v), 6)), 6) AS high FROM t a, t b WHERE a.label = 0 AND b.label = 1""")  # fmt: skip
def group_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = passages(spark, sf_dir)
    d = 1 - F.col("similarity")
    h = G.cross_similarities(p.filter("label = 0"), p.filter("label = 1"))
    mean = F.sum(d * F.col("n")) / F.sum("n")
    return h.agg(F.sum("n").alias("n"), F.round(mean, 6).alias("mean"), F.round(F.min(d), 6).alias("low"), F.round(F.max(d), 6).alias("high"))


_NEAREST = f"""WITH {VECTORS}, d AS (SELECT a.vec_id, a.label, b.vec_id AS neighbour, b.label AS other, round(list_dot_product(a.v, b.v), 6) AS similarity FROM t a JOIN t b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour) AS rank FROM d)"""


@query("nearest_neighbours", f"{_NEAREST} SELECT vec_id, neighbour, similarity, rank FROM r WHERE rank <= 3")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.nearest(passages(spark, sf_dir), 3, "vec_id", "vector")


@query("nn_purity", f"{_NEAREST} SELECT label, count(*) AS n, round(avg((label = other)::INT), 6) AS purity FROM r WHERE rank = 1 GROUP BY label")
def nn_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = passages(spark, sf_dir)
    labels = p.select("vec_id", "label")
    best = G.nearest(p, 1, "vec_id", "vector").join(labels, "vec_id")
    best = best.join(labels.select(F.col("vec_id").alias("neighbour"), F.col("label").alias("other")), "neighbour")
    return best.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("label") == F.col("other")).cast("int")), 6).alias("purity"))


def _left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.leave_one_out(works(spark, sf_dir), "work_id", "label")


_PREDICTED = f"WITH {LEAVE_OUT}, r AS (SELECT work_id, label, other AS predicted, row_number() OVER (PARTITION BY work_id ORDER BY similarity DESC, other) AS k FROM lo)"


@query("loo_similarities", f"WITH {LEAVE_OUT} SELECT work_id, label, other, similarity FROM lo")
def loo_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _left_out(spark, sf_dir)


@query("loo_accuracy", f"{_PREDICTED} SELECT count(*) AS n, sum((label = predicted)::INT)::BIGINT AS correct, round(avg((label = predicted)::INT), 6) AS accuracy FROM r WHERE k = 1")
def loo_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = (F.col("label") == F.col("predicted")).cast("int")
    return G.predict(_left_out(spark, sf_dir), "work_id", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("correct"), F.round(F.avg(hit), 6).alias("accuracy"))


@query("loo_confusion", f"{_PREDICTED} SELECT label, predicted, count(*) AS n FROM r WHERE k = 1 GROUP BY label, predicted")
def loo_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.predict(_left_out(spark, sf_dir), "work_id", "label").groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))


@query("opposite_margin", f"""WITH {LEAVE_OUT}, m AS (SELECT work_id, label, max(similarity) FILTER (other = label) AS own, max(similarity) FILTER (other <> label) AS best_other FROM lo GROUP BY ALL)
SELECT work_id, label, own, best_other, round(own - best_other, 6) AS margin FROM m WHERE own IS NOT NULL ORDER BY margin, work_id LIMIT 20""")  # fmt: skip
def opposite_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most ambiguous works: a report of that length."""
    return G.margins(_left_out(spark, sf_dir), "work_id", "label").orderBy("margin", "work_id").limit(20)


@query("crossfit_axis", f"""WITH {WORKS}, f AS (SELECT * FROM w WHERE label IN (0, 1)), g AS (SELECT label AS side, pos, sum(x) AS gx FROM f GROUP BY ALL),
c AS (SELECT f.work_id, f.label, f.pos, f.x, side, gx - CASE WHEN f.label = side THEN f.x ELSE 0 END AS c FROM f JOIN g ON g.pos = f.pos),
n AS (SELECT work_id, side, sqrt(sum(c * c)) AS n FROM c GROUP BY ALL),
d AS (SELECT c.work_id, c.label, c.pos, any_value(c.x) AS x, sum(CASE WHEN c.side = 0 THEN c.c / n.n ELSE -c.c / n.n END) AS d FROM c JOIN n ON n.work_id = c.work_id AND n.side = c.side GROUP BY ALL),
r AS (SELECT work_id, label, round(sum(x * d) / sqrt(sum(d * d)), 6) AS score FROM d GROUP BY ALL)
SELECT work_id, label, score, CASE WHEN score >= 0 THEN 0 ELSE 1 END AS predicted FROM r""")  # fmt: skip
def crossfit_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cross_fitted(works(spark, sf_dir), "work_id", "label", 0, 1)


_FOLDS = WORKS + """, f AS (SELECT * FROM w WHERE label IN (0, 1)), g AS (SELECT label AS side, pos, sum(x) AS gx FROM f GROUP BY ALL),
c AS (SELECT f.work_id, f.label, f.pos, f.x, side, gx - CASE WHEN f.label = side THEN f.x ELSE 0 END AS c FROM f JOIN g ON g.pos = f.pos), n AS (SELECT work_id, side, sqrt(sum(c * c)) AS n FROM c GROUP BY ALL),
d AS (SELECT c.work_id, c.label, c.pos, any_value(c.x) AS x, sum(CASE WHEN c.side = 0 THEN c.c / n.n ELSE -c.c / n.n END) AS d FROM c JOIN n ON n.work_id = c.work_id AND n.side = c.side GROUP BY ALL),
a AS (SELECT work_id, list(d ORDER BY pos) AS axis, sqrt(sum(d * d)) AS size FROM d GROUP BY work_id)"""


@query("crossfit_prompts", f"""WITH {_FOLDS}, s2 AS (SELECT prompt_id, round(list_dot_product(a.axis, pv) / size, 6) AS score FROM a, p)
SELECT prompt_id, count(*) AS folds, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, round(median(score), 6) AS median, min(score) AS least, max(score) AS most FROM s2 GROUP BY prompt_id""")
def crossfit_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prompt on the axis of every fold."""
    axes = G.fold_axes(works(spark, sf_dir), "work_id", "label", 0, 1)
    s = G.against_few(axes, prompts(spark, sf_dir), "work_id", "axis", "prompt_id", "prompt_vector")
    rows = s.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("folds"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_samp("score"), 6).alias("std"), F.min("score").alias("least"), F.max("score").alias("most"))
    medians = ranks.quantiles(s, ["prompt_id"], "score", (0.5,)).select("prompt_id", F.round(F.col("q")[0], 6).alias("median"))
    return rows.join(medians, "prompt_id").select("prompt_id", "folds", "mean", "std", "median", "least", "most")


@query("crossfit_passages", f"WITH {_FOLDS} SELECT t.work_id, t.label, vec_id, round(list_dot_product(axis, v) / size, 6) AS score FROM t JOIN a ON a.work_id = t.work_id")
def crossfit_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage on the axis of the fold that leaves its work out."""
    axes = G.fold_axes(works(spark, sf_dir), "work_id", "label", 0, 1).select("work_id", "axis")
    return passages(spark, sf_dir).join(axes, "work_id").select("work_id", "label", "vec_id", F.round(dot(F.col("vector"), F.col("axis")), 6).alias("score"))


@query("stratum_measures", f"""WITH {VECTORS}, o AS (SELECT vec_id % 4 AS stratum, label, work_id, v FROM t WHERE NOT (vec_id % 4 = 3 AND label = 1)), ol AS (SELECT stratum, label, work_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM o),
m AS (SELECT stratum, label, work_id, pos, avg(x) AS x FROM ol GROUP BY ALL), z AS (SELECT stratum, work_id, sqrt(sum(x * x)) AS z FROM m GROUP BY ALL),
w AS MATERIALIZED (SELECT m.stratum, label, m.work_id, list(x / z ORDER BY pos) AS u FROM m JOIN z ON z.stratum = m.stratum AND z.work_id = m.work_id GROUP BY ALL),
able AS (SELECT stratum FROM w GROUP BY stratum HAVING bool_or(label = 0) AND bool_or(label = 1)),
pr AS (SELECT x.stratum, x.label = y.label AS same, list_dot_product(x.u, y.u) AS s FROM w x JOIN w y ON x.stratum = y.stratum AND x.work_id < y.work_id),
ps AS (SELECT stratum, avg(s) FILTER (same) AS wi, avg(s) FILTER (NOT same) AS be FROM pr GROUP BY stratum),
h AS (SELECT x.stratum, x.work_id, x.label, side.side, (SELECT list(t ORDER BY pos) FROM (SELECT pos, sum(e) AS t FROM (SELECT unnest(y.u) AS e, generate_subscripts(y.u, 1) AS pos FROM w y WHERE y.stratum = x.stratum AND y.label = side.side AND y.work_id <> x.work_id) GROUP BY pos)) AS c, x.u FROM w x, (SELECT unnest([0, 1]) AS side) side WHERE x.label IN (0, 1)),
hs AS (SELECT stratum, work_id, label, max(round(list_dot_product(u, c) / sqrt(list_dot_product(c, c)), 9)) FILTER (side = label) AS own, max(round(list_dot_product(u, c) / sqrt(list_dot_product(c, c)), 9)) FILTER (side <> label) AS other FROM h GROUP BY ALL),
hn AS (SELECT stratum, count(*) FILTER (own IS NOT NULL) AS held_out, count(*) FILTER (own > other) AS nearer FROM hs GROUP BY stratum),
ce AS (SELECT stratum, label, list(t ORDER BY pos) AS c FROM (SELECT stratum, label, pos, sum(e) AS t FROM (SELECT stratum, label, unnest(u) AS e, generate_subscripts(u, 1) AS pos FROM w WHERE label IN (0, 1)) GROUP BY ALL) GROUP BY ALL)
SELECT w.stratum, count(*) AS units, count(*) FILTER (w.label = 0) AS units_a, count(*) FILTER (w.label = 1) AS units_b, round(any_value(list_dot_product(a.c, b.c) / sqrt(list_dot_product(a.c, a.c) * list_dot_product(b.c, b.c))), 6) AS centroid_similarity,
round(any_value(wi), 6) AS within_mean, round(any_value(be), 6) AS between_mean, round(any_value(wi - be), 6) AS difference, any_value(held_out) AS held_out, any_value(nearer) AS nearer
FROM w JOIN able ON able.stratum = w.stratum JOIN ps ON ps.stratum = w.stratum JOIN hn ON hn.stratum = w.stratum JOIN ce a ON a.stratum = w.stratum AND a.label = 0 JOIN ce b ON b.stratum = w.stratum AND b.label = 1 GROUP BY w.stratum""")
def stratum_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works of each stratum; the last stratum lacks a group and is skipped."""
    p = passages(spark, sf_dir).withColumn("stratum", F.col("vec_id") % 4).filter("not (stratum = 3 and label = 1)")
    w = G.mean_vectors(p, ["stratum", "label", "work_id"], "vector").drop("n")
    return G.stratum_measures(w, "stratum", "label", 0, 1)


@query("stratum_sensitivity", f"""WITH {VECTORS}, tl AS (SELECT vec_id % 2 AS stratum, vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM t WHERE label IN (0, 1)),
c AS (SELECT stratum, label, pos, avg(x) AS x FROM tl GROUP BY ALL), n AS (SELECT stratum, label, sqrt(sum(x * x)) AS n FROM c GROUP BY ALL)
SELECT a.stratum, round(sum(a.x * b.x) / any_value(na.n * nb.n), 6) AS similarity FROM c a JOIN c b ON a.stratum = b.stratum AND a.pos = b.pos AND a.label = 0 AND b.label = 1
JOIN n na ON na.stratum = a.stratum AND na.label = 0 JOIN n nb ON nb.stratum = a.stratum AND nb.label = 1 GROUP BY a.stratum""")  # fmt: skip
def stratum_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = passages(spark, sf_dir).filter("label in (0, 1)").withColumn("stratum", F.col("vec_id") % 2)
    c = G.mean_vectors(p, ["stratum", "label"], "vector")
    a = c.filter("label = 0").select("stratum", F.col("vector").alias("va"))
    b = c.filter("label = 1").select("stratum", F.col("vector").alias("vb"))
    return a.join(b, "stratum").select("stratum", F.round(dot(F.col("va"), F.col("vb")), 6).alias("similarity"))


_WORK_SCORES = WORKS + """,
q AS (SELECT prompt_id, unnest(pv) AS y, generate_subscripts(pv, 1) AS pos FROM p),
ws AS (SELECT prompt_id, label, work_id, round(sum(x * y), 6) AS similarity FROM w JOIN q USING (pos) GROUP BY ALL)"""


def work_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prompt with every work's mean vector."""
    return G.similarity_to(works(spark, sf_dir), prompts(spark, sf_dir), F.col("vector"), F.col("prompt_vector")).select("prompt_id", "label", "work_id", "similarity")


@query("prompt_work_rank", f"""WITH {_WORK_SCORES} SELECT prompt_id, work_id, similarity, row_number() OVER (PARTITION BY prompt_id ORDER BY similarity DESC, work_id) AS rank,
round((rank() OVER (PARTITION BY prompt_id ORDER BY similarity) + (count(*) OVER (PARTITION BY prompt_id, similarity) - 1) / 2.0) / count(*) OVER (PARTITION BY prompt_id), 6) AS percentile FROM ws""")  # fmt: skip
def prompt_work_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranks.with_average_rank(work_scores(spark, sf_dir), ["prompt_id"], "similarity", "mean_rank", "total")
    rows = ranks.numbered_within(rows, ["prompt_id"], [F.desc("similarity"), F.col("work_id")], "rank")
    return rows.select("prompt_id", "work_id", "similarity", "rank", F.round(F.col("mean_rank") / F.col("total"), 6).alias("percentile"))


@query("prompt_work_z", f"""WITH {_WORK_SCORES} SELECT prompt_id, work_id,
round((similarity - avg(similarity) OVER (PARTITION BY prompt_id)) / nullif(stddev_samp(similarity) OVER (PARTITION BY prompt_id), 0), 4) AS z,
round((similarity - avg(similarity) OVER (PARTITION BY prompt_id, label)) / nullif(stddev_samp(similarity) OVER (PARTITION BY prompt_id, label), 0), 4) AS group_z FROM ws""")  # fmt: skip
def prompt_work_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = work_scores(spark, sf_dir)
    for keys, name in ((["prompt_id"], "z"), (["prompt_id", "label"], "group_z")):  # moments combine before they move
        moments = rows.groupBy(*keys).agg(F.avg("similarity").alias("__m"), F.stddev_samp("similarity").alias("__s"))
        rows = rows.join(moments, keys).withColumn(name, F.round((F.col("similarity") - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0)), 4)).drop("__m", "__s")
    return rows.select("prompt_id", "work_id", "z", "group_z")


@query("outlier_works", f"""WITH {_WORK_SCORES}, z AS (SELECT prompt_id, work_id, round((similarity - avg(similarity) OVER (PARTITION BY prompt_id)) / nullif(stddev_samp(similarity) OVER (PARTITION BY prompt_id), 0), 4) AS z FROM ws)
SELECT prompt_id, work_id, z FROM z WHERE z >= 1.5""")  # fmt: skip
def outlier_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompt_work_z(spark, sf_dir).select("prompt_id", "work_id", "z").filter("z >= 1.5")


@query("prompt_top_passages", f"""WITH {_WORK_SCORES}, b AS (SELECT prompt_id, work_id, row_number() OVER (PARTITION BY prompt_id ORDER BY similarity DESC, work_id) AS work_rank FROM ws),
j AS (SELECT s.prompt_id, s.work_id, work_rank, vec_id, similarity, row_number() OVER (PARTITION BY s.prompt_id, s.work_id ORDER BY similarity DESC, vec_id) AS passage_rank
FROM s JOIN b ON b.prompt_id = s.prompt_id AND b.work_id = s.work_id AND work_rank <= 3)
SELECT * FROM j WHERE passage_rank <= 2""")  # fmt: skip
def prompt_top_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("prompt_id").orderBy(F.desc("similarity"), "work_id")
    best = work_scores(spark, sf_dir).withColumn("work_rank", row_number(w)).filter("work_rank <= 3").select("prompt_id", "work_id", "work_rank")
    rows = scores(spark, sf_dir).join(best, ["prompt_id", "work_id"])
    inner = Window.partitionBy("prompt_id", "work_id").orderBy(F.desc("similarity"), "vec_id")
    return rows.withColumn("passage_rank", row_number(inner)).filter("passage_rank <= 2").select("prompt_id", "work_id", "work_rank", "vec_id", "similarity", "passage_rank")


@query("cross_group_pairs", f"""WITH {WORKS}, d AS (SELECT a.label AS label_a, b.label AS label_b, a.work_id AS work_a, b.work_id AS work_b, round(sum(a.x * b.x), 6) AS similarity
FROM w a JOIN w b ON a.pos = b.pos AND a.label < b.label GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY label_a, label_b ORDER BY similarity DESC, work_a, work_b) AS rank FROM d QUALIFY rank <= 5""")  # fmt: skip
def cross_group_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = G.top_across(works(spark, sf_dir), "label", "work_id", 5)
    return d.select(F.col("group_a").cast("int").alias("label_a"), F.col("group_b").cast("int").alias("label_b"), F.col("item_a").alias("work_a"), F.col("item_b").alias("work_b"), "similarity", "rank")


@query("two_centroid_proximity", f"""WITH {_CENTROIDS}, r AS (SELECT vec_id, tl.label, round(sum(tl.x * k.x) FILTER (k.label = 0), 6) AS to_a, round(sum(tl.x * k.x) FILTER (k.label = 1), 6) AS to_b
FROM tl JOIN k ON k.pos = tl.pos AND k.label IN (0, 1) GROUP BY ALL)
SELECT label, count(*) AS n, round(avg(to_a - to_b), 6) AS mean_difference, round(max(to_a - to_b), 6) AS max_difference FROM r GROUP BY label""")  # fmt: skip
def two_centroid_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = passages(spark, sf_dir)
    c = G.mean_vectors(p, ["label"], "vector").filter("label in (0, 1)").select(F.col("label").alias("side"), F.col("vector").alias("cv"))
    r = G.similarity_to(p, c, F.col("vector"), F.col("cv")).groupBy("vec_id", "label").agg(
        F.max(F.when(F.col("side") == 0, F.col("similarity"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("similarity"))).alias("b")
    )
    d = F.col("a") - F.col("b")
    # means of six-digit values are often ties of the seventh digit, which a sum in any order of rows would settle by chance
    mean = F.round(F.avg(d.cast("decimal(38,20)")), 6).cast("double")
    return r.groupBy("label").agg(F.count(F.lit(1)).alias("n"), mean.alias("mean_difference"), F.round(F.max(d), 6).alias("max_difference"))


@query("vector_diagnostics", """WITH n AS (SELECT label, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)
SELECT label, count(*) AS n, count(*) FILTER (len(v) = 64 AND n > 0 AND isfinite(n)) AS sound, round(min(n), 5) AS low, round(max(n), 5) AS high, round(avg(n), 5) AS mean FROM n GROUP BY label""")
def vector_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", "embedding", norm(F.col("embedding")).alias("x"))
    return e.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_sound(F.col("embedding"), 64)).alias("sound"), F.round(F.min("x"), 5).alias("low"),
        F.round(F.max("x"), 5).alias("high"), F.round(F.avg("x"), 5).alias("mean"),
    )


@query("duplicate_vectors", "SELECT min(vec_id) AS first_id, count(*) AS n FROM embeddings GROUP BY embedding HAVING count(*) > 1")
def duplicate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal whole vectors; none in the shared tables."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return e.groupBy("v").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("first_id", "n")


@query("work_summary", """WITH d AS (SELECT label * 1000 + vec_id % 5 AS work_id, vec_id, vec_id % 7 AS movement, vec_id % 3 AS kind FROM embeddings WHERE vec_id >= 10),
m AS (SELECT work_id, kind, row_number() OVER (PARTITION BY work_id ORDER BY count(*) DESC, kind) AS k FROM d GROUP BY work_id, kind)
SELECT d.work_id::BIGINT AS work_id, count(*) AS n, count(DISTINCT movement) AS movements, any_value(m.kind) AS mode_kind, string_agg(DISTINCT movement::VARCHAR, ';' ORDER BY movement::VARCHAR) AS movement_list
FROM d JOIN m ON m.work_id = d.work_id AND m.k = 1 GROUP BY d.work_id""")
def work_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = passages(spark, sf_dir).select("work_id", (F.col("vec_id") % 7).alias("movement"), (F.col("vec_id") % 3).alias("kind"))
    return d.groupBy("work_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("movement").alias("movements"), F.mode("kind", True).alias("mode_kind"),
        F.array_join(F.array_sort(F.collect_set(F.col("movement").cast("string"))), ";").alias("movement_list"),
    )


@query("group_prompt_summary", f"""WITH {VECTORS} SELECT label, prompt_id, count(*) AS n, count(DISTINCT work_id) AS n_works, round(avg(similarity), 6) AS mean, round(stddev_samp(similarity), 6) AS std,
round(median(similarity), 6) AS median FROM s GROUP BY label, prompt_id""")  # fmt: skip
def group_prompt_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, x = scores(spark, sf_dir), F.col("similarity")
    rows = s.groupBy("label", "prompt_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("work_id").alias("n_works"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_samp(x), 6).alias("std"))
    medians = ranks.quantiles(s, ["label", "prompt_id"], "similarity", (0.5,))
    return rows.join(medians, ["label", "prompt_id"]).select(*rows.columns, F.round(F.col("q")[0], 6).alias("median"))


@query("score_audio_match", f"""WITH {VECTORS} SELECT a.vec_id AS score_id, b.vec_id AS audio_id, a.work_id, round(list_dot_product(a.v, b.v), 6) AS similarity
FROM t a JOIN t b ON a.work_id = b.work_id AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1""")  # fmt: skip
def score_audio_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = vectors(spark, sf_dir).filter("vec_id >= 10")
    a, b = (p.filter(f"vec_id % 2 = {side}").withColumnRenamed("vec_id", name) for side, name in ((0, "score_id"), (1, "audio_id")))
    return G.matched(a, b, "work_id", "score_id", "audio_id")
