"""How the shared tables stand for the roles of the analytics: a fixed, synthetic assignment without meaning.

``embeddings`` holds passages and, for ``vec_id`` below ten, prompts. A passage's group is its label, its work one of
five per label. A prompt's axis is ``vec_id div 2``, its pole the parity and its family ``vec_id % 3``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.vectors import unit
from lodestar.operators.geometry import mean_vectors, similarity_to
from lodestar.plans.catalog import table

PROMPTS = 10


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, work_id, vector) with unit vectors."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", (F.col("label") * 1000 + F.col("vec_id") % 5).cast("long").alias("work_id"), unit(F.col("embedding")).alias("vector"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).filter(F.col("vec_id") >= PROMPTS)


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = vectors(spark, sf_dir).filter(F.col("vec_id") < PROMPTS)
    return p.select(
        F.col("vec_id").alias("prompt_id"), F.floor(F.col("vec_id") / 2).alias("axis"),
        F.when(F.col("vec_id") % 2 == 0, "positive").otherwise("negative").alias("pole"), (F.col("vec_id") % 3).alias("family"),
        F.col("vector").alias("prompt_vector"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage with every prompt and their similarity."""
    return similarity_to(passages(spark, sf_dir), prompts(spark, sf_dir), F.col("vector"), F.col("prompt_vector")).drop("vector", "prompt_vector")


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, work_id, vector, n): the unit mean vector of each work's passages."""
    return mean_vectors(passages(spark, sf_dir), ["label", "work_id"], "vector")


#: SQL of the same relations, as common table expressions.
VECTORS = """e0 AS (SELECT vec_id, label, (label * 1000 + vec_id % 5)::BIGINT AS work_id, embedding::DOUBLE[] AS v FROM embeddings),
e AS (SELECT vec_id, label, work_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e0),
t AS (SELECT * FROM e WHERE vec_id >= 10),
p AS (SELECT vec_id AS prompt_id, vec_id // 2 AS axis, CASE WHEN vec_id % 2 = 0 THEN 'positive' ELSE 'negative' END AS pole, vec_id % 3 AS family, v AS pv FROM e WHERE vec_id < 10),
s AS (SELECT vec_id, label, work_id, prompt_id, axis, pole, family, round(list_dot_product(v, pv), 6) AS similarity FROM t, p)"""

#: Long tables: t_long (passages), works w(label, work_id, pos, x) of unit length.
WORKS = VECTORS + """,
tl AS (SELECT vec_id, label, work_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM t),
w0 AS (SELECT label, work_id, pos, avg(x) AS x FROM tl GROUP BY ALL),
wn AS (SELECT work_id, sqrt(sum(x * x)) AS n FROM w0 GROUP BY work_id),
w AS (SELECT label, w0.work_id, pos, x / n AS x FROM w0 JOIN wn ON wn.work_id = w0.work_id)"""

#: Leave-one-out: lo(work_id, label, other, similarity).
LEAVE_OUT = WORKS + """,
g AS (SELECT label AS other, pos, sum(x) AS gx, count(*) AS gn FROM w GROUP BY ALL),
c0 AS (SELECT work_id, label, other, pos, x, gx - CASE WHEN label = other THEN x ELSE 0 END AS c, gn FROM w JOIN g USING (pos)),
lo AS (SELECT work_id, label, other, round(sum(x * c) / sqrt(sum(c * c)), 6) AS similarity FROM c0 WHERE label <> other OR gn > 1 GROUP BY ALL)"""
