"""Queries of the path from catalogue tables to passages, and further statistics of clusterings and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.vectors import dot
from lodestar.operators import adapter as A
from lodestar.operators import decomposition, stats
from lodestar.operators.catalogue import numbered
from lodestar.plans.catalog import query, table
from lodestar.plans.mapping import VECTORS, passages, scores


@query("key_labels", f"""WITH f AS (SELECT p_partkey, p_size % 17 - 8 AS fifths, (['major', 'minor', ''])[p_partkey % 3 + 1] AS mode FROM part),
n AS (SELECT *, CASE WHEN abs(fifths) <= 7 THEN ({list(A.MAJOR_KEYS)})[fifths + 8] ELSE 'unknown' END AS a, CASE WHEN abs(fifths) <= 7 THEN ({list(A.MINOR_KEYS)})[fifths + 8] ELSE 'unknown' END AS b FROM f)
SELECT p_partkey, CASE mode WHEN 'major' THEN a || ' major' WHEN 'minor' THEN b || ' minor' ELSE a || ' major / ' || b || ' minor key signature' END AS key, CASE WHEN p_partkey % 2 = 0 THEN '3/4' ELSE 'unspecified meter' END AS meter FROM n""")
def key_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.element_at(F.array(F.lit("major"), F.lit("minor"), F.lit("")), (F.col("p_partkey") % 3 + 1).cast("int"))
    beats = F.when(F.col("p_partkey") % 2 == 0, "3")
    return table(spark, sf_dir, "part").select("p_partkey", A.key_label(F.col("p_size") % 17 - 8, mode).alias("key"), A.meter_label(beats, F.lit("4")).alias("meter"))


@query("movement_source", """WITH r AS (SELECT l_partkey, l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'a.mxl' ELSE '' END AS mxl, CASE WHEN l_linestatus = 'F' THEN 'b.pdf' ELSE '' END AS score, CASE WHEN l_linenumber % 2 = 0 THEN 'c.mid' ELSE '' END AS midi,
row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS k FROM lineitem), f AS (SELECT *, CASE WHEN l_partkey % 5 = 0 THEN 'd.mid' ELSE '' END AS d FROM r WHERE k = 1)
SELECT l_partkey, CASE WHEN mxl <> '' THEN mxl WHEN midi <> '' THEN midi WHEN d <> '' THEN d WHEN score <> '' THEN score ELSE '' END AS source_path,
CASE WHEN mxl <> '' OR midi <> '' OR d <> '' THEN 'pending' WHEN score <> '' THEN 'unsupported' ELSE 'unavailable' END AS availability FROM f""")
def movement_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = lambda c, v: F.when(c, v).otherwise("")
    rows = table(spark, sf_dir, "lineitem").withColumns({
        "mxl": when(F.col("l_returnflag") == "A", "a.mxl"), "score": when(F.col("l_linestatus") == "F", "b.pdf"), "midi": when(F.col("l_linenumber") % 2 == 0, "c.mid"),
        "none": F.lit(""), "default_midi": when(F.col("l_partkey") % 5 == 0, "d.mid"),
    })
    got = A.representative(rows, "l_partkey", ["l_shipdate", "l_orderkey", "l_linenumber"], ["mxl", "score", "midi"], ["none", "none", "default_midi"], [".mxl", ".mid"])
    return got.select("l_partkey", "source_path", "availability")


@query("tempo_times", """WITH b AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS measure, l_quantity AS quarters, CASE WHEN l_returnflag = 'R' THEN 60.0 + l_tax * 1000 END AS tempo FROM lineitem),
s AS (SELECT *, quarters * 60.0 / coalesce(last_value(tempo IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY measure ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 120.0) AS s FROM b)
SELECT l_orderkey, measure, round(sum(s) OVER w - s, 6) AS start_seconds, round(sum(s) OVER w, 6) AS end_seconds FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY measure ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def tempo_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    tempo = F.when(F.col("l_returnflag") == "R", 60.0 + F.col("l_tax") * 1000)
    b = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(w).cast("long").alias("measure"), F.col("l_quantity").alias("quarters"), tempo.alias("tempo"))
    t = A.tempo_times(b, ["l_orderkey"], "measure", "quarters", "tempo")
    return t.select("l_orderkey", "measure", F.round("start_seconds", 6).alias("start_seconds"), F.round("end_seconds", 6).alias("end_seconds"))


@query("eligibility", """SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_orderpriority <> '5-LOW' AND o_orderkey % 3 > 0 AND o_orderkey % 2 = 0 AND o_orderstatus <> 'P') AS eligible FROM orders GROUP BY o_orderstatus""")
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("o_orderkey") % 2 == 0, "a/b.wav").otherwise("a/b.txt")
    checked = F.when(F.col("o_orderkey") % 3 > 0, " Passed").otherwise("failed")
    ok = A.eligible(F.col("o_orderpriority") != "5-LOW", checked, F.col("o_orderstatus") != "P", path, [".wav", ".flac"])
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("eligible"))


@query("bundle_violations", """SELECT 'success without a vector' AS rule, count(*) AS n FROM embeddings WHERE vec_id % 9 = 0 UNION ALL SELECT 'failure with a vector', count(*) FROM embeddings WHERE vec_id % 10 = 1 AND vec_id % 9 > 0
UNION ALL SELECT 'state is unknown', count(*) FROM embeddings WHERE vec_id % 10 = 1 AND vec_id % 9 > 0""")
def bundle_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when((F.col("vec_id") % 10 == 1) & (F.col("vec_id") % 9 > 0), "odd").otherwise("success")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("item_id"), state.alias("status"), F.when(F.col("vec_id") % 9 > 0, F.col("embedding")).alias("embedding"))
    return A.bundle_violations(rows, "item_id", 64)


@query("rand_index", """WITH t AS (SELECT c_nationkey % 4 AS a, c_mktsegment AS b FROM customer), c AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT count(*) AS n FROM t GROUP BY a, b)), x AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT count(*) AS n FROM t GROUP BY a)),
y AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT count(*) AS n FROM t GROUP BY b)), n AS (SELECT count(*) * (count(*) - 1) / 2 AS v FROM t)
SELECT round((c.v - x.v * y.v / n.v) / ((x.v + y.v) / 2 - x.v * y.v / n.v), 6) AS rand_index FROM c, x, y, n""")
def rand_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decomposition.rand_index(table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 4).alias("a"), F.col("c_mktsegment").alias("b")), "a", "b")


#: Most pairs that are compared, the reference's default.
PAIRS = 100_000


@query("sampled_pairs", f"""WITH {VECTORS}, i AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM t), n AS (SELECT count(*) AS n FROM i), d AS (SELECT r, concat('0x', substr(md5('a:' || r), 1, 8))::BIGINT % n AS a, concat('0x', substr(md5('b:' || r), 1, 8))::BIGINT % (n - 1) AS b FROM range(0, {PAIRS}) q(r), n),
z AS (SELECT a, b + (b >= a)::INT AS b FROM d WHERE (SELECT n * (n - 1) // 2 FROM n) > {PAIRS} UNION ALL SELECT x.k, y.k FROM i x JOIN i y ON x.k < y.k WHERE (SELECT n * (n - 1) // 2 FROM n) <= {PAIRS}) SELECT x.label = y.label AS within, count(*) AS n, round(avg(list_dot_product(x.v, y.v)), 6) AS mean FROM z JOIN i x ON x.k = z.a JOIN i y ON y.k = z.b GROUP BY within""")
def sampled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarities of all pairs if there are at most :data:`PAIRS`, else of so many hashed pairs, the diagonal skipped: a
    sampling operator, reproducible in any engine."""
    p = passages(spark, sf_dir).select("vec_id", "label", "vector")
    n = p.count()
    i = numbered(p, ["vec_id"], "k")
    x = i.select(F.col("k").alias("a"), F.col("label").alias("la"), F.col("vector").alias("va"))
    y = i.select(F.col("k").alias("b"), F.col("label").alias("lb"), F.col("vector").alias("vb"))
    if n * (n - 1) // 2 <= PAIRS:
        pairs = x.join(y, F.col("a") < F.col("b"))
    else:
        r = spark.range(PAIRS).select(F.col("id").cast("string").alias("r"))
        a, b = stats.draw("a", F.col("r")) % n, stats.draw("b", F.col("r")) % (n - 1)
        d = r.select(a.alias("a"), b.alias("b0")).withColumn("b", F.col("b0") + (F.col("b0") >= F.col("a")).cast("int"))
        pairs = d.join(x, "a").join(y, "b")
    rows = pairs.select((F.col("la") == F.col("lb")).alias("within"), dot(F.col("va"), F.col("vb")).alias("s"))
    return rows.groupBy("within").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 6).alias("mean"))


@query("prompt_response_projection")
def prompt_response_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-normalised prompt similarities of passages, transposed, times their row-normalised component scores."""
    s = scores(spark, sf_dir).select("vec_id", "prompt_id", "similarity")
    c = decomposition.project(table(spark, sf_dir, "embeddings").filter("vec_id >= 10"), "vec_id", "embedding", 3)
    size = lambda df, v: df.groupBy("vec_id").agg(F.sqrt(F.sum(F.col(v) * F.col(v))).alias("size"))
    s = s.join(size(s, "similarity"), "vec_id").select("vec_id", "prompt_id", (F.col("similarity") / F.col("size")).alias("x"))
    c = c.join(size(c, "score"), "vec_id").select("vec_id", "component", (F.col("score") / F.col("size")).alias("y"))
    return s.join(c, "vec_id").groupBy("prompt_id", "component").agg(F.round(F.sum(F.col("x") * F.col("y")), 5).alias("projection"))
