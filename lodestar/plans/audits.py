"""Queries of gates, classifications, validation, overrides and pooling; parts stand for scores, embeddings for chunks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.operators import adapter, audit, filters, stats, windows
from lodestar.operators.catalogue import first_by
from lodestar.plans.catalog import query, table
from lodestar.plans.inference import _EXACT, BOOTSTRAPS, _CONTRAST, _UNITS, units
from lodestar.plans.mapping import VECTORS, vectors


@query("family_filter", """SELECT o_orderpriority, count(*) AS n FROM orders WHERE lower(CASE o_orderpriority WHEN '1-URGENT' THEN 'Emotion' WHEN '2-HIGH' THEN 'literal' ELSE 'other' END) = 'emotion' GROUP BY o_orderpriority""")
def family_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = F.when(F.col("o_orderpriority") == "1-URGENT", "Emotion").when(F.col("o_orderpriority") == "2-HIGH", "literal").otherwise("other")
    return table(spark, sf_dir, "orders").filter(filters.of_family(family, "emotional")).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("authorized_rows", "SELECT c_custkey FROM customer WHERE lower(trim(c_mktsegment)) IN ('building', 'machinery')")
def authorized_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter(filters.rights_authorized(F.col("c_mktsegment"), [" Building", "MACHINERY"])).select("c_custkey")


@query("discovery_gate", """SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#22', 'Brand#33') AND p_size % 2 = 0 AND p_partkey % 5 > 0 AND p_partkey % 7 > 0 AND p_partkey % 3 < 2 AND p_partkey % 11 > 0
AND NOT contains(lower(p_name), 'red') AND NOT contains(lower(p_name), 'blue')""")
def discovery_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = lambda c: F.when(c, "True").otherwise("False")
    p = F.col("p_partkey")
    gate = filters.discovery_gate(
        F.col("p_brand"), ["Brand#11", "Brand#22", "Brand#33"], F.when(F.col("p_size") % 2 == 0, "wanted").otherwise("other"), "wanted", flag(p % 5 > 0), flag(p % 7 == 0),
        F.when(p % 3 == 2, "corrupted").otherwise("good"), ["low quality", "corrupted"], F.when(p % 11 > 0, "a.xml").otherwise(""),
    )
    return table(spark, sf_dir, "part").filter(gate & ~filters.excluded_title(F.col("p_name"), ["Red", "blue"])).select("p_partkey")


@query("item_types", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'score' WHEN 1 THEN 'recording_audio' WHEN 2 THEN 'passage_midi' WHEN 3 THEN 'passage_symbolic' WHEN 4 THEN 'audio' ELSE 'unknown' END AS item_type,
CASE p_partkey % 6 WHEN 0 THEN 'symbolic' WHEN 1 THEN 'audio' WHEN 2 THEN 'passages_symbolic' WHEN 3 THEN 'passages_symbolic' WHEN 4 THEN 'passages_audio' ELSE 'performance' END AS kind,
CASE p_size % 4 WHEN 0 THEN 'complete_movement' WHEN 1 THEN 'fixed_bar_window' WHEN 2 THEN NULL ELSE 'user_range' END AS method, CASE WHEN p_size % 4 = 1 THEN 8 END::INT AS bars FROM part""")
def item_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda c, values: F.element_at(F.array(*[F.lit(v) for v in values]), (c + 1).cast("int"))
    k = F.col("p_partkey") % 6
    stage, path = of(k, ["symbolic", "audio", "passages_symbolic", "passages_symbolic", "", ""]), of(k, ["s", "a", "p", "p", "passages/audio", "x/performance"])
    spec = filters.method_spec(of(F.col("p_size") % 4, ["complete", "8", "odd", "user"]))
    return table(spark, sf_dir, "part").select(
        "p_partkey", filters.item_type(stage, F.when(k == 2, "midi").otherwise(""), path).alias("item_type"), filters.artifact_kind(stage, path).alias("kind"),
        spec["method"].alias("method"), spec["bars"].alias("bars"),
    )


@query("inventory_scope", """WITH r AS (SELECT p_type, p_brand, CASE p_size % 3 WHEN 0 THEN 'fixed_16_bars' WHEN 1 THEN 'fixed_8_bars' ELSE 'fixed_8_bars_stride_4' END AS method FROM part), m AS (SELECT DISTINCT p_type, CASE method WHEN 'fixed_16_bars' THEN '16' WHEN 'fixed_8_bars' THEN '8' ELSE method END AS m FROM r)
SELECT a.p_type, window_modes, composer_scope FROM (SELECT p_type, string_agg(m, ',' ORDER BY length(m), m) AS window_modes FROM m GROUP BY p_type) a JOIN (SELECT p_type, string_agg(p_brand || '=' || n, '; ' ORDER BY p_brand) AS composer_scope FROM (SELECT p_type, p_brand, count(*) AS n FROM r GROUP BY ALL) GROUP BY p_type) b ON a.p_type = b.p_type""")
def inventory_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = F.when(F.col("p_size") % 3 == 0, "fixed_16_bars").when(F.col("p_size") % 3 == 1, "fixed_8_bars").otherwise("fixed_8_bars_stride_4")
    return filters.inventory(table(spark, sf_dir, "part").withColumn("method", method), ["p_type"], "p_brand", "method")


_SOURCES = """CASE WHEN p % 13 = 0 THEN 'performance_midi' ELSE 'score' END AS material, CASE p % 8 WHEN 0 THEN '' WHEN 1 THEN 'a/b.mid' WHEN 2 THEN 'a/b.pdf' WHEN 3 THEN 'a/b' WHEN 4 THEN '../b.xml' ELSE 'a/b.mxl' END AS path,
CASE WHEN p % 16 = 0 THEN 'x/y.midi' ELSE '' END AS midi, p % 9 > 0 AS there, CASE WHEN p % 10 = 0 THEN 'x' ELSE (p % 7)::VARCHAR END AS low, (p % 7 + p % 4 - 1)::VARCHAR AS high"""


@query("classified_sources", f"""WITH r AS (SELECT {_SOURCES} FROM (SELECT p_partkey AS p FROM part)), c AS (SELECT *, CASE WHEN path <> '' THEN path ELSE midi END AS source FROM r),
k AS (SELECT CASE WHEN material = 'performance_midi' THEN 'unsupported/unsupported_midi_source' WHEN source = '' THEN 'failure/missing_source_path' WHEN source LIKE '%.mid' OR source LIKE '%.midi' THEN 'unsupported/unsupported_midi_source'
WHEN source NOT LIKE '%.xml' AND source NOT LIKE '%.mxl' THEN 'unsupported/unsupported_source' WHEN source LIKE '../%' THEN 'failure/invalid_source_path' WHEN NOT there THEN 'missing/missing_source'
WHEN low = 'x' OR low::VARCHAR = '0' OR TRY_CAST(high AS INT) < TRY_CAST(low AS INT) THEN 'failure/invalid_bar_coordinates' ELSE 'ok/' END AS k FROM c)
SELECT split_part(k, '/', 1) AS category, split_part(k, '/', 2) AS error_category, count(*) AS n FROM k GROUP BY ALL""")
def classified_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    path = F.element_at(F.array(*[F.lit(x) for x in ("", "a/b.mid", "a/b.pdf", "a/b", "../b.xml", "a/b.mxl", "a/b.mxl", "a/b.mxl")]), (p % 8 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(
        F.when(p % 13 == 0, "performance_midi").otherwise("score").alias("material"), path.alias("score_path"), F.lit("").alias("source_path_given"), F.when(p % 16 == 0, "x/y.midi").otherwise("").alias("midi_path"),
        (p % 9 > 0).alias("there"), F.when(p % 10 == 0, "x").otherwise((p % 7).cast("string")).alias("low"), (p % 7 + p % 4 - 1).cast("string").alias("high"),
    )
    got = filters.classified_sources(rows, "material", ["source_path_given", "score_path"], "midi_path", "there", "low", "high")
    return got.groupBy("category", "error_category").agg(F.count(F.lit(1)).alias("n"))


_SCORES = """s AS (SELECT p_partkey AS id, p_partkey % 400 AS work_id, concat('a/', p_partkey, CASE p_partkey % 6 WHEN 0 THEN '.mxl' WHEN 1 THEN '.xml' WHEN 2 THEN '.musicxml' WHEN 3 THEN '.mid' WHEN 4 THEN '.pdf' ELSE '.mxl' END) AS path, p_brand AS dataset, p_size AS measures FROM part),
r AS (SELECT *, CASE WHEN id % 6 = 4 THEN 'unsupported_score_format' WHEN id % 7 = 0 THEN 'score_file_missing' WHEN id % 11 = 0 THEN 'score_sha256_mismatch' WHEN id % 17 = 0 THEN 'not a score' WHEN measures < 4 THEN 'too_few_measures:' || measures ELSE '' END AS reason FROM s)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in (".mxl", ".xml", ".musicxml", ".mid", ".pdf", ".mxl")]), (p % 6 + 1).cast("int"))
    s = table(spark, sf_dir, "part").select(
        p.alias("score_version_id"), (p % 400).alias("work_id"), F.concat(F.lit("a/"), p.cast("string"), kind).alias("source_file_path"), F.col("p_brand").alias("source_dataset"), F.col("p_size").alias("measures"),
        (p % 7 > 0).alias("file_exists"), F.when(p % 2 == 1, F.sha2(p.cast("string"), 256)).when(p % 11 == 0, F.sha2(p.cast("string"), 256)).otherwise("").alias("sha256"),
        F.when(p % 11 == 0, "other").otherwise(F.sha2(p.cast("string"), 256)).alias("found_sha256"), F.when(p % 17 == 0, "not a score").otherwise("").alias("parse_error"),
    )
    works = spark.range(400).select(F.col("id").alias("work_id"), F.concat(F.lit("Work "), F.col("id").cast("string")).alias("title"), (F.col("id") % 20).alias("composition_id"))
    compositions = spark.range(20).select(F.col("id").alias("composition_id"), F.lit("Chopin").alias("composer"), F.lit("C").alias("title"))
    return filters.score_candidates(s, works, compositions, 4)


@query("candidate_reasons", f"WITH {_SCORES} SELECT reason, count(*) AS n FROM r GROUP BY reason")
def candidate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("selected_scores", f"""WITH {_SCORES}, o AS (SELECT work_id, id, path, row_number() OVER (PARTITION BY work_id ORDER BY CASE id % 6 WHEN 2 THEN 0 WHEN 1 THEN 1 WHEN 0 THEN 2 WHEN 5 THEN 2 ELSE 3 END, dataset, path) AS k FROM r WHERE reason = '')
SELECT work_id, id AS score_version_id, path AS source_file_path, 'Work ' || work_id AS title FROM o WHERE k = 1""")
def selected_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One score of each work: the preferred format, then dataset and path."""
    usable = _candidates(spark, sf_dir).filter("reason = ''")
    best = first_by(usable, ["work_id"], [filters.format_priority(F.col("source_file_path")), "source_dataset", "source_file_path"])
    return best.select("work_id", "score_version_id", "source_file_path", "title")


_MANIFEST = """r AS (SELECT p_partkey AS id, 'Manufacturer#' || (least(p_partkey % 7, 2) + 1) AS g, CASE WHEN p_partkey % 7 = 1 AND p_partkey % 5 > 0 THEN 'one' ELSE p_brand END AS work, p_partkey // 2 * 2 + (p_partkey % 100 > 0)::INT * (p_partkey % 2) AS path, (p_partkey % 97 > 0)::INT AS size, 1 AS low, 8 AS high, 8 + (p_partkey % 31 = 0)::INT * 3 AS measures FROM part),
w AS (SELECT g, work, count(*) AS n FROM r GROUP BY ALL), k AS (SELECT g, sum(n) AS n, count(*) AS works, max(n) AS most FROM w GROUP BY g)"""


@query("dataset_validation", f"""WITH {_MANIFEST} SELECT 'error' AS severity, 'shared source file' AS rule, path::VARCHAR AS subject, count(*)::DOUBLE AS value FROM r GROUP BY path HAVING count(*) > 1 UNION ALL SELECT 'error', 'empty source file', id::VARCHAR, 0 FROM r WHERE size = 0
UNION ALL SELECT 'error', 'group is absent', 'Manufacturer#9', 0 UNION ALL SELECT 'error', 'group is not configured', g, n FROM k WHERE g NOT IN ('Manufacturer#1', 'Manufacturer#2', 'Manufacturer#9') UNION ALL SELECT 'error', 'fewer than two works', g, works FROM k WHERE works < 2
UNION ALL SELECT 'warning', 'groups are unbalanced', '', round(max(n) / min(n), 6) FROM k HAVING count(*) > 1 AND max(n) / min(n) > 1.5 UNION ALL SELECT 'warning', 'one work dominates', g, round(most / n, 6) FROM k WHERE most / n > 0.5
UNION ALL SELECT 'warning', 'measures differ from the range', id::VARCHAR, abs(measures - 8) FROM r WHERE abs(measures - 8) > 1""")
def dataset_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    work = F.when((p % 7 == 1) & (p % 5 > 0), "one").otherwise(F.col("p_brand"))
    rows = table(spark, sf_dir, "part").select(
        p.alias("id"), F.concat(F.lit("Manufacturer#"), (F.least(p % 7, F.lit(2)) + 1).cast("string")).alias("g"), work.alias("work"), (F.floor(p / 2) * 2 + F.when(p % 100 > 0, p % 2).otherwise(0)).cast("long").alias("path"), (p % 97 > 0).cast("int").alias("size"),
        F.lit(1).alias("low"), F.lit(8).alias("high"), (8 + F.when(p % 31 == 0, 3).otherwise(0)).alias("measures"),
    )
    return audit.validation(rows, ["Manufacturer#1", "Manufacturer#2", "Manufacturer#9"], "g", "work", "path", "size", "id", "low", "high", "measures")


@query("corpus_readiness", """WITH r AS (SELECT p_partkey AS p, p_partkey % 40 AS comp, p_partkey % 80 AS mv, p_partkey % 90 AS rec, p_partkey % 3 > 0 AS has_audio, p_partkey % 7 > 0 AS audio, p_partkey % 5 > 0 AS sym, p_partkey % 4 > 0 AS ok, p_partkey % 6 > 0 AS cov FROM part)
SELECT unnest(['rows', 'compositions', 'works', 'movements', 'recordings', 'symbolic_ready', 'missing_symbolic_paths', 'local_audio', 'missing_audio_paths', 'authorized_audio', 'unauthorized_audio', 'fully_aligned', 'alignment_gaps', 'shared_audio_paths', 'shared_symbolic_paths', 'several_recordings']) AS metric,
unnest([count(*), count(DISTINCT comp), count(DISTINCT mv), count(DISTINCT mv), count(DISTINCT rec), count(*) FILTER (sym), count(*) FILTER (NOT sym), count(*) FILTER (has_audio AND audio), count(*) FILTER (has_audio AND NOT audio), count(*) FILTER (has_audio AND audio AND ok), count(*) FILTER (has_audio AND audio AND NOT ok),
count(*) FILTER (has_audio AND audio AND ok AND cov), count(*) FILTER (has_audio AND audio AND ok AND NOT cov), (SELECT count(*) FROM (SELECT p % 50 FROM r WHERE has_audio GROUP BY p % 50 HAVING count(DISTINCT rec) > 1)), (SELECT count(*) FROM (SELECT p % 60 FROM r GROUP BY p % 60 HAVING count(DISTINCT mv) > 1)),
(SELECT count(*) FROM (SELECT comp FROM r GROUP BY comp HAVING count(DISTINCT rec) > 1))]) AS value FROM r""")
def corpus_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    rows = table(spark, sf_dir, "part").select(
        name("i", p).alias("passage_id"), name("c", p % 40).alias("composition_id"), name("w", p % 80).alias("work_id"), name("m", p % 80).alias("movement_id"), name("r", p % 90).alias("recording_id"),
        F.when(p % 3 > 0, name("a", p % 50)).otherwise("").alias("audio_path"), (p % 7 > 0).alias("audio_exists"), name("s", p % 60).alias("mxl_path"), F.lit("").alias("score_path"), F.lit("").alias("midi_path"),
        (p % 5 > 0).alias("symbolic_exists"), F.when(p % 4 > 0, " Licensed").otherwise("unknown").alias("rights_status"), (p % 6 > 0).alias("covered"),
    )
    return audit.readiness(rows, ["licensed"], F.col("covered"))


@query("override_problems", """WITH o AS (SELECT p_partkey AS p, CASE WHEN p_partkey % 31 = 0 THEN p_partkey - 1 ELSE p_partkey END AS k, CASE WHEN p_partkey % 19 = 0 THEN '' ELSE 'sha' || (CASE WHEN p_partkey % 31 = 0 THEN p_partkey - 1 ELSE p_partkey END) END AS sha FROM part),
t AS (SELECT sha, count(*) AS times FROM o GROUP BY sha),
x AS (SELECT o.sha AS sha256, CASE WHEN o.sha = '' THEN 'the digest is missing' WHEN times > 1 THEN 'the digest occurs twice' WHEN p % 23 = 0 THEN 'the reason is missing' WHEN p % 29 = 0 THEN 'the evidence is missing' WHEN g.p_partkey IS NULL THEN 'no such group'
WHEN p % 3 = 0 AND 300 + g.p_size % 4 <> 300 THEN 'the catalogue number contradicts the evidence' WHEN p % 3 = 1 AND 2 + g.p_size % 5 <> 2 THEN 'the movement contradicts the evidence' END AS problem
FROM o JOIN t ON t.sha = o.sha LEFT JOIN part g ON g.p_partkey = k AND g.p_partkey % 7 > 0) SELECT DISTINCT sha256, problem FROM x WHERE problem IS NOT NULL""")
def override_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An override of every part; six of seven parts are groups, with the evidence of their size."""
    p = F.col("p_partkey")
    parts = table(spark, sf_dir, "part")
    o = parts.select(
        F.when(p % 19 == 0, "").otherwise(F.concat(F.lit("SHA"), F.when(p % 31 == 0, p - 1).otherwise(p).cast("string"))).alias("sha256"), F.when(p % 23 == 0, " ").otherwise("r").alias("reason"), F.when(p % 29 == 0, "").otherwise("e").alias("evidence"),
        F.when(p % 3 == 0, "K. 300").otherwise("").alias("resolved_catalogue"), F.when(p % 3 == 1, "II").otherwise("").alias("resolved_movement"),
    )
    g = parts.filter(p % 7 > 0).select(F.concat(F.lit("sha"), p.cast("string")).alias("sha256"), F.array((F.col("p_size") % 4 + 300).cast("string")).alias("numbers"), F.array((F.col("p_size") % 5 + 2).cast("string")).alias("movements"))
    return audit.override_problems(o, g)


@query("representative_problems", """SELECT DISTINCT 'w' || (p_partkey % 300) AS work_key, CASE WHEN p_partkey % 5 = 0 THEN 'the reason is missing' WHEN p_partkey % 300 >= 200 THEN 'no such work' ELSE 'the digest is not in the group' END AS problem FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 300 >= 200 OR p_partkey % 2 = 1""")
def representative_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    o = table(spark, sf_dir, "part").select(F.concat(F.lit("w"), (p % 300).cast("string")).alias("work_key"), F.when(p % 2 == 0, "A").otherwise("b").alias("sha256"), F.when(p % 5 == 0, "").otherwise("r").alias("reason"), F.lit("e").alias("evidence"))
    members = spark.range(200).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("work_key"), F.lit("a").alias("sha256"))
    return audit.representative_problems(o, members)


@query("found_versions", """WITH s AS (SELECT p_partkey AS p, p_partkey % 10 AS work_id, 'sha' || p_partkey AS sha256, '/a/' || p_partkey || '.xml' AS path FROM part) SELECT p, CASE WHEN p % 3 = 0 THEN NULL WHEN p % 4 = 0 AND p % 8 > 0 THEN NULL ELSE p * 2 END AS score_version_id FROM s""")
def found_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p")
    s = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), (F.col("p_partkey") % 10).alias("work_id"), F.concat(F.lit("sha"), F.col("p_partkey").cast("string")).alias("sha256"), F.concat(F.lit("/a/"), F.col("p_partkey").cast("string"), F.lit(".xml")).alias("path"))
    v = s.filter(p % 3 > 0).select("work_id", F.when(p % 8 == 0, "").when(p % 4 == 0, "other").otherwise(F.upper("sha256")).alias("sha256"), F.substring("path", 2, 100).alias("source_file_path"), (p * 2).alias("score_version_id"))
    again = v.withColumn("score_version_id", F.col("score_version_id") + 1)
    return audit.found_version(s, v.unionByName(again)).select("p", "score_version_id")


@query("recording_pooling", f"""WITH {VECTORS}, c AS (SELECT vec_id, vec_id % 200 AS rec, CASE WHEN vec_id % 37 > 0 THEN v END AS v FROM e), st AS (SELECT rec, count(*) FILTER (v IS NULL) AS missing FROM c GROUP BY rec)
SELECT st.rec, CASE WHEN missing = 0 THEN 'success' ELSE 'failed' END AS status, missing, CASE WHEN missing = 0 THEN round(avg(v[1]), 6) END AS first_value FROM st JOIN c ON c.rec = st.rec GROUP BY st.rec, missing""")
def recording_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    items = v.select((F.col("vec_id") % 200).alias("rec"), "vec_id")
    got = audit.pooled(items, v.filter("vec_id % 37 > 0").select("vec_id", F.col("vector").alias("embedding")), "rec", "vec_id")
    return got.select("rec", "status", "missing", F.round(F.col("vector")[0], 6).alias("first_value"))


def _letters(payloads):
    """A stand-in for a model: how many bytes, and the first; it refuses texts that begin with a digit's neighbour."""
    if any(p[:1] == b"A" for p in payloads):
        raise ValueError("refused")
    return [np.array([len(p), p[0] if p else 0], float) for p in payloads]


@query("embedded_items", """SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 OR p_type[1] = 'E' THEN 'failed' ELSE 'success' END AS status, CASE WHEN p_partkey % 10 = 0 THEN 'no payload' WHEN p_type[1] = 'E' THEN 'ValueError: refused' END AS error,
CASE WHEN p_partkey % 10 > 0 AND p_type[1] <> 'E' THEN length(p_type)::DOUBLE END AS size FROM part""")
def embedded_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model hook with a model that refuses some items: the others of their batches succeed."""
    t = F.when(F.col("p_type").startswith("E"), F.concat(F.lit("A"), F.col("p_type"))).otherwise(F.col("p_type"))
    items = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 10 > 0, t).alias("payload"))
    return audit.embedded(items, "p_partkey", "payload", _letters).select("p_partkey", "status", "error", F.col("vector")[0].alias("size"))


@query("note_timings", """WITH b AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS measure, l_quantity AS q, l_tax AS confidence, l_returnflag = 'N' AS odd FROM lineitem), t AS (SELECT *, sum(q * 0.5) OVER (PARTITION BY l_orderkey ORDER BY measure ROWS UNBOUNDED PRECEDING) AS fin, q * 0.5 AS len FROM b),
a AS (SELECT l_orderkey, count(*) AS n, min(confidence) AS confidence, min(fin - len) AS x FROM t WHERE NOT odd GROUP BY l_orderkey), o AS (SELECT t.l_orderkey, measure, least(greatest(1.25 * (fin - len) + 2, 0), 80) AS lo, least(greatest(1.25 * fin + 2, 0), 80) AS hi, n, a.confidence FROM t JOIN a ON a.l_orderkey = t.l_orderkey)
SELECT l_orderkey, measure, round(lo, 6) AS onset_seconds, round(hi, 6) AS offset_seconds, round(confidence, 6) AS confidence FROM o WHERE n > 1 AND hi > lo""")
def note_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures at the times of a performance: its notes lie on a line, so the SQL is that line."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    b = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(w).cast("long").alias("measure"), F.col("l_quantity").cast("double").alias("quarters"), F.lit(None).cast("double").alias("tempo"), F.col("l_tax").alias("confidence"), "l_returnflag")
    m = adapter.tempo_times(b, ["l_orderkey"], "measure", "quarters", "tempo")
    notes = m.select("l_orderkey", F.col("start_seconds").alias("score_onset"), (1.25 * F.col("start_seconds") + 2).alias("performance_onset"), "confidence", F.when(F.col("l_returnflag") == "N", "unmatched").otherwise(" Matched").alias("mapping_state"))
    got = windows.note_timings(m.select("l_orderkey", "measure", "start_seconds", "end_seconds"), notes, ["l_orderkey"], F.lit(80.0))
    return got.select("l_orderkey", "measure", *[F.round(c, 6).alias(c) for c in ("onset_seconds", "offset_seconds", "confidence")])


@query("permutation_test", f"""WITH {_EXACT} SELECT prompt_id, round(p, 6) AS p_value, divisions AS tested, 'exact' AS method FROM x""")
def permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.permutation_test(units(spark, sf_dir), ["prompt_id"], "work_id", "label", 0, 1, "x", 10_000)


@query("sampled_permutation_test", f"""WITH {_UNITS}, r AS (SELECT *, unnest(range(0, 201)) AS r FROM v),
o AS (SELECT *, row_number() OVER (PARTITION BY prompt_id, r ORDER BY concat('0x', substr(md5(concat(r, ':', work_id)), 1, 8))::BIGINT, work_id) <= count(*) FILTER (label = 0) OVER (PARTITION BY prompt_id, r) AS side FROM r),
m AS (SELECT prompt_id, r, CASE WHEN r = 0 THEN abs(avg(x) FILTER (label = 0) - avg(x) FILTER (label = 1)) ELSE abs(avg(x) FILTER (side) - avg(x) FILTER (NOT side)) END AS d FROM o GROUP BY prompt_id, r),
z AS (SELECT *, max(d) FILTER (r = 0) OVER (PARTITION BY prompt_id) AS seen FROM m)
SELECT prompt_id, round((count(*) FILTER (d >= seen - 1e-12) + 1) / 201, 6) AS p_value, 200::BIGINT AS tested, 'monte_carlo' AS method FROM z WHERE r > 0 GROUP BY prompt_id""")
def sampled_permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With 200 rounds there are more divisions (252) than rounds, so they are sampled."""
    return stats.permutation_test(units(spark, sf_dir), ["prompt_id"], "work_id", "label", 0, 1, "x", 200)


_DRAWN = f"""k2 AS (SELECT prompt_id, label, list(x ORDER BY work_id) AS u FROM v GROUP BY ALL), b2 AS (SELECT *, unnest(range(1, {BOOTSTRAPS + 1})) AS r FROM k2),
m2 AS (SELECT prompt_id, label, r, list_sum(list_transform(range(1, len(u) + 1), lambda i: u[(concat('0x', substr(md5(concat(r, ':', label, ':', i)), 1, 8))::BIGINT % len(u) + 1)])) / len(u) AS m FROM b2),
d2 AS (SELECT prompt_id, r, max(m) FILTER (label = 0) - max(m) FILTER (label = 1) AS d FROM m2 GROUP BY ALL), ci AS (SELECT prompt_id, round(quantile_cont(d, 0.025), 6) AS ci_low, round(quantile_cont(d, 0.975), 6) AS ci_high FROM d2 GROUP BY prompt_id)"""


@query("work_contrasts", f"""WITH {_EXACT}{_CONTRAST}, {_DRAWN}, r AS (SELECT prompt_id, round(p, 6) AS p_value, divisions FROM x), o AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p_value) AS i FROM r),
q2 AS (SELECT prompt_id, p_value, divisions, round(min(least(1.0, p_value * m / i)) OVER (ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS q_value FROM o)
SELECT c.prompt_id, 'ok' AS status, '' AS reason, n_a, n_b, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(ma - mb, 6) AS difference, ci_low, ci_high, round((1 - 3.0 / (4 * (n_a + n_b) - 9)) * (ma - mb) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)), 6) AS hedges_g,
p_value, divisions AS tested, 'exact' AS method, q_value FROM c JOIN ci ON ci.prompt_id = c.prompt_id JOIN q2 ON q2.prompt_id = c.prompt_id
UNION ALL SELECT 99, 'skipped', 'fewer than two units on a side', 1, 0, round(min(x), 6), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM v WHERE prompt_id = 0 AND label = 0""")
def work_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prompt between two groups, with interval, effect size, test and false discovery rate; and one without enough works."""
    u = units(spark, sf_dir)
    lone = u.filter("prompt_id = 0 and label = 0").orderBy("x").limit(1).withColumn("prompt_id", F.lit(99).cast("long"))
    return stats.contrasts(u.unionByName(lone.select(*u.columns)), ["prompt_id"], "work_id", "label", 0, 1, "x", BOOTSTRAPS, 10_000)
