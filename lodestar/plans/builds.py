"""Queries of composed builds: an adapter and its supplement, the report of a study, cached extraction, table digests.

Orders stand for the rows of an export, their lines for the measures of an alignment, customers for works and scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.operators import build as B
from lodestar.operators import digests, embedding, extraction
from lodestar.plans.catalog import query, table
from lodestar.plans.mapping import VECTORS, scores
from lodestar.sources.versions import Store
from lodestar.sources.workspace import materialize, new_path

_COMPOSER = "CASE o_orderpriority WHEN '1-URGENT' THEN 'Frédéric CHOPIN' WHEN '2-HIGH' THEN 'w. a. mozart' ELSE o_orderpriority END"
_ORDERS = """o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS p, o_orderstatus AS s FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) AND o_custkey IN (SELECT c_custkey FROM customer)),
x AS (SELECT *, CASE p WHEN '1-URGENT' THEN 'Chopin' WHEN '2-HIGH' THEN 'Mozart' ELSE p END AS composer, CASE WHEN s = 'P' THEN 'row is not marked eligible_for_clap' WHEN k % 5 = 0 THEN 'score_path is a metadata locator rather than MusicXML/MXL/MIDI' END AS reason,
CASE WHEN k % 2 = 0 THEN 'synthetic_rendering' ELSE 'source_recording' END AS audio_origin FROM o)"""


def _key(prefix: str, c: str, end: str = ""):
    return F.concat(F.lit(prefix), F.col(c).cast("string"), F.lit(end))


def export(spark: SparkSession, sf_dir: str, keep: bool = True) -> DataFrame:
    lines, people = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    k = F.col("o_orderkey")
    # an export that is read many times keeps its few columns; the texts are made of them wherever it is read
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    orders = orders.join(lines.distinct(), "o_orderkey", "left_semi").join(people, "o_custkey", "left_semi")
    orders = materialize(orders, "export") if keep else orders
    return orders.select(
        k.alias("row"), _key("row_", "o_orderkey").alias("export_row_id"), F.expr(_COMPOSER).alias("composer"), F.when(F.col("o_orderstatus") != "P", " True").otherwise("no").alias("eligible_for_clap"),
        F.when(k % 5 == 0, "imslp.org/123").otherwise(_key("scores/", "o_custkey", ".MXL")).alias("score_path"), _key("audio/", "o_orderkey", ".wav").alias("audio_path"), F.lit("data/events.csv").alias("alignment_path"),
        _key("cmp_", "o_custkey").alias("composition_id"), _key("wrk_", "o_custkey").alias("work_id"), _key("scv_", "o_custkey").alias("score_version_id"), _key("prf_", "o_orderkey").alias("performance_id"),
        _key("rec_", "o_orderkey").alias("recording_id"), _key("aln_", "o_orderkey").alias("alignment_id"), F.element_at(F.array(F.lit("CC-BY 4.0"), F.lit("ask first"), F.lit("MIT")), (k % 3 + 1).cast("int")).alias("licenses"),
        F.when(k % 7 == 0, "Partial").otherwise("full").alias("alignment_quality"), F.when(k % 2 == 0, "1").otherwise("0").alias("synthetic_audio"), F.lit("").alias("original_source_dataset"), F.lit("").alias("performance_midi_path"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> B.Corpus:
    people, orders, lines = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    sha = lambda c: F.sha2(F.col(c).cast("string"), 256)
    # lines are dealt out by the id that the build joins them by
    none, line = F.lit(None).cast("double"), Window.partitionBy("alignment_id").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    files = people.select(_key("scores/", "c_custkey", ".MXL").alias("path"), sha("c_custkey").alias("sha256"), none.alias("seconds"))
    files = files.unionByName(orders.select(_key("audio/", "o_orderkey", ".wav").alias("path"), F.upper(sha("o_orderkey")).alias("sha256"), (10_000 + F.col("o_orderkey") % 7).cast("double").alias("seconds")))
    files = files.unionByName(spark.createDataFrame([(p,) for p in ("data/events.csv", "data/canonical/alignment_events.csv")], "path string").select("path", F.lit("").alias("sha256"), none.alias("seconds")))
    return B.Corpus(
        works=people.select(_key("wrk_", "c_custkey").alias("work_id"), F.col("c_name").alias("title")), scores=people.select(_key("scv_", "c_custkey").alias("score_version_id"), sha("c_custkey").alias("sha256")),
        recordings=orders.select(_key("rec_", "o_orderkey").alias("recording_id"), sha("o_orderkey").alias("sha256"), F.lit("set").alias("source_dataset")),
        alignments=orders.select(_key("aln_", "o_orderkey").alias("alignment_id"), F.lit("Beat").alias("granularity"), F.lit("dtw").alias("method"), sha("o_custkey").alias("sha256")),
        events=lines.withColumn("alignment_id", _key("aln_", "l_orderkey")).withColumn("m", F.row_number().over(line)).select("alignment_id", F.col("m").alias("measure_index"), (F.col("m") * 60 + F.col("l_quantity")).alias("performance_time_sec"), (1 - F.col("l_discount")).alias("confidence")),
        assets=files,
    )


def published(rows: DataFrame, tables: B.Corpus, composers: list[str] | None = None) -> Store:
    """A store with the build of the whole export, or of some composers."""
    store = Store(rows.sparkSession, new_path(rows.sparkSession, "adapter"))
    B.publish(store, B.build(rows, tables, composers), inputs={"export": rows})
    return store


_TIMES = _ORDERS + """, e AS (SELECT k, m, m * 60 + q AS t, f FROM (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS m, l_quantity AS q, 1 - l_discount AS f FROM lineitem)),
d AS (SELECT k, t - lag(t) OVER (PARTITION BY k ORDER BY t) AS step FROM (SELECT DISTINCT k, t FROM e)), h AS (SELECT k, median(step) AS half FROM d WHERE step > 0 GROUP BY k),
f AS (SELECT k, m, min(t) AS onset, max(t) AS late, min(f) AS f FROM e GROUP BY k, m),
t AS (SELECT f.k, m, onset, f, coalesce(lead(onset) OVER w, least(greatest(max(late) OVER (PARTITION BY f.k) + coalesce(half, 0.5), onset + 0.001), 10000 + f.k % 7)) AS until FROM f LEFT JOIN h ON h.k = f.k WINDOW w AS (PARTITION BY f.k ORDER BY m)),
u AS (SELECT k, count(*) AS bars, max(until) AS ends, min(f) AS confidence FROM t GROUP BY k)"""


@query("adapter_passages", f"""WITH {_TIMES} SELECT 'row_' || x.k AS passage_id, composer, CASE composer WHEN 'Chopin' THEN 'Romantic' WHEN 'Mozart' THEN 'Classical' ELSE '' END AS period, 'scores/' || c || '.MXL' AS mxl_path, 'mxl' AS score_format, bars::INT AS bar_end,
CASE x.k % 3 WHEN 1 THEN 'license_review_required' ELSE 'licensed_for_research' END AS rights_status, CASE WHEN x.k % 7 = 0 THEN 'false' ELSE 'true' END AS fully_aligned, audio_origin, c_name AS work_title, round(ends, 6) AS ends, round(confidence, 6) AS confidence
FROM x JOIN u ON u.k = x.k JOIN customer ON c_custkey = c WHERE reason IS NULL""")
def adapter_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = published(export(spark, sf_dir), corpus(spark, sf_dir))
    times = store.read("measures").groupBy("recording_id").agg(F.round(F.max("offset_seconds"), 6).alias("ends"), F.round(F.min("confidence"), 6).alias("confidence"))
    rows = store.read("passages").join(times, "recording_id")
    return rows.select("passage_id", "composer", "period", "mxl_path", "score_format", "bar_end", "rights_status", "fully_aligned", "audio_origin", "work_title", "ends", "confidence")


@query("adapter_issues", f"WITH {_ORDERS} SELECT k AS row, 'rec_' || k AS recording_id, reason FROM x WHERE reason IS NOT NULL")
def adapter_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(export(spark, sf_dir), corpus(spark, sf_dir)).read("issues")


@query("adapter_cohorts", f"""WITH {_ORDERS} SELECT composer, audio_origin, 'beat' AS alignment_granularity, count(*) AS recording_count, count(DISTINCT c) AS composition_count, count(DISTINCT c) AS work_count FROM x WHERE reason IS NULL AND composer IN ('Chopin', 'Mozart') GROUP BY composer, audio_origin""")
def adapter_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(export(spark, sf_dir), corpus(spark, sf_dir), ["Chopin", "MOZART"]).read("cohorts")


@query("adapter_supplement", f"""WITH {_ORDERS}, r AS (SELECT k, k % 9 > 0 AS sound FROM x WHERE k % 4 < 2),
n AS (SELECT (SELECT count(*) FROM x WHERE reason IS NULL AND composer = 'Chopin') AS base, count(*) AS offered, count(*) FILTER (sound) AS added FROM r)
SELECT 1 AS run, offered, added, offered - added AS unmatched, base + added AS total FROM n UNION ALL SELECT 2, offered - added, 0, offered - added, base + added FROM n""")
def adapter_supplement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renders of half of the orders, some of which do not have the digest they claim; the second run finds nothing new."""
    rows, tables = export(spark, sf_dir), corpus(spark, sf_dir)
    store = published(rows, tables, ["chopin"])
    k = F.col("row")
    renders = rows.filter(k % 4 < 2).select(
        F.concat(F.lit("rec_r"), k.cast("string")).alias("output_recording_id"), F.col("audio_path").alias("output_audio_path"), F.when(k % 9 > 0, F.sha2(k.cast("string"), 256)).otherwise("0" * 64).alias("output_sha256"),
        "performance_id", "work_id", "score_version_id", "alignment_id", F.concat(F.lit("scores/"), F.substring("work_id", 5, 20), F.lit(".MXL")).alias("score_path"),
        F.lit("").alias("alignment_quality"), F.lit("").alias("source_dataset"), F.lit("").alias("work_title"), F.lit("").alias("source_midi_path"),
    )
    got = []
    for run in (1, 2):
        n = B.supplement(store, renders, rows, tables)
        got.append((run, n["offered"], n["added"], n["unmatched"], n["total"]))
    return spark.createDataFrame(got, "run int, offered long, added long, unmatched long, total long")


_REPORT = _ORDERS + """, m AS (SELECT 'p' || k AS passage_id, composer, c AS work, k AS recording, CASE WHEN k % 3 = 1 THEN 'no' ELSE 'Yes ' END AS rights, audio_origin, CASE WHEN k % 11 = 0 THEN '' ELSE 'audio/' || (k - k % 4) || '.wav' END AS audio, k % 6 > 0 AS audio_there,
CASE WHEN k % 10 = 0 THEN '../' || c ELSE 'scores/' || c || '.mxl' END AS symbolic, c % 8 > 0 AS symbolic_there, k % 13 > 0 AS covered FROM x),
a AS (SELECT *, audio <> '' AND (recording - recording % 4) % 6 > 0 AS local, symbolic_there AND recording % 10 > 0 AS ready, trim(rights) = 'Yes' AS allowed FROM m),
n AS (SELECT count(*) AS rows, count(DISTINCT work) AS compositions, count(DISTINCT work) AS works, count(DISTINCT work) AS movements, count(DISTINCT recording) AS recordings, count(*) FILTER (ready) AS symbolic_ready, count(*) FILTER (NOT ready) AS missing_symbolic_paths,
count(*) FILTER (local) AS local_audio, count(*) FILTER (audio <> '' AND NOT local) AS missing_audio_paths, count(*) FILTER (local AND allowed) AS authorized_audio, count(*) FILTER (local AND NOT allowed) AS unauthorized_audio, count(*) FILTER (local AND allowed AND covered) AS fully_aligned,
count(*) FILTER (local AND allowed AND NOT covered) AS alignment_gaps, count(*) FILTER (recording % 10 = 0) AS invalid_symbolic_paths, 0::BIGINT AS invalid_audio_paths FROM a),
z AS (SELECT 'counters' AS section, name, value FROM (UNPIVOT n ON COLUMNS(*) INTO NAME name VALUE value)
UNION ALL SELECT 'composer counts', composer, count(*) FROM a GROUP BY composer UNION ALL SELECT 'rights_status counts', trim(rights), count(*) FROM a GROUP BY ALL UNION ALL SELECT 'audio_origin counts', audio_origin, count(*) FROM a GROUP BY ALL
UNION ALL SELECT 'score_format counts', 'mxl', count(*) FROM a HAVING count(*) > 0 UNION ALL SELECT 'alignment_format counts', '', count(*) FROM a HAVING count(*) > 0
UNION ALL SELECT 'cohort recordings', audio_origin || '|' || composer, count(DISTINCT recording) FROM a GROUP BY ALL
UNION ALL SELECT 'shared audio paths', audio, count(DISTINCT recording) FROM a WHERE audio <> '' GROUP BY audio HAVING count(DISTINCT recording) > 1
UNION ALL SELECT 'several recordings', work::VARCHAR, count(DISTINCT recording) FROM a GROUP BY work HAVING count(DISTINCT recording) > 1
UNION ALL SELECT 'symbolic conflicts', work || '|composer', count(DISTINCT composer) FROM a GROUP BY work HAVING count(DISTINCT composer) > 1
UNION ALL SELECT 'symbolic conflicts', work || '|mxl_path', count(DISTINCT symbolic) FROM a GROUP BY work HAVING count(DISTINCT symbolic) > 1),
y AS (SELECT *, CASE WHEN section = 'counters' AND name = 'invalid_symbolic_paths' AND value > 0 THEN 'error' WHEN section IN ('symbolic conflicts', 'shared audio paths') OR section = 'counters' AND value > 0 AND name IN ('missing_symbolic_paths', 'missing_audio_paths', 'unauthorized_audio', 'alignment_gaps') THEN 'warning' ELSE 'ok' END AS status FROM z)"""


@query("study_report", f"WITH {_REPORT} SELECT * FROM y UNION ALL SELECT 'status', 'overall', count(*) FILTER (status <> 'ok'), CASE WHEN bool_or(status = 'error') THEN 'error' WHEN bool_or(status = 'warning') THEN 'warning' ELSE 'ok' END FROM y")
def study_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counters, conflicts and the overall status of a manifest made of the export."""
    e, k = export(spark, sf_dir, keep=False), F.col("row")
    work = F.substring("work_id", 5, 20)
    rows = e.select(
        F.concat(F.lit("p"), k.cast("string")).alias("passage_id"), B.composer(F.col("composer")).alias("composer"), work.alias("composition_id"), work.alias("work_id"), work.alias("movement_id"), k.cast("string").alias("recording_id"),
        F.when(k % 3 == 1, "no").otherwise("Yes ").alias("rights_status"), F.when(k % 2 == 0, "synthetic_rendering").otherwise("source_recording").alias("audio_origin"),
        F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("audio/"), (k - k % 4).cast("string"), F.lit(".wav"))).alias("audio_path"),
        F.when(k % 10 == 0, F.concat(F.lit("../"), work)).otherwise(F.concat(F.lit("scores/"), work, F.lit(".mxl"))).alias("mxl_path"), F.lit("").alias("score_path"), F.lit("").alias("midi_path"),
        F.lit("mxl").alias("score_format"), F.lit("").alias("alignment_format"), (k % 13 > 0).alias("covered"),
    )
    there = table(spark, sf_dir, "customer").filter("c_custkey % 8 > 0").select(F.concat(F.lit("scores/"), F.col("c_custkey").cast("string"), F.lit(".mxl")).alias("path"))
    # as many files as there are quadruples of orders, wanted or not; those of one quadruple lie together in the table
    audio = table(spark, sf_dir, "orders").select((F.col("o_orderkey") - F.col("o_orderkey") % 4).alias("n")).filter("n % 6 > 0").select(F.concat(F.lit("audio/"), F.col("n").cast("string"), F.lit(".wav")).alias("path"))
    return B.report(rows, there.unionByName(audio), ["YES"], F.col("covered"))


@query("feature_cache", """WITH d AS (SELECT doc_id, doc_id % 17 = 0 AS unread, coalesce(text, '') AS t, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS n FROM documents),
g AS (SELECT t, n FROM d WHERE NOT unread GROUP BY t, n), c AS (SELECT count(*) AS digests, count(*) FILTER (n >= 30) AS good FROM g),
s AS (SELECT count(*) AS selected, count(*) FILTER (unread) AS unreadable, count(*) FILTER (NOT unread AND n >= 30) AS succeeded, count(*) FILTER (unread OR n < 30) AS failed FROM d)
SELECT run, selected, unreadable, digests, CASE run WHEN 2 THEN 0 WHEN 3 THEN digests - good ELSE digests END AS computed, CASE run WHEN 1 THEN good WHEN 4 THEN good ELSE 0 END AS computed_well, succeeded, failed FROM s, c, (SELECT unnest([1, 2, 3, 4]) AS run) r""")
def feature_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four runs over one cache: all is new; all is known; failures are tried again; another version of the extractor."""
    docs, text = table(spark, sf_dir, "documents"), F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.sha2(text, 256).alias("digest"), text.alias("payload"), F.when(F.col("doc_id") % 17 == 0, "the source is missing").alias("problem"))

    def counts(df: DataFrame) -> DataFrame:
        words = F.size(F.array_remove(F.split("payload", "[\\x20\\x09-\\x0D]+"), ""))
        short = words < 30
        return df.select("digest", F.when(~short, F.array(words, F.length("payload"))).alias("features"), F.when(short, "too few words").alias("error"))

    store = Store(spark, new_path(spark, "features"))
    names = ("selected", "unreadable", "digests", "computed", "computed_well", "succeeded", "failed")
    runs = []
    for run, (version, retry) in enumerate((("1", False), ("1", False), ("1", True), ("2", False)), 1):
        got = extraction.extract(store, rows, "doc_id", version, counts, retry_failures=retry)
        runs.append((run, *[got.counts[c] for c in names]))
    return spark.createDataFrame(runs, "run int, " + ", ".join(f"{n} long" for n in names))


@query("table_differences", """SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN 'missing' ELSE 'changed' END AS side FROM customer WHERE c_custkey % 50 = 0 OR c_custkey % 37 = 0 UNION ALL SELECT c_custkey + 10000000, 'unexpected' FROM customer WHERE c_custkey % 41 = 0""")
def table_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table against itself with rows taken out, changed and put in; equal partitions are not joined."""
    c = table(spark, sf_dir, "customer")
    changed = c.filter("c_custkey % 50 > 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 37 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    other = changed.unionByName(c.filter("c_custkey % 41 = 0").withColumn("c_custkey", F.col("c_custkey") + 10_000_000))
    return digests.differences(c, other, ["c_custkey"])


@query("similarity_problems", f"""WITH {VECTORS}, r AS (SELECT vec_id, prompt_id FROM s WHERE NOT (vec_id % 97 = 0 AND prompt_id = 3)), q AS (SELECT * FROM r UNION ALL SELECT * FROM r WHERE vec_id % 89 = 0 AND prompt_id = 5), m AS (SELECT count(*) AS m FROM t WHERE vec_id % 101 > 0),
n AS (SELECT 'rows without a passage' AS problem, count(*) AS n FROM q WHERE vec_id % 101 = 0 UNION ALL SELECT 'labels differ', count(*) FROM q WHERE vec_id % 101 > 0 AND vec_id % 53 = 0 UNION ALL SELECT 'values are not finite', count(*) FROM q WHERE vec_id % 61 = 0
UNION ALL SELECT 'rows of prompts that are not configured', count(*) FROM q WHERE prompt_id = 9 UNION ALL SELECT 'wording differs', count(*) FROM q WHERE prompt_id = 2 UNION ALL SELECT 'pairs that occur twice', count(*) FROM r WHERE vec_id % 89 = 0 AND prompt_id = 5
UNION ALL SELECT 'configured prompts without rows', 1 UNION ALL SELECT 'primary prompts without rows', 1 UNION ALL SELECT 'rows beside passages x prompts', abs((SELECT count(*) FROM q) - (SELECT m FROM m) * 10)) SELECT problem, n::BIGINT AS n FROM n WHERE n > 0""")
def similarity_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, p = F.col("vec_id"), F.col("prompt_id")
    s = scores(spark, sf_dir).filter(~((v % 97 == 0) & (p == 3)))
    s = s.unionByName(s.filter((v % 89 == 0) & (p == 5)))
    rows = s.select(v.alias("passage_id"), p.alias("prompt_id"), F.when(v % 53 == 0, -1).otherwise(F.col("label")).alias("composer"), F.when(p == 2, "other").otherwise(p.cast("string")).alias("prompt_text"), F.when(v % 61 == 0, float("nan")).otherwise(F.col("similarity")).alias("cosine_similarity"))
    manifest = table(spark, sf_dir, "embeddings").filter("vec_id >= 10 and vec_id % 101 > 0").select(v.alias("passage_id"), F.col("label").alias("composer"))
    configured = table(spark, sf_dir, "embeddings").filter("vec_id < 9 or vec_id = 10").select(v.alias("prompt_id"), v.cast("string").alias("prompt_text"))
    return digests.similarity_problems(rows, manifest, configured, [1, 10])


def _vowels():
    """Loads the stand-in of a model: how many of each vowel a payload holds, over its length."""

    def model(payloads):
        if any(b"zz" in p for p in payloads):
            raise ValueError("refused")
        return [[p.count(c) / len(p) for c in (b"a", b"e", b"i", b"o", b"u")] for p in payloads]

    return model


@query("embedding_stage", """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN doc_id % 19 = 0 THEN 'unsupported' WHEN text IS NULL OR text = '' THEN 'unavailable' ELSE 'pending' END AS state FROM documents),
g AS (SELECT t, min(doc_id) AS representative, bool_or(doc_id % 7 = 0) AS cached FROM d WHERE state = 'pending' GROUP BY t),
j AS (SELECT doc_id, state, representative, cached, d.t, contains(d.t, 'zz') AND NOT cached AS bad FROM d LEFT JOIN g ON g.t = d.t AND state = 'pending')
SELECT doc_id, CASE WHEN state <> 'pending' THEN state WHEN bad THEN 'failed' ELSE 'success' END AS status, representative, CASE WHEN state = 'pending' AND bad THEN 'ValueError: refused' ELSE '' END AS error_message,
CASE WHEN state <> 'pending' OR bad THEN '' WHEN cached THEN 'cache' WHEN doc_id = representative THEN 'computed' ELSE 'alias' END AS origin,
CASE WHEN state = 'pending' AND NOT bad THEN CASE WHEN cached THEN 7.0 ELSE round((strlen(t) - strlen(replace(t, 'e', ''))) / strlen(t)::DOUBLE, 6) END END AS second FROM j""")
def embedding_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through a stand-in model; a cache has some of them, and rows of another checkpoint that must not count."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    state = F.when(F.col("doc_id") % 19 == 0, "unsupported").when(F.col("text") == "", "unavailable").otherwise("pending")
    items = docs.select("doc_id", F.col("text").alias("payload"), state.alias("status"))
    some = items.filter("status = 'pending'").select(F.sha2("payload", 256).alias("digest"), F.lit("c2").alias("space"), F.when(F.col("doc_id") % 7 == 0, "v1").otherwise("v0").alias("checkpoint"), F.array(*[F.lit(7.0)] * 5).alias("embedding"))
    got = embedding.stage(items, "doc_id", "vowels", _vowels, some, {"space": "c2", "checkpoint": "v1"}, size=5)
    return got.select("doc_id", "status", "representative", "error_message", "origin", F.round(F.col("embedding")[1], 6).alias("second"))
