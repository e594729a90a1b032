"""Queries that go through files: bundles, registries, text tables, streams. All write below the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.plans.catalog import query, table
from lodestar.plans.mapping import vectors
from lodestar.sources import bundles, tables
from lodestar.sources.workspace import new_path
from lodestar.streaming import registry


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return v.select(
        F.concat(F.lit("item_"), F.lpad(F.col("vec_id").cast("string"), 6, "0")).alias("item_id"), F.lit("passage").alias("item_type"), F.lit("c2").alias("model_space"),
        F.when(F.col("vec_id") % 2 == 0, "fixed_8_bars").otherwise("fixed_8_bars_stride_4").alias("passage_generation_method"), F.sha2(F.col("vec_id").cast("string"), 256).alias("content_hash"),
        F.lit("pending").alias("status"), F.when(F.col("vec_id") % 9 != 0, F.col("vector")).alias("embedding"),
    )


@query("bundle_roundtrip", """SELECT status, count(*) AS n, max(k) AS last_row FROM (SELECT CASE WHEN vec_id % 9 = 0 THEN 'failed' ELSE 'success' END AS status,
CASE WHEN vec_id % 9 > 0 THEN row_number() OVER (PARTITION BY vec_id % 9 = 0 ORDER BY vec_id) - 1 END AS k FROM embeddings) GROUP BY status""")
def bundle_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    rows = bundles.aligned(r.drop("embedding"), r.filter("embedding is not null").select("item_id", "embedding"), size=64)
    path = new_path(spark, "bundle")
    bundles.write_bundle(rows, path, {"model_space": "c2", "normalised": True})
    back, _ = bundles.read_bundle(spark, path)
    return back.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.max("embedding_row").cast("long").alias("last_row"))


@query("registry_snapshot", """SELECT 'first' AS run, count(*) AS appended, 0::BIGINT AS duplicates FROM embeddings UNION ALL SELECT 'second', 0, count(*) FROM embeddings""")
def registry_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).withColumn("embedding_row", F.lit(0))
    path = new_path(spark, "registry")
    got = [(k, *bundles.snapshot(rows, path, k)) for k in ("first", "second")]
    return spark.createDataFrame(got, "run string, appended long, duplicates long")


@query("csv_roundtrip", "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'x' END AS note FROM customer")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "csv")
    note = F.when(F.col("c_custkey") % 4 != 0, " x ").otherwise("")
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", note.alias("note")).write.csv(path, header=True)
    return tables.read_text_table(spark, path, ["c_custkey", "c_name", "c_mktsegment", "note"])


@query("table_profile", """SELECT 'source' AS column, count(*) AS rows, count(nullif(trim(source), '')) AS filled, count(DISTINCT nullif(trim(source), '')) AS distinct FROM documents UNION ALL SELECT 'lang', count(*), count(nullif(trim(lang), '')), count(DISTINCT nullif(trim(lang), '')) FROM documents""")
def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.profile(table(spark, sf_dir, "documents"), ["source", "lang"])


@query("streamed_registry", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def streamed_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; the registry keeps the first event of each user."""
    schema = table(spark, sf_dir, "events").schema
    path = new_path(spark, "stream")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).select("user_id", "event_id")
    registry.append_new(stream, f"{path}/table", "user_id", "event_id", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/table").select("user_id", "event_id")


@query("resumed_work", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resumed_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    finished = table(spark, sf_dir, "labels").withColumn("status", F.when(F.col("quality") == 1, "success").otherwise("failed"))
    return registry.remaining(table(spark, sf_dir, "documents"), finished, "doc_id", retry_failed=True).select("doc_id")


@query("event_windows", "SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time windows on the batch table, with the operator that a stream uses. An addition."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return registry.windowed_counts(e, "ts", ["event_type"], "6 hours", None, "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
