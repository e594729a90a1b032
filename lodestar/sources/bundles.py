"""Vector bundles, their registry, and the records of a run.

A bundle is one Parquet table, the vector in the row beside its metadata, and a one-row table of what holds for all
rows. ``embedding_row`` survives as a stable order only.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.strings import clean, fingerprint
from lodestar.functions.vectors import is_sound, norm
from lodestar.operators.catalogue import new_entries, numbered
from lodestar.operators.quality import ContractError, require
from lodestar.sources.workspace import exists

IDENTITY = ("model_space", "item_type", "item_id", "content_hash", "passage_generation_method")


def aligned(records: DataFrame, vectors: DataFrame, item: str = "item_id", size: int | None = None) -> DataFrame:
    """Records with their vectors: a left join, a row number over the successes in item order, pending ones failed.

    A vector of the wrong shape or that is not finite is an error, not a failure.
    """
    require(vectors, item, {"the vector is not sound": ~is_sound(F.col("embedding"), size)})
    rows = records.join(vectors.select(item, "embedding"), item, "left")
    ok = F.col("embedding").isNotNull()
    state = F.when(ok, "success").when(F.col("status").isin("", "pending") | F.col("status").isNull(), "failed").otherwise(F.col("status"))
    return _renumbered(rows.withColumn("status", state), item)


def _renumbered(rows: DataFrame, item: str) -> DataFrame:
    """Rows with a vector numbered from 0 in item order, the others without a number."""
    rows = rows.drop("embedding_row")
    good = numbered(rows.filter(F.col("embedding").isNotNull()), [item], "embedding_row")
    rest = rows.filter(F.col("embedding").isNull()).withColumn("embedding_row", F.lit(None).cast("long"))
    return good.unionByName(rest)


def write_bundle(rows: DataFrame, path: str, metadata: dict, force: bool = False) -> None:
    """Write a bundle; refuses to replace one unless forced. Success rows must be numbered from 0 without gaps."""
    good = rows.filter("embedding_row is not null")
    n, low, high, distinct = good.agg(F.count(F.lit(1)), F.min("embedding_row"), F.max("embedding_row"), F.count_distinct("embedding_row")).first()
    if n and (low != 0 or high != n - 1 or distinct != n):
        raise ContractError("embedding_row is not contiguous")
    mode = "overwrite" if force else "errorifexists"
    spark = rows.sparkSession
    if not force and exists(spark, path):
        raise ContractError(f"{path} exists")
    rows.write.mode(mode).parquet(f"{path}/rows")
    record = {**metadata, "rows": n}
    one = spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "metadata string").withColumn("content_hash", F.sha2("metadata", 256))
    one.coalesce(1).write.mode(mode).json(f"{path}/metadata")


def read_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The rows and the metadata of a bundle; its hash must hold."""
    one = spark.read.schema("metadata string, content_hash string").json(f"{path}/metadata").withColumn("now", F.sha2("metadata", 256)).first()
    if one["now"] != one["content_hash"]:
        raise ContractError(f"{path}: the metadata do not match their hash")
    return spark.read.parquet(f"{path}/rows"), json.loads(one["metadata"])


def successes(rows: DataFrame) -> DataFrame:
    """Rows with a vector, in their order, with unit norm checked within 1e-4."""
    good = rows.filter("embedding_row is not null")
    require(good, "item_id", {"the vector is missing": F.col("embedding").isNull(), "the vector is not of unit length": F.abs(norm(F.col("embedding")) - 1) > 1e-4})
    return good


def merged(bundles: Sequence[DataFrame], item: str = "item_id") -> DataFrame:
    """Bundles of one space in one, rows renumbered in item order; an item may occur once."""
    out = bundles[0]
    for b in bundles[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    if out.select("model_space").distinct().limit(2).count() > 1:
        raise ContractError("bundles of several spaces do not merge")
    if out.groupBy(item).count().filter("count > 1").limit(1).count():
        raise ContractError(f"{item} occurs in several bundles")
    return _renumbered(out, item)


def identity(extra: Sequence[Column] = ()) -> Column:
    """What makes two rows of a registry the same entry."""
    return fingerprint(*[F.col(c) for c in IDENTITY], *extra)


def window_bars(method: Column) -> Column:
    """The size in ``fixed_N_bars``; empty for other methods, those with a stride included."""
    return F.regexp_extract(clean(method), "^fixed_([^_]*)_bars$", 1)


def snapshot(rows: DataFrame, registry_path: str, run_id: str) -> tuple[int, int]:
    """Append the rows that a registry lacks under ``run_id``; (appended, duplicates). The registry is only added to.

    A run_id belongs to one content, whose fingerprint (of the identities and vectors) is recorded beside the registry:
    the same content again changes nothing, another one is refused.
    """
    spark = rows.sparkSession
    batch = rows.withColumn("identity_key", identity()).withColumn("window_bars", window_bars(F.col("passage_generation_method")))
    marks = f"{registry_path.rstrip('/')}-runs/run_id={run_id}"
    one = F.xxhash64(*[c for c in ("identity_key", "embedding") if c in batch.columns])
    both = F.concat_ws(",", F.bit_xor(one).cast("string"), F.sum(one.cast("decimal(20,0)")).cast("string"))
    count, mark = batch.agg(F.count(F.lit(1)), F.sha2(both, 256)).first()
    if exists(spark, marks):
        if spark.read.json(marks).first()["fingerprint"] != mark:
            raise ContractError(f"run {run_id} was recorded with other content")
    if exists(spark, registry_path):
        known = spark.read.parquet(registry_path).filter(F.col("run_id") != run_id).select("identity_key")
    else:
        known = spark.createDataFrame([], "identity_key string")
    fresh = new_entries(batch, known, "identity_key", ["embedding_row", "item_id"])
    fresh.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(registry_path)
    spark.createDataFrame([(mark,)], "fingerprint string").coalesce(1).write.mode("overwrite").json(marks)
    added = spark.read.parquet(registry_path).filter(F.col("run_id") == run_id).count() if exists(spark, f"{registry_path}/run_id={run_id}") else 0
    return added, count - added


def provenance(rows: DataFrame, inputs: DataFrame, settings: dict) -> DataFrame:
    """One row that says what a result was made from: its columns, number of rows and content mark, the inputs
    (path, size, digest) in order, and the settings with their fingerprint."""
    mark = F.bit_xor(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])).cast("string")
    one = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(mark, F.lit("0")).alias("content_mark"))
    files = inputs.agg(F.to_json(F.array_sort(F.collect_list(F.struct("path", "size", "digest")))).alias("inputs"))
    text = json.dumps(settings, sort_keys=True, separators=(",", ":"))
    return one.crossJoin(files).select(
        F.lit(",".join(rows.columns)).alias("columns"), "rows", "content_mark", "inputs", F.sha2("inputs", 256).alias("inputs_fingerprint"),
        F.lit(text).alias("settings"), F.sha2(F.lit(text), 256).alias("settings_fingerprint"),
    )


def lock(spark: SparkSession, path: str, payload: dict) -> str:
    """Record a payload's fingerprint the first time; later payloads must match it."""
    text = json.dumps(payload, sort_keys=True)
    one = spark.createDataFrame([(text,)], "payload string").withColumn("fingerprint", F.sha2("payload", 256))
    if not exists(spark, path):
        one.coalesce(1).write.json(path)
    seen = spark.read.schema("payload string, fingerprint string").json(path).first()
    if seen["fingerprint"] != one.first()["fingerprint"]:
        raise ContractError(f"{path}: the inputs have changed")
    return seen["fingerprint"]


def run_manifest(files: DataFrame) -> DataFrame:
    """(path, size, digest) of a run's files, those below ``temp`` left out."""
    return files.filter(~F.col("path").rlike("/temp/")).select("path", "size", "digest").orderBy("path")


def write_frozen(rows: DataFrame, path: str, status: str, version: str) -> str:
    """A versioned copy, only of data whose audit ended without an error."""
    if status == "error":
        raise ContractError("the audit has errors")
    target = f"{path}/version={version}"
    rows.write.mode("errorifexists").parquet(target)
    return target
