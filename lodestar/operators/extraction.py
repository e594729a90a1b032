"""Per-item extraction through a cache by content and extractor version, with failures kept apart.

Items of one digest are worked on once. What a cache of this version holds is taken from it; failures are remembered
too, and tried again only on request or under a new version. Both tables live in a versioned store, in buckets by digest:
a run replaces the buckets that it touches, successes and failures in one commit, so a run that is cut off leaves the
version before. Every selected item ends as one success or one failure.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.quality import ContractError
from lodestar.sources.versions import Replaced, Store, bucket
from lodestar.sources.workspace import materialize, share_code

BUCKETS = 64
#: What a run may find before any work: an item that cannot be read is a failure of its own, whatever its digest.
Compute = Callable[[DataFrame], DataFrame]


def attempted(function: Callable[[object], object], features: str, payload: str = "payload") -> Compute:
    """(digest, features, error) by a Python function of one payload; what it raises becomes the row's error.

    ``features`` is the Spark type of what the function returns.
    """

    def compute(df: DataFrame) -> DataFrame:
        share_code(df.sparkSession)
        kind = df.sparkSession.createDataFrame([], f"digest string, features {features}, error string").schema
        arrow = pa.schema([("digest", pa.string())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            types = to_arrow_schema(kind)
            for batch in batches:
                out = []
                for value in batch.column(batch.schema.get_field_index(payload)).to_pylist():
                    try:
                        out.append((function(value), None))
                    except Exception as e:  # noqa: BLE001
                        out.append((None, f"{type(e).__name__}: {e}"))
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(arrow.names[0])), pa.array([o[0] for o in out], types.field("features").type), pa.array([o[1] for o in out], pa.string())], schema=types)

        return df.mapInArrow(run, kind)

    return compute


@dataclass(frozen=True)
class Extracted:
    """What a run ends with: rows per item, and its counts."""

    successes: DataFrame
    failures: DataFrame
    counts: dict[str, int]


def _of_version(store: Store, table: str, version: str) -> DataFrame | None:
    return store.read(table).filter(F.col("version") == version).drop("version") if table in store.tables() else None


def _minus(df: DataFrame, known: DataFrame | None) -> DataFrame:
    return df if known is None else df.join(known.select("digest"), "digest", "left_anti")


def extract(store: Store, selected: DataFrame, item: str, version: str, compute: Compute, retry_failures: bool = False, buckets: int = BUCKETS) -> Extracted:
    """Features of ``selected`` (item, digest, payload, problem): a problem that is not null is the item's failure.

    ``compute`` takes (digest, payload), one row per digest, and returns (digest, features, error), one row each; a digest
    without a row in what it returns is a failure.
    """
    able = selected.filter("problem is null")
    wanted = able.groupBy("digest").agg(F.any_value("payload", True).alias("payload"))
    good, bad = _of_version(store, "features", version), _of_version(store, "failures", version)
    todo = _minus(wanted, good)
    todo = materialize(todo if retry_failures else _minus(todo, bad), "todo")
    got = compute(todo).select("digest", "features", "error")
    rows = todo.select("digest").join(got.withColumn("__hit", F.lit(True)), "digest", "left")
    error = F.when(F.col("features").isNull(), F.coalesce("error", F.lit("no result")))
    # what was computed is written before it is counted, so that nothing is computed twice
    made = materialize(rows.select("digest", "features", error.alias("error"), bucket("digest", buckets).alias("bucket")), "extracted")
    if made.groupBy("digest").count().filter("count > 1").limit(1).count():
        raise ContractError("a digest has several results")
    touched = sorted(r["bucket"] for r in made.select("bucket").distinct().collect())  # at most ``buckets`` numbers
    if touched or not store.versions():
        new = {
            "features": made.filter("error is null").select("digest", F.lit(version).alias("version"), "features", "bucket"),
            "failures": made.filter("error is not null").select("digest", F.lit(version).alias("version"), "error", "bucket"),
        }
        tables = {}
        for name, fresh in new.items():
            if name in store.tables():
                here = bucket("digest", buckets)
                old = store.read(name).withColumn("bucket", here).filter(F.col("bucket").isin(touched))
                fresh = old.join(made.select("digest"), "digest", "left_anti").select(*fresh.columns).unionByName(fresh)
            tables[name] = Replaced(fresh, touched)
        store.commit(tables, note={"extractor": version})
    good, bad = _of_version(store, "features", version), _of_version(store, "failures", version)
    done = able.drop("payload", "problem").join(good, "digest")
    failed = able.drop("payload", "problem").join(bad, "digest").withColumnRenamed("error", "reason")
    unread = selected.filter("problem is not null").drop("payload").withColumnRenamed("problem", "reason")
    failures = failed.select(item, "digest", "reason").unionByName(unread.select(item, "digest", "reason"))
    computed = made.agg(F.count(F.lit(1)), F.count_if(F.col("error").isNull())).first()
    counts = {
        "selected": selected.count(), "unreadable": unread.count(), "digests": wanted.count(), "computed": computed[0], "computed_well": computed[1],
        "succeeded": done.count(), "failed": failures.count(),
    }
    if counts["selected"] != counts["succeeded"] + counts["failed"]:
        raise ContractError(f"{counts['selected']} items were selected, but {counts['succeeded']} succeeded and {counts['failed']} failed")
    return Extracted(done.select(item, "digest", "features"), failures, counts)
