"""Incremental work: an append-only registry fed by a stream, resumable runs, windowed counts of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from lodestar.operators.catalogue import first_by
from lodestar.sources.workspace import exists


def append_new(stream: DataFrame, path: str, key: str, order: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append each batch's new keys to a Parquet registry.

    A batch is deduplicated in itself and against the registry by an anti-join, and written to a folder of its own
    that a repeated batch overwrites, so a retry after a crash adds nothing twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = first_by(batch, [key], [order])
        if exists(spark, path):
            known = spark.read.parquet(path).filter(F.col("batch_id") != batch_id).select(key)
            fresh = fresh.join(known, key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stateful_distinct(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """First occurrences of a key within a watermark: state is dropped once its time has passed."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, keys: list[str], size: str, slide: str | None, delay: str) -> DataFrame:
    """Counts per event-time window; late rows beyond the delay are left out. An addition, not taken over from anywhere."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, delay).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", *keys, "n")


def remaining(selected: DataFrame, finished: DataFrame, key: str, retry_failed: bool = False) -> DataFrame:
    """What a resumed run still has to do: an anti-join with what is finished; failures count as such unless retried."""
    done = finished.filter("status = 'success'") if retry_failed else finished
    return selected.join(done.select(key), key, "left_anti")


def cached(items: DataFrame, cache: DataFrame, key: str, version: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results for distinct contents: those in a cache of this version, and computed ones for the rest."""
    keyed = items.select(key).distinct().withColumn("version", F.lit(version))
    hit = cache.join(keyed, [key, "version"], "left_semi")
    missing = keyed.join(cache, [key, "version"], "left_anti")
    return hit.unionByName(compute(missing.drop("version")).withColumn("version", F.lit(version)))


class Progress(StreamingQueryListener):
    """What running streams have done: rows by query, and the errors of those that ended with one."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.failed: dict[str, str] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.rows.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        at = str(event.progress.id)
        self.rows[at] = self.rows.get(at, 0) + int(event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.add(str(event.id))
        if event.exception:
            self.failed[str(event.id)] = event.exception
