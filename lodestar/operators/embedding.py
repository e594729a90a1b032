"""The embedding stage: one vector per content, from a compatible cache or a model, given to all items of that content."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.quality import ContractError
from lodestar.sources.workspace import materialize, share_code

#: Bytes of the payloads that a model is given at once; a larger payload goes alone.
BATCH_BYTES = 1 << 20
Model = Callable[[Sequence[bytes]], Sequence[np.ndarray]]
_LOADED: dict[str, Model] = {}


def _model(key: str, load: Callable[[], Model]) -> Model:
    """The model of a key, loaded once in a worker process whatever the number of its tasks."""
    if key not in _LOADED:
        _LOADED[key] = load()
    return _LOADED[key]


def _batches(sizes: Sequence[int], most: int) -> Iterator[range]:
    """Runs of payloads of at most ``most`` bytes together, counted as if each were as long as the run's longest."""
    begin, longest = 0, 0
    for k, size in enumerate(sizes):
        grown = max(longest, size)
        if k > begin and grown * (k + 1 - begin) > most:
            yield range(begin, k)
            begin, grown = k, size
        longest = grown
    if begin < len(sizes):
        yield range(begin, len(sizes))


def _vector(v: object, size: int | None) -> list[float]:
    x = np.asarray(v, float).ravel()
    if not np.isfinite(x).all():
        raise ValueError("the vector is not finite")
    if size is not None and len(x) != size:
        raise ValueError(f"the vector has {len(x)} values, not {size}")
    return x.tolist()


def compute(contents: DataFrame, key: str, load: Callable[[], Model], size: int | None = None, batch_bytes: int = BATCH_BYTES, resources: ResourceProfile | None = None) -> DataFrame:
    """(digest, embedding, error) of (digest, payload), one row each.

    Payloads are sorted by length inside a task, so that a batch holds its like. A batch that fails is tried one by one; a
    model that cannot be loaded fails all. ``resources`` asks the cluster for tasks that hold what the model needs.
    """
    share_code(contents.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            digests, raws = part.column(0).to_pylist(), part.column(1).to_pylist()
            out: list[tuple] = [(None, "no payload")] * len(raws)
            given = [k for k, r in enumerate(raws) if r is not None]
            for run_ in _batches([len(raws[k]) for k in given], batch_bytes):
                own = [given[k] for k in run_]
                try:
                    vectors = list(_model(key, load)([raws[k] for k in own]))
                    if len(vectors) != len(own):
                        raise ValueError("as many vectors as payloads are asked for")
                    got = [(_vector(v, size), None) for v in vectors]
                except Exception:  # noqa: BLE001
                    got = [one(raws[k]) for k in own]
                for k, g in zip(own, got, strict=True):
                    out[k] = g
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array([o[0] for o in out], pa.list_(pa.float64())), pa.array([o[1] for o in out], pa.string())], names=["digest", "embedding", "error"])

    def one(raw: bytes) -> tuple:
        try:
            return _vector(_model(key, load)([raw])[0], size), None
        except Exception as e:  # noqa: BLE001  whatever the model raises is the content's error
            return None, f"{type(e).__name__}: {e}"

    rows = contents.select("digest", F.col("payload").cast("binary").alias("payload"))
    rows = rows.repartition("digest").sortWithinPartitions(F.length("payload"))
    return rows.mapInArrow(run, "digest string, embedding array<double>, error string", profile=resources)


def compatible(cache: DataFrame, made_by: Mapping[str, str]) -> DataFrame:
    """(digest, embedding) of the cache's rows that the same space, checkpoint and version made.

    A digest with unlike vectors among them is a conflict and an error: a cache must not say two things of one content.
    """
    rows = cache
    for column, value in made_by.items():
        rows = rows.filter(F.col(column) == value)
    rows = rows.filter(F.col("embedding").isNotNull()).groupBy("digest").agg(F.min("embedding").alias("embedding"), F.max("embedding").alias("__other"))
    bad = rows.filter("embedding <> __other").select("digest").limit(1).collect()
    if bad:
        raise ContractError(f"the cache holds unlike vectors of {bad[0]['digest']}")
    return rows.drop("__other")


def stage(items: DataFrame, item: str, key: str, load: Callable[[], Model], cache: DataFrame | None = None, made_by: Mapping[str, str] | None = None, size: int | None = None, batch_bytes: int = BATCH_BYTES, resources: ResourceProfile | None = None) -> DataFrame:
    """(item, digest, representative, embedding, status, error_message, origin) of items (item, payload, status).

    Items whose status is not pending keep it; pending ones end as success or failed. Each distinct content is worked on
    once, by its smallest item, unless a compatible row of the cache has it; ``origin`` is cache, computed or alias.
    """
    rows = materialize(items.select(item, "payload", "status").withColumn("digest", F.when(F.col("status") == "pending", F.sha2(F.col("payload").cast("binary"), 256))), "staged")
    pending = rows.filter("digest is not null")
    contents = pending.groupBy("digest").agg(F.min(item).alias("representative"))
    known = compatible(cache, made_by or {}) if cache is not None else None
    missing = contents if known is None else contents.join(known.select("digest"), "digest", "left_anti")
    asked = missing.join(pending.withColumnRenamed(item, "representative").select("representative", "digest", "payload"), ["digest", "representative"]).dropDuplicates(["digest"])
    made = materialize(compute(asked.select("digest", "payload"), key, load, size, batch_bytes, resources), "embedded")
    vectors = made.withColumn("__cached", F.lit(False))
    if known is not None:
        vectors = vectors.unionByName(known.join(contents.select("digest"), "digest", "left_semi").withColumns({"error": F.lit(None).cast("string"), "__cached": F.lit(True)}))
    found = contents.join(vectors, "digest")
    out = rows.drop("payload").join(found, "digest", "left")
    able = F.col("status") == "pending"
    status = F.when(~able, F.col("status")).when(F.col("embedding").isNotNull(), "success").otherwise("failed")
    message = F.when(able & F.col("embedding").isNull(), F.coalesce("error", F.lit("no payload"))).otherwise("")
    origin = F.when(F.col("embedding").isNull(), "").when(F.col("__cached"), "cache").when(F.col(item) == F.col("representative"), "computed").otherwise("alias")
    return out.select(item, "digest", "representative", "embedding", status.alias("status"), message.alias("error_message"), origin.alias("origin"))
