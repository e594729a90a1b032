"""Audits of whole collections: validation reports, overrides held against evidence, pooled vectors, a model's hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.identity import movement
from lodestar.functions.strings import clean
from lodestar.operators.geometry import mean_vectors
from lodestar.sources.workspace import share_code

IMBALANCE, DOMINANCE, TOLERANCE = 1.5, 0.5, 1


def validation(rows: DataFrame, expected: Sequence[str], group: str, work: str, path: str, size: str, item: str, start: str, end: str, measures: str) -> DataFrame:
    """(severity, rule, subject, value) of a manifest: what is wrong with it and what is odd.

    Errors: a file of several items, an empty file, a wanted group without items, a group that nobody asked for, a group
    of one work. Warnings: groups whose numbers of items lie more than half apart, a work with more than half of its
    group's items, a score whose measures differ from the item's range by more than one. ``value`` is the count, ratio or
    difference behind the finding.
    """
    found = lambda df, severity, rule, subject, value: df.select(
        F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), F.round(value.cast("double"), 6).alias("value")
    )
    spark = rows.sparkSession
    shared = rows.groupBy(path).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    empty = rows.filter(F.col(size) == 0)
    works = rows.groupBy(group, work).agg(F.count(F.lit(1)).alias("n"))
    groups = works.groupBy(group).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("works"), F.max("n").alias("most"))
    wanted = spark.createDataFrame([(e,) for e in expected], "wanted string")
    missing = wanted.join(groups, F.col("wanted") == F.col(group), "left_anti")
    strange = groups.join(wanted, F.col("wanted") == F.col(group), "left_anti")
    ratio = groups.agg((F.max("n") / F.min("n")).alias("r"), F.count(F.lit(1)).alias("k")).filter((F.col("k") > 1) & (F.col("r") > IMBALANCE))
    dominant = groups.filter(F.col("most") / F.col("n") > DOMINANCE)
    apart = rows.withColumn("d", F.abs(F.col(measures) - (F.col(end) - F.col(start) + 1))).filter(F.col("d") > TOLERANCE)
    parts = [
        found(shared, "error", "shared source file", F.col(path), F.col("n")), found(empty, "error", "empty source file", F.col(item), F.lit(0)),
        found(missing, "error", "group is absent", F.col("wanted"), F.lit(0)), found(strange, "error", "group is not configured", F.col(group), F.col("n")),
        found(groups.filter("works < 2"), "error", "fewer than two works", F.col(group), F.col("works")), found(ratio, "warning", "groups are unbalanced", F.lit(""), F.col("r")),
        found(dominant, "warning", "one work dominates", F.col(group), F.col("most") / F.col("n")), found(apart, "warning", "measures differ from the range", F.col(item), F.col("d")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pooled(items: DataFrame, chunks: DataFrame, key: str, chunk: str, vector: str = "embedding") -> DataFrame:
    """(key, status, missing, vector): the mean of an item's chunks, only if every one of them has a vector.

    ``items`` lists the chunks (key, chunk) that belong to each item. An item with a chunk missing fails and has no mean.
    """
    rows = items.select(key, chunk).join(chunks.select(chunk, F.col(vector).alias("vector")), chunk, "left")
    state = rows.groupBy(key).agg(F.count_if(F.col("vector").isNull()).alias("missing"))
    whole = state.filter("missing = 0").select(key)
    means = mean_vectors(rows.join(whole, key, "left_semi"), [key], "vector", normalised=False).select(key, "vector")
    return state.join(means, key, "left").select(key, F.when(F.col("missing") == 0, "success").otherwise("failed").alias("status"), "missing", "vector")


def embedded(items: DataFrame, item: str, payload: str, model: Callable[[Sequence[bytes]], Sequence[np.ndarray]], batch: int = 64) -> DataFrame:
    """(item, vector, status, error) from a model that is given with the call.

    The model gets payloads in batches, inside the tasks. If a batch fails its items are tried one by one, so only those
    fail that fail alone. A null payload fails, as does a vector with a value that is not finite.
    """
    share_code(items.sparkSession)
    kind = dict(items.dtypes)[item]

    def one(raw: bytes) -> tuple:
        try:
            return checked(model([raw])[0])
        except Exception as e:  # noqa: BLE001  whatever the model raises is the item's error
            return None, "failed", f"{type(e).__name__}: {e}"

    def checked(v: np.ndarray) -> tuple:
        v = np.asarray(v, float).ravel()
        return (v.tolist(), "success", None) if np.isfinite(v).all() else (None, "failed", "the vector is not finite")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            raws = rows.column(1).to_pylist()
            out: list[tuple] = [(None, "failed", "no payload")] * len(raws)
            given = [k for k, r in enumerate(raws) if r is not None]
            for at in range(0, len(given), batch):
                part = given[at : at + batch]
                try:
                    vectors = list(model([raws[k] for k in part]))
                    got = [checked(v) for v in vectors] if len(vectors) == len(part) else [one(raws[k]) for k in part]
                except Exception:  # noqa: BLE001
                    got = [one(raws[k]) for k in part]
                for k, g in zip(part, got, strict=True):
                    out[k] = g
            kinds = (pa.list_(pa.float64()), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([rows.column(0), *[pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)]], names=[item, "vector", "status", "error"])

    return items.select(item, F.col(payload).cast("binary").alias("payload")).mapInArrow(run, f"{item} {kind}, vector array<double>, status string, error string")


def found_version(selections: DataFrame, versions: DataFrame) -> DataFrame:
    """Selections (work_id, sha256, path) with ``score_version_id``, the first version of the work at that path whose digest,
    if it has one, is the same; null if there is none."""
    plain = lambda c: F.regexp_replace(clean(c), "^/+", "")
    v = versions.select("work_id", plain(F.col("source_file_path")).alias("__path"), F.lower(clean(F.col("sha256"))).alias("__sha"), "score_version_id")
    rows = selections.withColumn("__at", plain(F.col("path")))
    same = (F.col("work_id") == F.col("__work")) & (F.col("__at") == F.col("__path")) & (F.col("__path") != "") & ((F.col("__sha") == "") | (F.col("__sha") == F.lower("sha256")))
    best = rows.select("work_id", "sha256", "path", "__at").distinct().join(v.withColumnRenamed("work_id", "__work"), same)
    first = best.groupBy("work_id", "sha256", "path").agg(F.min("score_version_id").alias("score_version_id"))
    return selections.join(first, ["work_id", "sha256", "path"], "left")


def override_problems(overrides: DataFrame, groups: DataFrame) -> DataFrame:
    """(sha256, problem) for each override that cannot stand; the first rule that it breaks.

    An override names a digest once, gives a reason and its evidence, belongs to a group, and resolves to a catalogue
    number and a movement that the group's own evidence holds, where it holds any. ``groups`` has sha256, numbers and
    movements, arrays.
    """
    o = overrides.select(
        F.lower(clean(F.col("sha256"))).alias("sha256"), clean(F.col("reason")).alias("reason"), clean(F.col("evidence")).alias("evidence"),
        F.regexp_replace(F.lower(clean(F.col("resolved_catalogue"))), r"^k(?:v)?\.?\s*", "").alias("catalogue"), clean(F.col("resolved_movement")).alias("movement"),
    )
    times = o.groupBy("sha256").agg(F.count(F.lit(1)).alias("times"))
    g = groups.select(F.lower(clean(F.col("sha256"))).alias("sha256"), "numbers", "movements", F.lit(True).alias("known"))
    rows = o.join(times, "sha256").join(g, "sha256", "left")
    lower = lambda c: F.transform(c, lambda x: F.lower(x))
    part = F.lower(F.coalesce(movement(F.col("movement")), F.col("movement")))
    problem = (
        F.when(F.col("sha256") == "", "the digest is missing").when(F.col("times") > 1, "the digest occurs twice").when(F.col("reason") == "", "the reason is missing")
        .when(F.col("evidence") == "", "the evidence is missing").when(F.col("known").isNull(), "no such group")
        .when((F.col("catalogue") != "") & (F.size("numbers") > 0) & ~F.array_contains(lower(F.col("numbers")), F.col("catalogue")), "the catalogue number contradicts the evidence")
        .when((F.col("movement") != "") & (F.size("movements") > 0) & ~F.array_contains(lower(F.col("movements")), part), "the movement contradicts the evidence")
    )
    return rows.select("sha256", problem.alias("problem")).filter("problem is not null").distinct()


def representative_problems(overrides: DataFrame, members: DataFrame) -> DataFrame:
    """(work_key, problem) for each choice of a representative that is not a member of its group, or has no grounds."""
    o = overrides.select(clean(F.col("work_key")).alias("work_key"), F.lower(clean(F.col("sha256"))).alias("sha256"), clean(F.col("reason")).alias("reason"), clean(F.col("evidence")).alias("evidence"))
    keys = members.select("work_key").distinct().withColumn("known", F.lit(True))
    pairs = members.select("work_key", F.lower("sha256").alias("sha256")).distinct().withColumn("member", F.lit(True))
    rows = o.join(keys, "work_key", "left").join(pairs, ["work_key", "sha256"], "left")
    problem = (
        F.when(F.col("work_key") == "", "the work is missing").when(F.col("sha256") == "", "the digest is missing").when(F.col("reason") == "", "the reason is missing")
        .when(F.col("evidence") == "", "the evidence is missing").when(F.col("known").isNull(), "no such work").when(F.col("member").isNull(), "the digest is not in the group")
    )
    return rows.select("work_key", problem.alias("problem")).filter("problem is not null").distinct()


def readiness(rows: DataFrame, allowed: Sequence[str], covered: Column) -> DataFrame:
    """(metric, value) of a corpus manifest in one pass, and what its paths and recordings share.

    Rows have ids of composition, work, movement and recording, paths with ``*_exists`` flags, and a rights status.
    ``covered`` says whether a row's measures are all aligned.
    """
    some = lambda c: F.nullif(clean(F.col(c)), F.lit(""))
    audio, authorized = some("audio_path").isNotNull() & F.col("audio_exists"), F.lower(clean(F.col("rights_status"))).isin(*[a.lower() for a in allowed])
    symbolic = F.coalesce(some("mxl_path"), some("score_path"), some("midi_path"))
    one = rows.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_distinct(some(f"{c}_id")).alias(f"{c}s") for c in ("composition", "work", "movement", "recording")],
        F.count_if(symbolic.isNotNull() & F.col("symbolic_exists")).alias("symbolic_ready"), F.count_if(symbolic.isNotNull() & ~F.col("symbolic_exists")).alias("missing_symbolic_paths"),
        F.count_if(audio).alias("local_audio"), F.count_if(some("audio_path").isNotNull() & ~F.col("audio_exists")).alias("missing_audio_paths"),
        F.count_if(audio & authorized).alias("authorized_audio"), F.count_if(audio & ~authorized).alias("unauthorized_audio"),
        F.count_if(audio & authorized & covered).alias("fully_aligned"), F.count_if(audio & authorized & ~covered).alias("alignment_gaps"),
    )
    several = lambda key, value: rows.filter(key.isNotNull()).groupBy(key.alias("k")).agg(F.count_distinct(value).alias("n")).filter("n > 1").agg(F.count(F.lit(1)).alias("n")).first
    long = one.unpivot([], one.columns, "metric", "value")
    spark = rows.sparkSession
    item = F.coalesce(some("recording_id"), F.col("passage_id"))
    extra = [
        ("shared_audio_paths", several(some("audio_path"), item)()["n"]), ("shared_symbolic_paths", several(symbolic, F.coalesce(some("movement_id"), F.col("passage_id")))()["n"]),
        ("several_recordings", several(some("composition_id"), some("recording_id"))()["n"]),
    ]
    return long.unionByName(spark.createDataFrame(extra, "metric string, value long"))
