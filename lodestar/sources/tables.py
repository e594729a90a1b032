"""Readers of catalogue files. All are lazy scans with declared columns; checks that must raise run one small job."""

from __future__ import annotations

import functools
import io
import json
import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.strings import clean, is_inside, is_safe_id, suffix, truthy, whole
from lodestar.operators.catalogue import conflicts
from lodestar.operators.quality import ContractError, require
from lodestar.sources import schemas
from lodestar.sources.workspace import exists, share_code


def read_text_table(spark: SparkSession, path: str, required: Sequence[str], sep: str = ",", keep_extras: bool = True) -> DataFrame:
    """A delimited file with a header: required columns checked by name, all fields trimmed text, missing as ``""``."""
    raw = spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    lacking = [c for c in required if c not in raw.columns]
    if lacking:
        raise ContractError(f"{path}: columns are missing: {', '.join(lacking)}")
    names = [*required, *[c for c in raw.columns if c not in required]] if keep_extras else list(required)
    return raw.select(*[clean(F.col(f"`{c}`")).alias(c) for c in names])


def read_manifest(spark: SparkSession, path: str, extensions: Sequence[str]) -> DataFrame:
    """A passage manifest with bars as integers; the first broken rule raises."""
    rows = read_text_table(spark, path, schemas.PASSAGES)
    extras = [c for c in schemas.PASSAGE_EXTRAS if c in rows.columns]
    rows = rows.select(*schemas.PASSAGES, *extras).withColumns({"start": whole(F.col("start_bar")), "end": whole(F.col("end_bar"))})
    rules = {f"{c} is empty": F.col(c) == "" for c in schemas.PASSAGES}
    rules |= {
        "passage_id is unsafe": ~is_safe_id(F.col("passage_id")),
        "passage_id is not unique": F.count(F.lit(1)).over(Window.partitionBy("passage_id")) > 1,
        "relative_path leaves its root": ~is_inside(F.col("relative_path")),
        "extension is not allowed": ~suffix(F.col("relative_path")).isin(*[e.lower() for e in extensions]),
        "start_bar is below 1": F.coalesce(F.col("start"), F.lit(0)) < 1,
        "end_bar is before start_bar": F.coalesce(F.col("end"), F.lit(0)) < F.col("start"),
    }
    checked = rows.select("*", *[c.alias(f"__r{k}") for k, c in enumerate(rules.values())])
    require(checked, "passage_id", {name: F.col(f"__r{k}") for k, name in enumerate(rules)})
    return rows.drop("start_bar", "end_bar").withColumnsRenamed({"start": "start_bar", "end": "end_bar"})


def read_corpus(spark: SparkSession, path: str, eligible: str | None = None) -> DataFrame:
    """A corpus manifest with its extra columns; ids are safe and unique, bar ranges in order, and what belongs to a
    recording does not change within it. ``eligible`` names the column of the eligibility flag, required if given."""
    rows = read_text_table(spark, path, [*schemas.CORPUS, *([eligible] if eligible else [])])
    low, high = whole(F.col("bar_start")), whole(F.col("bar_end"))
    checked = rows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("passage_id")))
    require(checked, "passage_id", {
        "passage_id is unsafe": ~is_safe_id(F.col("passage_id"), colon=True), "passage_id is not unique": F.col("__n") > 1,
        "bars are out of order": low.isNotNull() & (high < low),
    })
    twisted = conflicts(rows.filter("recording_id <> ''"), "recording_id", [c for c in schemas.STABLE if c in rows.columns]).orderBy("recording_id", "field").first()
    if twisted:
        raise ContractError(f"recording {twisted['recording_id']}: several values of {twisted['field']}: {twisted['values']}")
    return rows.withColumns({"bar_start": low, "bar_end": high})


def read_prompts(spark: SparkSession, path: str, enabled_only: bool = True) -> DataFrame:
    """A prompt bank: safe unique ids with text; a small table by nature."""
    rows = read_text_table(spark, path, schemas.PROMPTS)
    checked = rows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("prompt_id")))
    require(checked, "prompt_id", {"prompt_id is unsafe": ~is_safe_id(F.col("prompt_id"), colon=True), "prompt_id is not unique": F.col("__n") > 1, "prompt_text is empty": F.col("prompt_text") == ""})
    return rows.filter(truthy(F.col("enabled"))) if enabled_only else rows


def read_prompt_yaml(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Ordered prompts from several YAML or JSON files read on the driver; ids are unique across files."""
    rows = []
    for path in paths:
        text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
        try:
            import yaml

            entries = yaml.safe_load(text)
        except ImportError:  # JSON is a subset of YAML
            entries = json.loads(text)
        entries = entries["prompts"] if isinstance(entries, dict) else entries
        rows += [(len(rows) + k, str(e["id"]).strip(), str(e["text"]).strip(), path) for k, e in enumerate(entries)]
    ids = [r[1] for r in rows]
    if len({*ids}) < len(ids) or not all(r[1] and r[2] for r in rows):
        raise ContractError("prompt ids must be unique and prompts need texts")
    return spark.createDataFrame(rows, "ordinal int, prompt_id string, prompt_text string, path string")


def read_lookup(spark: SparkSession, path: str, key: str, order: str | None = None) -> DataFrame:
    """A dimension keyed by ``key``, its last row winning; rows without a key are left out.

    A file that does not exist is an empty dimension. The order of rows is that of a column, or else of the lines: files
    by name, and inside a file by the scan of one unsplit stream.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], f"{key} string")
    if order:
        rows = read_text_table(spark, path, [key]).withColumn("__at", F.struct(F.col(order)))
    else:
        raw = spark.read.csv(path, header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)  # multi-line files are not split
        if key not in raw.columns:
            raise ContractError(f"{path}: columns are missing: {key}")
        at = F.struct(F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i"))
        rows = raw.select(*[clean(F.col(f"`{c}`")).alias(c) for c in raw.columns], at.alias("__at"))
    w = Window.partitionBy(key).orderBy(F.desc("__at"))
    return rows.filter(F.col(key) != "").withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k", "__at")


def read_overrides(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A table of decisions keyed by ``key``: each key once, with a reason and its evidence."""
    rows = read_text_table(spark, path, [key, "reason", "evidence"])
    checked = rows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(F.lower(key))))
    require(checked, key, {f"{key} is empty": F.col(key) == "", f"{key} is not unique": F.col("__n") > 1, "the reason is missing": F.col("reason") == "", "the evidence is missing": F.col("evidence") == ""})
    return rows.withColumn(key, F.lower(key))


def read_alignment_times(spark: SparkSession, path: str) -> DataFrame:
    """(recording_id, movement_id, events): the events of each recording's movement in order of their measures."""
    rows = read_events(spark, path).filter(F.col("measure").isNotNull())
    each = F.struct("measure", "onset", "offset", F.col("confidence").try_cast("double").alias("confidence"))
    return rows.groupBy("recording_id", "movement_id").agg(F.array_sort(F.collect_list(each)).alias("events"))


def newest_release(spark: SparkSession, path: str) -> str:
    """The release that the last readable JSON file of a folder names, by file name; else that file's stem, else "unknown"."""
    if not exists(spark, path):
        return "unknown"
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select(F.substring_index("path", "/", -1).alias("name"), F.col("content").cast("string").alias("text"))
    named = lambda k: F.nullif(F.trim(F.get_json_object("text", f"$.{k}")), F.lit(""))
    rows = rows.withColumn("release", F.coalesce(named("release"), named("corpus_release")))
    got = rows.agg(F.max_by("release", F.when(F.col("release").isNotNull(), F.col("name"))).alias("release"), F.max("name").alias("last")).first()
    return got["release"] or (got["last"].rsplit(".", 1)[0] if got["last"] else "unknown")


def read_named_vectors(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(item_id, vector, error) of files named ``<id>.npy``, each one vector of ``size`` finite numbers that are not all zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors, errors = [], [], []
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                error, v = None, None
                try:
                    v = np.load(io.BytesIO(raw), allow_pickle=False).astype(float)
                    v = v[0] if v.ndim == 2 and len(v) == 1 else v
                    if v.shape != (size,):
                        error = f"the shape is {v.shape}"
                    elif not np.isfinite(v).all() or not v.any():
                        error = "the vector is not sound"
                except (ValueError, OSError, EOFError) as e:
                    error = str(e)
                ids.append(name)
                vectors.append(None if error else v.tolist())
                errors.append(error)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(vectors, pa.list_(pa.float64())), pa.array(errors, pa.string())], names=["item_id", "vector", "error"])

    share_code(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("name"), "content").mapInArrow(run, "item_id string, vector array<double>, error string")


def archive_members(files: DataFrame, depth: int = 2, suffixes: Sequence[str] = (".xml", ".musicxml", ".mxl")) -> DataFrame:
    """(path, member, content, error) of files that are archives, and of archives inside them down to ``depth``.

    A member's name has the names of the archives around it before it, joined by ``!``. Only members with one of the
    suffixes are returned; an archive that cannot be read gives one row with its error.
    """

    def walk(prefix: str, raw: bytes, left: int) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(raw)) as archive:
                for info in archive.infolist():
                    name = f"{prefix}{info.filename}"
                    if info.is_dir():
                        continue
                    wanted, inner = info.filename.lower().endswith(tuple(suffixes)), info.filename.lower().endswith(".zip")
                    if wanted or inner and left > 1:
                        content = archive.read(info)
                        if inner and left > 1:
                            yield from walk(f"{name}!", content, left - 1)
                        if wanted:
                            yield name, content, None
        except (zipfile.BadZipFile, EOFError, OSError) as e:
            yield prefix.rstrip("!"), None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.binary(), pa.string())
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in walk("", raw, depth):
                    yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), *[pa.array([v], t) for v, t in zip(row, kinds, strict=True)]], names=["path", "member", "content", "error"])

    share_code(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, "path string, member string, content binary, error string")


def discover_bundles(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """(root, bundle, metadata) of every folder below the roots that holds a table of metadata, and of which version."""
    parts = []
    for root in roots:
        if exists(spark, root):
            found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(root)
            found = found.filter(F.col("path").rlike("/metadata/[^/]*$")).select(F.lit(root).alias("root"), F.regexp_extract("path", "^(.*)/metadata/[^/]*$", 1).alias("bundle"), F.col("content").cast("string").alias("metadata"))
            parts.append(found.filter("metadata <> ''"))
    if not parts:
        return spark.createDataFrame([], "root string, bundle string, metadata string")
    return functools.reduce(DataFrame.unionByName, parts)


def read_events(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """Alignment events with numeric columns, of the alignments in ``ids`` only: a semi-join before any grouping."""
    rows = read_text_table(spark, path, schemas.ALIGNMENT_EVENTS)
    if ids is not None:
        rows = rows.join(ids.select("alignment_id").distinct(), "alignment_id", "left_semi")
    return rows.withColumns({"measure": whole(F.col("score_measure")), "onset": F.col("onset_seconds").try_cast("double"), "offset": F.col("offset_seconds").try_cast("double")})


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotation rows of a tab-separated file with ``measure``: the integer part of ``mn``, else of ``mc``."""
    rows = read_text_table(spark, path, [], sep="\t")
    column = lambda c: F.nullif(F.col(c), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("measure", F.split_part(F.coalesce(column("mn"), column("mc")), F.lit("."), F.lit(1)).try_cast("int"))


def read_files(spark: SparkSession, path: str, glob: str = "*", content: bool = True) -> DataFrame:
    """(path, size, modified, digest, content) of files below a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    out = rows.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("digest"), "content")
    return out if content else out.drop("content")


def read_log_tail(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The last ``n`` lines of each text file, numbered from the first; lines are split inside a file's row."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split(F.regexp_replace("value", r"[\s]+$", ""), "\r?\n").alias("lines"))
    return rows.select("file", F.size("lines").alias("total"), F.posexplode("lines").alias("k", "line")).filter(F.col("k") >= F.col("total") - n).select("file", (F.col("k") + 1).alias("line_number"), "line")


def read_command_output(spark: SparkSession, text: str, fields: Sequence[str], sep: str = "|") -> DataFrame:
    """Captured delimited lines as columns, padded with ``""`` or cut to the field list."""
    lines = [x for x in text.splitlines() if x.strip()]
    parts = [([p.strip() for p in x.split(sep)] + [""] * len(fields))[: len(fields)] for x in lines]
    return spark.createDataFrame([tuple(p) for p in parts], schemas.text_columns(tuple(fields)))


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, rows, filled, distinct) in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.nullif(clean(F.col(c)), F.lit(""))).alias(f"f_{c}") for c in columns], *[F.count_distinct(F.nullif(clean(F.col(c)), F.lit(""))).alias(f"d_{c}") for c in columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"f_{c}").alias("filled"), F.col(f"d_{c}").alias("distinct")) for c in columns])))
