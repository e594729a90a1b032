"""Shared intermediate storage.

Iterative operators cut their lineage by writing a table to the folder that the cluster names in
``spark.checkpoint.dir``; every executor and the driver can read it, so a lost executor costs nothing that was
already written. Only where that setting is absent (unit tests, notebooks) is a local folder made.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MADE: list[str] = []
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_HOME = str(Path(__file__).resolve().parents[2])


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this library from where the driver found it, whatever their working folder is.

    On a cluster the library is installed or shipped with the job; a path that does not exist there does no harm.
    """
    known = spark.sparkContext.environment
    paths = known.get("PYTHONPATH", "").split(":")
    if _HOME not in paths:
        known["PYTHONPATH"] = ":".join([_HOME, *filter(None, paths)])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path holds anything."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; without that setting a temporary one, in local mode only.

    On a cluster a folder of one machine is invisible to the others, so there the setting must be given.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "root" not in _OWN:
        _OWN["root"] = tempfile.mkdtemp(prefix="lodestar-")
        atexit.register(shutil.rmtree, _OWN["root"], ignore_errors=True)
    return f"file://{_OWN['root']}"


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    path = f"{shared_root(spark)}/lodestar/{label}-{uuid.uuid4().hex[:16]}"
    _MADE.append(path)
    return path


def materialize(df: DataFrame, label: str, share: int = 1) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of what was written.

    ``share``: for what is small beside its source, a table is written by that part of the shuffle partitions, so that
    it does not fall into as many tiny files.

    The exchanges of the write are of no use once it is done, so their files go at once; without that they stay until the
    driver happens to collect its garbage, and those of all steps of a job lie on the disks together.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    if share > 1:
        df = df.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // share))
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`new_path` named."""
    if "/lodestar/" in path:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files behind tables made by :func:`materialize` once nothing reads them any more."""
    for df in tables:
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(df.sparkSession, parent)


def made() -> list[str]:
    """The paths that this session has taken in the shared folder and not given back."""
    return list(_MADE)


def release(keep: DataFrame, paths: list[str]) -> None:
    """Delete those of some paths in the shared folder that ``keep`` does not read.

    For the seams of a job: what an earlier step returned has been written elsewhere, and its working tables are of no use.
    """
    used = {f.rsplit("/", 1)[0].split("lodestar/")[-1] for f in keep.inputFiles()}
    for path in [p for p in paths if p in _MADE and p.split("lodestar/")[-1] not in used]:
        remove(keep.sparkSession, path)
        _MADE.remove(path)
