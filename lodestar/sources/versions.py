"""Several tables committed as one: data in folders of their own, and numbered manifests that readers follow.

A commit writes all its tables first, each to a fresh folder, and then one manifest under the next number, renamed into
place and never over another. Readers take the newest manifest, so they see all of a commit or nothing of it; a commit
that fails leaves folders that no manifest names. A table may be kept in buckets: a commit can replace some buckets and
take over the others from the version before (copy on write). A manifest also records the row digests of the inputs it
was made from, by partition, so that a later look says which inputs have changed since.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.operators import digests
from lodestar.operators.quality import ContractError
from lodestar.sources.workspace import exists


@dataclass(frozen=True)
class Replaced:
    """Rows of a bucketed table: those of the buckets named, which replace what these buckets held. The rows hold ``bucket``."""

    rows: DataFrame
    buckets: Sequence[int]


class Store:
    """A folder of committed versions."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def versions(self) -> list[int]:
        """The committed versions, oldest first."""
        if not exists(self.spark, f"{self.root}/manifests"):
            return []
        names = [f.getPath().getName() for f in self._fs().listStatus(self._path("manifests"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """What a version consists of; the newest by default."""
        known = self.versions()
        if not known or version is not None and version not in known:
            raise ContractError(f"{self.root} has no version {'' if version is None else version}".rstrip())
        return json.loads(self.spark.read.text(f"{self.root}/manifests/v{version or known[-1]:08d}.json", wholetext=True).first()[0])

    def tables(self) -> list[str]:
        return sorted(self.manifest()["tables"]) if self.versions() else []

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """One table of a version."""
        found = self.manifest(version)["tables"].get(table)
        if found is None:
            raise ContractError(f"{self.root} has no table {table}")
        schema = T.StructType.fromJson(found["schema"])
        paths = [f"{self.root}/{p}" for p in found["parts"].values()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, tables: Mapping[str, DataFrame | Replaced], inputs: Mapping[str, DataFrame] | None = None, note: Mapping | None = None) -> int:
        """Write the tables and make them the next version together; returns its number. Tables not named are taken over.

        Two writers that began from one version cannot both commit: the second finds the number taken, and fails.
        """
        known = self.versions()
        base = self.manifest() if known else {"tables": {}}
        made, folder = dict(base["tables"]), f"data/{uuid.uuid4().hex[:16]}"
        for name, rows in tables.items():
            bucketed = isinstance(rows, Replaced)
            df = rows.rows if bucketed else rows
            target = f"{folder}/{name}"
            if bucketed:
                df.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{target}")
                kept = {b: p for b, p in made.get(name, {"parts": {}})["parts"].items() if int(b) not in set(rows.buckets)}
                parts = kept | {str(b): f"{target}/bucket={b}" for b in rows.buckets if exists(self.spark, f"{self.root}/{target}/bucket={b}")}
                schema = df.drop("bucket").schema
            else:
                df.write.parquet(f"{self.root}/{target}")
                parts, schema = {"": target}, df.schema
            made[name] = {"schema": json.loads(schema.json()), "parts": parts}
        record = {
            "version": (known[-1] if known else 0) + 1, "tables": made, "note": dict(note or {}),
            "inputs": {name: _marks(df) for name, df in (inputs or {}).items()} if inputs is not None else base.get("inputs", {}),
        }
        self._publish(record)
        return record["version"]

    def _publish(self, record: dict) -> None:
        fs, jvm = self._fs(), self.spark._jvm
        final = self._path(f"manifests/v{record['version']:08d}.json")
        draft = self._path(f"manifests/draft-{uuid.uuid4().hex[:16]}")
        fs.mkdirs(final.getParent())
        out = fs.create(draft)
        out.write(bytearray(json.dumps(record, sort_keys=True).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        careful = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, final, careful)  # fails if the name is taken
        except Exception as e:
            fs.delete(draft, False)
            raise ContractError(f"version {record['version']} was committed by another writer") from e

    def stale(self, inputs: Mapping[str, DataFrame], version: int | None = None) -> list[tuple[str, int]]:
        """(input, partition) whose rows are not those that the version was made from; inputs it does not know are stale."""
        recorded = self.manifest(version)["inputs"]
        out = []
        for name, df in inputs.items():
            then, now = dict(map(tuple, recorded.get(name, []))), dict(map(tuple, _marks(df)))
            out += [(name, p) for p in sorted(then.keys() | now.keys()) if then.get(p) != now.get(p)]
        return out

    def expire(self, keep: int = 2) -> int:
        """Delete folders that the newest ``keep`` versions do not name, and older manifests; returns how many folders went."""
        versions = self.versions()
        used = {p.split("/")[1] for v in versions[-keep:] for t in self.manifest(v)["tables"].values() for p in t["parts"].values()}
        fs, gone = self._fs(), 0
        for version in versions[:-keep]:
            fs.delete(self._path(f"manifests/v{version:08d}.json"), False)
        if exists(self.spark, f"{self.root}/data"):
            for f in fs.listStatus(self._path("data")):
                if f.getPath().getName() not in used:
                    gone += fs.delete(f.getPath(), True)
        return gone


def _marks(df: DataFrame) -> list[list]:
    """[partition, mark] of a table; as many rows as :data:`digests.PARTS`."""
    return sorted([r["part"], r["mark"]] for r in digests.by_part(df, df.columns[:1]).select("part", "mark").collect())


def bucket(key: str, buckets: int):
    """The bucket of a key."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
