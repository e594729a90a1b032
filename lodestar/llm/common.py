"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.sources.workspace import share_code

#: Words are maximal runs of anything but these six ASCII white space characters.
SPACES = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACES}]+"
#: Limits of one Arrow batch, so that a batch of very long texts stays small.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches within :data:`BATCH_ROWS` rows and :data:`BATCH_BYTES` bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(df: DataFrame, f, schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with bounded batches."""
    bound_batches(df.sparkSession)
    share_code(df.sparkSession)
    return df.mapInArrow(f, schema)


def schema_with(df: DataFrame, **more: T.DataType) -> T.StructType:
    """The schema of ``df`` with further columns."""
    return T.StructType([*df.schema.fields, *(T.StructField(k, t) for k, t in more.items())])


def text_of(col: str | Column) -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce((F.col(f"`{col}`") if isinstance(col, str) else col).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as ``array<string>``, JVM-side."""
    return F.array_remove(F.split(text, f"[{SPACES}]+"), "")


def width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def skew_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one``, which has a key once, where some keys may hold a large part of ``many``.

    A key with more rows than a partition's fair share is hot; fewer keys than partitions can be, so their rows of ``one``
    are broadcast, and only the other keys are dealt out. ``many`` is read thrice: give a written table. A null key
    matches nothing.
    """
    n = width(many.sparkSession)
    counts = many.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    share = many.agg((F.count(key) / n).alias("__share"))
    hot = counts.crossJoin(F.broadcast(share)).filter("__n > __share").select(key)  # fewer than n keys
    named = F.broadcast(one.join(F.broadcast(hot), key, "left_semi"))
    rest = many.join(F.broadcast(hot), key, "left_anti").join(one, key, how)
    left = many.join(F.broadcast(hot), key, "left_semi").join(named, key, how)
    return left.unionByName(rest)


def quantile_bounds(df: DataFrame, column: str, pieces: int) -> tuple[list[int], int]:
    """Distinct values of an integer column that cut it into about ``pieces`` ranges, smallest first, and its nulls.

    The values are of the column, so each range holds its own lower bound. Only ``pieces`` numbers reach the driver.
    """
    steps = [i / pieces for i in range(pieces)]
    got = df.agg(
        F.percentile_approx(column, steps, max(10_000, 20 * pieces)).alias("q"),
        F.min(column).alias("low"),
        F.count(F.when(F.col(column).isNull(), 1)).alias("nulls"),
    ).first()
    return sorted({*(got["q"] or []), *([] if got["low"] is None else [got["low"]])}), got["nulls"]


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 17
#: Powers of the base and of its inverse modulo 2**64, for one block of bytes.
_POWERS: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers() -> list[np.ndarray]:
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(_BLOCK, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text with A-Z lower-cased, in order, without making the words.

    A word's hash is the difference of two prefix sums of its polynomial, scaled to position 0. Long texts go in
    blocks that end at white space; a word longer than a block is hashed alone.
    """
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    up, down = _powers()
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + _BLOCK - 1)
        if end < len(raw):
            spaces = np.flatnonzero(_SPACE[raw[at:end]])
            if len(spaces):
                end = at + int(spaces[-1]) + 1
            else:  # the block lies inside one long word
                after = np.flatnonzero(_SPACE[raw[end:]])
                stop = end + (int(after[0]) if len(after) else len(raw) - end)
                h = 0
                for b in _LOWER[raw[at:stop]].tolist()[::-1]:
                    h = (h * _BASE + b + 1) & 0xFFFFFFFFFFFFFFFF
                out.append(mix64(np.array([h], np.uint64) + np.uint64(stop - at)))
                at = stop
                continue
        part = raw[at:end]
        space = _SPACE[part]
        edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1, append=1))
        starts, stops = edge[::2], edge[1::2]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((_LOWER[part] + np.uint64(1)) * up[: len(part)], out=sums[1:])
        h = (sums[stops] - sums[starts]) * down[starts]
        out.append(mix64(h + (stops - starts).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def column_arrays(batch: pa.RecordBatch, *names: str) -> Iterator[list]:
    """Columns of a batch as Python lists."""
    return (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)
