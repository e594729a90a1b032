"""From a star of catalogue tables to passages with times: eligibility, best sources, tempo maps, readiness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.strings import clean, suffix
from lodestar.operators.catalogue import first_by

# Names of major and minor keys by their fifths, from -7 to 7.
MAJOR_KEYS = ("C-flat", "G-flat", "D-flat", "A-flat", "E-flat", "B-flat", "F", "C", "G", "D", "A", "E", "B", "F-sharp", "C-sharp")
MINOR_KEYS = ("A-flat", "E-flat", "B-flat", "F", "C", "G", "D", "A", "E", "B", "F-sharp", "C-sharp", "G-sharp", "D-sharp", "A-sharp")


def key_label(fifths: Column, mode: Column) -> Column:
    """The name of a key signature; without a mode both readings, without fifths "unspecified key signature"."""
    name = lambda names: F.coalesce(F.try_element_at(F.array(*[F.lit(n) for n in names]), (fifths + 8).cast("int")), F.lit("unknown"))
    inside = fifths.between(-7, 7)
    major, minor = (F.when(inside, name(n)).otherwise("unknown") for n in (MAJOR_KEYS, MINOR_KEYS))
    m = clean(mode)
    label = F.when(m == "major", F.concat(major, F.lit(" major"))).when(m == "minor", F.concat(minor, F.lit(" minor")))
    return F.when(fifths.isNull(), "unspecified key signature").otherwise(F.coalesce(label, F.concat(major, F.lit(" major / "), minor, F.lit(" minor key signature"))))


def meter_label(beats: Column, beat_type: Column) -> Column:
    """``3/4``, or "unspecified meter"."""
    return F.when((clean(beats) != "") & (clean(beat_type) != ""), F.concat_ws("/", beats, beat_type)).otherwise("unspecified meter")


def eligible(media: Column, checked: Column, aligned: Column, path: Column, extensions: Sequence[str]) -> Column:
    """All of: the medium is wanted, quality control passed, an alignment exists, the extension is readable."""
    return media & (F.lower(clean(checked)) == "passed") & aligned & suffix(path).isin(*extensions)


def representative(df: DataFrame, key: str, order: Sequence[Column | str], candidates: Sequence[str], defaults: Sequence[str], supported: Sequence[str]) -> DataFrame:
    """One row per key, the first in an order, with its ``source_path`` and ``availability``.

    Candidates are path columns by rank; the row's value goes before the default of the key. The first candidate with
    a supported extension is taken (pending), else the first at all (unsupported), else none (unavailable).
    """
    rows = first_by(df, [key], order)
    paths = F.array_compact(F.array(*[F.coalesce(F.nullif(clean(F.col(c)), F.lit("")), F.nullif(clean(F.col(d)), F.lit(""))) for c, d in zip(candidates, defaults, strict=True)]))
    rows = rows.withColumn("__p", paths).withColumn("__ok", F.filter("__p", lambda p: F.lower(F.regexp_extract(p, r"(\.[^./]+)$", 1)).isin(*supported)))
    path = F.coalesce(F.get("__ok", F.lit(0)), F.get("__p", F.lit(0)), F.lit(""))
    state = F.when(F.size("__ok") > 0, "pending").when(F.size("__p") > 0, "unsupported").otherwise("unavailable")
    return rows.withColumns({"source_path": path, "availability": state}).drop("__p", "__ok")


def tempo_times(beats: DataFrame, keys: Sequence[str], at: str, length: str, tempo: str, default: float = 120.0) -> DataFrame:
    """Start and end seconds of measures: a running sum of lengths in quarters over the tempo in force."""
    w = Window.partitionBy(*keys).orderBy(at)
    force = F.coalesce(F.last(tempo, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(default))
    rows = beats.withColumn("__s", F.col(length) * 60.0 / force)
    end = F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"start_seconds": end - F.col("__s"), "end_seconds": end}).drop("__s")


def bundle_violations(rows: DataFrame, item: str, size: int) -> DataFrame:
    """(rule, n) of a vector table: presence, width, soundness, unique ids, explicit states."""
    from lodestar.functions.vectors import is_sound
    from lodestar.operators.quality import violations

    w = Window.partitionBy(item)
    rows = rows.withColumn("__n", F.count(F.lit(1)).over(w))
    good = F.col("status") == "success"
    return violations(rows, item, {
        "id is empty": clean(F.col(item)) == "", "id is not unique": F.col("__n") > 1, "success without a vector": good & F.col("embedding").isNull(),
        "failure with a vector": ~good & F.col("embedding").isNotNull(), "width is wrong": F.size("embedding") != size,
        "vector is not sound": F.col("embedding").isNotNull() & ~is_sound(F.col("embedding")), "state is unknown": ~F.col("status").isin("success", "failed", "unsupported", "unavailable"),
    }).select("rule", "n")
