"""Windows over ordinal positions, boundary islands, interval coverage and derived offsets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fixed_windows(df: DataFrame, low: str, high: str, size: int, stride: int | None = None) -> DataFrame:
    """Tumbling or sliding windows of ``size`` positions inside [low, high]; an incomplete tail is dropped."""
    step = stride or size
    label = f"fixed_{size}_bars" + (f"_stride_{step}" if step != size else "")
    last = F.col(high) - (size - 1)
    starts = F.when(F.col(low) <= last, F.sequence(F.col(low), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    rows = df.withColumn("bar_start", F.explode(starts))
    return rows.withColumn("bar_end", F.col("bar_start") + (size - 1)).withColumn("method", F.lit(label))


def window_modes(df: DataFrame, low: str, high: str, sizes: Sequence[int]) -> DataFrame:
    """The whole range and its tumbling windows of some sizes, each range once, of the earliest mode that has it.

    Whether an earlier mode has a range is told by its place, in the row of the movement: nothing is sorted or moved.
    """
    first, last = F.col(low), F.col(high)
    modes = [F.array(_range(first, last, "complete_movement"))]
    for size in dict.fromkeys(sizes):
        latest = last - (size - 1)
        starts = F.when(first <= latest, F.sequence(first, latest, F.lit(size))).otherwise(F.array().cast("array<int>"))
        each = F.transform(starts, _of_size(size))
        modes.append(F.when(last - first == size - 1, F.array().cast("array<struct<bar_start:int,bar_end:int,method:string>>")).otherwise(each))
    return df.select(*[c for c in df.columns if c not in (low, high)], F.inline(F.flatten(F.array(*modes))))


def _range(start: Column, end: Column, method: str) -> Column:
    return F.struct(start.alias("bar_start"), end.alias("bar_end"), F.lit(method).alias("method"))


def _of_size(size: int):
    return lambda s: _range(s, s + (size - 1), f"fixed_{size}_bars")


def chunks(df: DataFrame, length: str, size: float, overlap: float) -> DataFrame:
    """Chunks of ``size`` with ``overlap`` over [0, length]; the partial last chunk is kept, none starts at the end."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.col(length) - overlap) / step)).cast("int")
    rows = df.filter(F.col(length) > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1)))
    rows = rows.withColumn("start", F.col("chunk") * step)
    return rows.withColumn("end", F.least(F.col(length), F.col("start") + size))


def islands(boundaries: DataFrame, keys: Sequence[str], at: str, low: str, high: str, tail: bool) -> DataFrame:
    """Ranges between successive boundaries; the range after the last one only with ``tail``."""
    inside = boundaries.filter((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high)))
    kind = dict(inside.dtypes)[at]
    # a movement's boundaries are no more than its positions, and are ranges in its own row
    rows = inside.groupBy(*keys, low, high).agg(F.array_sort(F.collect_set(at)).alias("__at"))
    return rows.select(*keys, F.inline(_between(F.col("__at"), F.col(low), F.col(high), kind, tail)))


def _between(marks: Column, low: Column, high: Column, kind: str, tail: bool) -> Column:
    """(bar_start, bar_end) between sorted marks, and after the last one with ``tail``."""
    span = lambda a, b: F.struct(a.cast(kind).alias("bar_start"), b.cast(kind).alias("bar_end"))
    ranges = F.transform(marks, lambda m, k: span(F.when(k == 0, low).otherwise(F.get(marks, k - 1) + 1), m))
    if not tail:
        return ranges
    last = F.element_at(marks, -1)
    return F.concat(ranges, F.when(last < high, F.array(span(last + 1, high))).otherwise(F.array().cast(f"array<struct<bar_start:{kind},bar_end:{kind}>>")))


def parse_ranges(df: DataFrame, text: str, low: str, high: str) -> DataFrame:
    """``A-B`` or ``A:B`` items of a comma-separated text, kept if inside [low, high] and in order."""
    rows = df.withColumn("__item", F.explode(F.split(text, ",")))
    part = lambda k: F.regexp_extract("__item", r"^\s*(\d+)\s*[-:]\s*(\d+)\s*$", k).try_cast("int")
    rows = rows.withColumn("bar_start", part(1)).withColumn("bar_end", part(2)).drop("__item")
    return rows.filter((F.col("bar_start") >= F.col(low)) & (F.col("bar_end") <= F.col(high)) & (F.col("bar_start") <= F.col("bar_end")))


def coverage(ranges: DataFrame, events: DataFrame, keys: Sequence[str], at: str, onset: str, offset: str, bucket: int = 64) -> DataFrame:
    """Each range with its covered positions, missing positions and time span.

    A range join with events at positions inside [bar_start, bar_end]. Both sides are dealt by key and bucket of
    positions, so a long recording spreads over tasks and every candidate pair shares a bucket. Only events with a
    positive interval count; a range without all positions has no time span.
    """
    ranges = ranges.withColumn("__range", F.struct(*keys, "bar_start", "bar_end"))
    wide = ranges.withColumn("__b", F.explode(F.sequence(F.floor(F.col("bar_start") / bucket), F.floor(F.col("bar_end") / bucket))))
    use = events.filter(F.col(offset) > F.col(onset)).select(*keys, F.col(at).alias("__at"), F.col(onset).alias("__on"), F.col(offset).alias("__off"))
    use = use.withColumn("__b", F.floor(F.col("__at") / bucket))
    hit = wide.join(use, [*keys, "__b"]).filter((F.col("__at") >= F.col("bar_start")) & (F.col("__at") <= F.col("bar_end")))
    # one row per range and position first: the sums combine before they meet
    each = hit.groupBy("__range", "__at").agg(F.min("__on").alias("on"), F.max("__off").alias("off"))
    found = each.groupBy("__range").agg(F.array_sort(F.collect_set("__at")).alias("seen"), F.min("on").alias("on"), F.max("off").alias("off"))
    rows = ranges.select("__range").distinct().join(found, "__range", "left")
    expected = F.sequence(F.col("__range.bar_start"), F.col("__range.bar_end"))
    seen = F.coalesce(F.col("seen"), F.array().cast("array<int>"))
    missing = F.array_except(expected, seen.cast("array<int>"))
    full = F.size(missing) == 0
    return rows.select(
        "__range.*", F.size(seen).cast("long").alias("covered"), F.size(expected).cast("long").alias("expected"), missing.alias("missing"),
        F.when(full, F.col("on")).alias("time_start"), F.when(full, F.col("off")).alias("time_end"),
    )


def offsets(events: DataFrame, keys: Sequence[str], at: str, time: str, length: str, lone: float = 0.0, flat: bool = False, more: Mapping[str, Column] | None = None) -> DataFrame:
    """(keys, position, onset, offset): onset is the first time of a position and offset the next onset.

    The last position ends a median positive step (``lone`` if there is none) after the latest time, at least a thousandth after its onset and at
    most at the recording's end; intervals that are not positive are dropped, or with ``flat`` have null times. ``more``:
    further aggregates of a position's events.

    Events are dealt out by key once and go on as they lie: each carries its step, and a position the median of its key.
    """
    sound = events.filter((F.col(at) >= 1) & (F.col(time) >= 0))
    w = Window.partitionBy(*keys)
    before = F.lag(time).over(w.orderBy(time))
    steps = sound.withColumn("__step", F.when(F.col(time) > before, F.col(time) - before)).withColumn("__median", F.median("__step").over(w))
    more = more or {}
    rows = steps.groupBy(*keys, at).agg(F.min(time).alias("__onset"), F.max(time).alias("__latest"), F.max(length).alias("__length"), F.max("__median").alias("__median"), *[c.alias(n) for n, c in more.items()])
    end = F.max("__latest").over(w) + F.coalesce(F.col("__median"), F.lit(lone))
    last = F.least(F.greatest(end, F.col("__onset") + 1e-3), F.col("__length"))
    rows = rows.withColumn("__offset", F.coalesce(F.lead("__onset").over(w.orderBy(at)), last))
    long = F.col("__offset") > F.col("__onset")
    rows = rows if flat else rows.filter(long)
    return rows.select(*keys, at, F.when(long, F.col("__onset")).alias("onset"), F.when(long, F.col("__offset")).alias("offset"), *more)


def interpolate(anchors: DataFrame, queries: DataFrame, keys: Sequence[str], x: str, y: str, keep: Sequence[str] = ()) -> DataFrame:
    """Values at ``queries.x`` on the monotone piecewise-linear curve through a key's anchors.

    Anchors at one x are replaced by their median, y is made non-decreasing, ends go on at the last slope and never
    below zero; a key with one anchor is constant, one without has null. Each anchor carries the slope that follows it (the
    last one the slope before it); a query takes the last anchor at or before it, else the key's first. ``keep``: further columns
    of the queries.
    """
    point = anchors.groupBy(*keys, F.col(x).cast("double").alias("__x")).agg(F.median(y).alias("__y"))
    w = Window.partitionBy(*keys).orderBy("__x")
    point = point.withColumn("__y", F.max("__y").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    step = lambda f, sign: F.try_divide(sign * (f("__y").over(w) - F.col("__y")), sign * (f("__x").over(w) - F.col("__x")))
    slope = F.coalesce(step(F.lead, 1), step(F.lag, -1), F.lit(0.0))
    kind = dict(queries.dtypes)[x]
    kept = dict(queries.select(*keep).dtypes) if keep else {}
    curve = point.select(*keys, *[F.lit(None).cast(t).alias(c) for c, t in kept.items()], F.lit(None).cast(kind).alias(x), "__x", F.struct("__x", "__y", slope.alias("s")).alias("__a"), F.lit(0).alias("__q"))
    asked = queries.toDF(*queries.columns).select(*keys, *keep, x, F.col(x).cast("double").alias("__x"), F.lit(None).cast("struct<__x:double,__y:double,s:double>").alias("__a"), F.lit(1).alias("__q"))
    line = Window.partitionBy(*keys).orderBy("__x", "__q").rowsBetween(Window.unboundedPreceding, 0)
    at = F.coalesce(F.last("__a", ignorenulls=True).over(line), F.min("__a").over(Window.partitionBy(*keys)))
    rows = curve.unionByName(asked).withColumn("__at", at).filter("__q = 1")
    value = F.col("__at.__y") + (F.col("__x") - F.col("__at.__x")) * F.col("__at.s")
    return rows.select(*keys, *keep, x, F.when(F.col("__at").isNotNull(), F.greatest(value, F.lit(0.0))).alias("value"))


def note_timings(measures: DataFrame, notes: DataFrame, keys: Sequence[str], length: Column | None = None) -> DataFrame:
    """Measures at the times of a performance: (keys, measure, onset_seconds, offset_seconds, confidence).

    Notes that are matched or interpolated, with three numbers each, are the anchors of a curve from score to
    performance; both ends of a measure are read off it, cut at 0 and at the recording's ``length``, and measures without
    a positive interval are dropped. The confidence is the least of the anchors'.
    """
    numbers = {c: F.col(c).try_cast("double") for c in ("score_onset", "performance_onset", "confidence")}
    use = notes.filter(F.lower(F.trim("mapping_state")).isin("matched", "interpolated")).withColumns(numbers).dropna(subset=list(numbers))
    ends = measures.select(*keys, "measure", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).cast("double").alias("score_onset")) for k, c in enumerate(("start_seconds", "end_seconds"))])).alias("e"))
    asked = ends.select(*keys, "measure", "e.k", "e.score_onset").filter("score_onset is not null")
    # both ends of a measure go through the curve as they are; a key without anchors has no values
    at = interpolate(use.select(*keys, "score_onset", "performance_onset"), asked, keys, "score_onset", "performance_onset", keep=["measure", "k"]).filter("value is not null")
    value = F.least(F.col("value"), length) if length is not None else F.col("value")
    both = at.groupBy(*keys, "measure").agg(F.max(F.when(F.col("k") == 0, value)).alias("onset_seconds"), F.max(F.when(F.col("k") == 1, value)).alias("offset_seconds"))
    trust = use.groupBy(*keys).agg(F.min("confidence").alias("confidence"))
    return both.filter("offset_seconds > onset_seconds").join(trust, list(keys))
