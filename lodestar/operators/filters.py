"""Filters, gates and classifications of catalogue rows as Column expressions, and scopes of whole inventories."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.strings import clean, folded, folded_contains, is_inside, suffix, whole

# Other names of prompt families, titles left out, and names of window methods.
FAMILY_ALIASES = {"emotional": "emotion", "formal": "literal"}
METHODS = {
    "complete_movement": ("complete_movement", None), "complete": ("complete_movement", None), "fixed_4_bars": ("fixed_bar_window", 4), "4": ("fixed_bar_window", 4),
    "fixed_8_bars": ("fixed_bar_window", 8), "8": ("fixed_bar_window", 8), "fixed_16_bars": ("fixed_bar_window", 16), "16": ("fixed_bar_window", 16), "phrase": ("phrase", None),
    "cadence": ("cadence", None), "user_range": ("user_range", None), "user": ("user_range", None),
}
STAGES = {"symbolic": "score", "audio": "recording_audio", "audio_chunks": "audio_chunk", "text": "text_prompt"}
SCORES, MIDI = (".xml", ".musicxml", ".mxl"), (".mid", ".midi")


def _map(values: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def of_family(family: Column, wanted: str | None) -> Column:
    """Equality of family names without regard to case; some names have an alias. No request matches all."""
    if not wanted:
        return F.lit(True)
    return F.lower(clean(family)) == FAMILY_ALIASES.get(wanted.lower(), wanted).lower()


def of_composer(name: Column, wanted: str | None, work: Column | None = None, work_id: str | None = None) -> Column:
    """Rows of a composer, by a part of the name without case and accents, and on request of one work."""
    keep = folded_contains(name, wanted or "")
    return keep & (work == work_id) if work is not None and work_id else keep


def rights_authorized(status: Column, allowed: Sequence[str]) -> Column:
    """Membership without regard to case and outer spaces."""
    return F.lower(clean(status)).isin(*[a.strip().lower() for a in allowed])


def excluded_title(title: Column, patterns: Sequence[str]) -> Column:
    """Whether a title contains any of some texts, without regard to case."""
    return functools.reduce(lambda a, b: a | b, [F.lower(clean(title)).contains(p.lower()) for p in patterns], F.lit(False))


def discovery_gate(composer: Column, composers: Sequence[str], dataset: Column, wanted: str, tier: Column, duplicate: Column, quality: Column, bad: Sequence[str], path: Column) -> Column:
    """All of: a wanted composer and dataset, the upper tier, no duplicate, no bad quality, a path."""
    return composer.isin(*composers) & (dataset == wanted) & (tier == "True") & (duplicate != "True") & ~quality.isin(*bad) & (clean(path) != "")


def with_columns(df: DataFrame, names: Sequence[str], only: bool = False, value: str = "") -> DataFrame:
    """``df`` with the columns that it lacks, filled with one value; ``only`` these, in this order, on request."""
    out = df.withColumns({n: F.lit(value) for n in names if n not in df.columns})
    return out.select(*names) if only else out


def numeric_columns(df: DataFrame, declared: Sequence[str]) -> list[str]:
    """The declared columns that ``df`` has as numbers, in the declared order."""
    numbers = {n for n, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")}
    return [c for c in declared if c in numbers]


def item_type(stage: Column, modality: Column, path: Column) -> Column:
    """What the rows of a bundle are: by its stage, for passages with their modality, else by a folder named audio."""
    modality = F.coalesce(F.nullif(clean(modality), F.lit("")), F.regexp_extract(stage, "^passages_(.*)$", 1))
    audio = F.array_contains(F.split(clean(path), "/"), "audio")
    return F.coalesce(
        F.try_element_at(_map(STAGES), clean(stage)), F.when(clean(stage).startswith("passages_"), F.concat(F.lit("passage_"), modality)), F.when(audio, "audio"), F.lit("unknown")
    )


def artifact_kind(stage: Column, path: Column) -> Column:
    """The stage, or else what the folder's name and its parent's say."""
    parts = F.split(F.regexp_replace(clean(path), "/+$", ""), "/")
    name, above = F.element_at(parts, -1), F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    by_name = (
        F.when(name.isin("text", "symbolic"), name).when(name == "performance_midi", "passages_performance_midi")
        .when((name == "audio") & (above == "passages"), "passages_audio").when(name == "passages", "passages_symbolic").otherwise(F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown")))
    )
    return F.coalesce(F.nullif(clean(stage), F.lit("")), by_name)


def window_modes(methods: Column) -> Column:
    """Aggregate: the distinct window sizes or method names, shortest first, joined by commas."""
    size = F.regexp_extract(methods, "^fixed_(.*)_bars$", 1)
    mode = F.when(methods.rlike("^fixed_.*_bars$"), size).otherwise(methods)
    return F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(F.length(mode).alias("n"), mode.alias("m")))), lambda s: s["m"]), ",")


def inventory(rows: DataFrame, keys: Sequence[str], composer: str, method: str) -> DataFrame:
    """(keys, window_modes, composer_scope): the scope counts rows by composer, ``name=count`` in order of the names."""
    counts = rows.filter(clean(F.col(composer)) != "").groupBy(*keys, composer).agg(F.count(F.lit(1)).alias("n"))
    each = F.transform(F.array_sort(F.collect_list(F.struct(F.col(composer).alias("c"), "n"))), lambda s: F.concat(s["c"], F.lit("="), s["n"].cast("string")))
    scope = counts.groupBy(*keys).agg(F.array_join(each, "; ").alias("composer_scope"))
    modes = rows.groupBy(*keys).agg(window_modes(F.col(method)).alias("window_modes"))
    return modes.join(scope, list(keys), "left").fillna("", ["composer_scope"])


def method_spec(name: Column) -> Column:
    """(method, bars) of the name of a window method; null for an unknown one."""
    kinds = F.try_element_at(_map({k: v[0] for k, v in METHODS.items()}), name)
    bars = F.try_element_at(_map({k: str(v[1]) for k, v in METHODS.items() if v[1]}), name).cast("int")
    return F.when(kinds.isNotNull(), F.struct(kinds.alias("method"), bars.alias("bars")))


def classified_sources(df: DataFrame, material: str, paths: Sequence[str], midi: str, exists: str, start: str, end: str) -> DataFrame:
    """``df`` with source_path, category and error_category: the first rule of an ordered list that holds for a row.

    Performance MIDI is unsupported; the source is the first path that is given, else the MIDI path; then no path, a MIDI
    suffix, another suffix, none, a path that leaves its root, a file that does not exist, bars that are no range.
    """
    given = [F.nullif(clean(F.col(c)), F.lit("")) for c in (*paths, midi)]
    rows = df.withColumn("source_path", F.coalesce(*given, F.lit("")))
    path, kind = F.col("source_path"), suffix(F.col("source_path"))
    low, high = whole(F.col(start).cast("string")), whole(F.col(end).cast("string"))
    rules = [
        (clean(F.col(material)) == "performance_midi", "unsupported", "unsupported_midi_source"),
        (path == "", "failure", "missing_source_path"),
        (kind.isin(*MIDI), "unsupported", "unsupported_midi_source"),
        ((kind == "") | ~kind.isin(*SCORES), "unsupported", "unsupported_source"),
        (~is_inside(path), "failure", "invalid_source_path"),
        (~F.col(exists), "missing", "missing_source"),
        (low.isNull() | high.isNull() | (low < 1) | (high < low), "failure", "invalid_bar_coordinates"),
    ]
    first = lambda k: functools.reduce(lambda e, r: e.when(r[0], r[k]), rules[1:], F.when(rules[0][0], rules[0][k]))
    return rows.withColumns({"category": first(1).otherwise("ok"), "error_category": first(2).otherwise("")})


def score_candidates(scores: DataFrame, works: DataFrame, compositions: DataFrame, least_measures: int, composers: Sequence[str] = ()) -> DataFrame:
    """Scores with the titles of their works and ``reason``, why one is left out; ``""`` for what may be selected.

    Reasons in order: the format, a file that is not there, a digest that differs from the expected one (if that has 64
    digits), a score that cannot be read (its ``parse_error``), too few measures. Scores without a work stay, without titles.
    """
    w = works.select("work_id", F.col("title").alias("work_title"), "composition_id")
    c = compositions.select("composition_id", "composer", F.col("title").alias("composition_title"))
    rows = scores.join(w, "work_id", "left").join(c, "composition_id", "left")
    rows = rows.withColumns({"composer": clean(F.col("composer")), "title": F.coalesce(F.nullif(clean(F.col("work_title")), F.lit("")), clean(F.col("composition_title")))})
    if composers:
        rows = rows.filter(folded(F.col("composer")).isin(*[c.lower() for c in composers]))
    expected = F.lower(clean(F.col("sha256")))
    reason = (
        F.when(~suffix(F.col("source_file_path")).isin(*SCORES, *MIDI), "unsupported_score_format").when(~F.col("file_exists"), "score_file_missing")
        .when((F.length(expected) == 64) & (expected != F.col("found_sha256")), "score_sha256_mismatch").when(clean(F.col("parse_error")) != "", F.col("parse_error"))
        .when(F.col("measures") < least_measures, F.concat(F.lit("too_few_measures:"), F.col("measures").cast("string"))).otherwise("")
    )
    return rows.select("score_version_id", "work_id", "composition_id", "composer", "title", "source_dataset", "source_file_path", "measures", reason.alias("reason"))


def format_priority(path: Column) -> Column:
    """The order in which formats are preferred."""
    kind = suffix(path)
    return F.when(kind == ".musicxml", 0).when(kind == ".xml", 1).when(kind == ".mxl", 2).when(kind.isin(*MIDI), 3).otherwise(9)
