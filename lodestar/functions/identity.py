"""Identity of works from titles and paths, as JVM-side expressions."""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.strings import clean, folded, hashed_id, let, parent

# Labels of recordings that say nothing about the work, removed in this order.
RECORDING_LABELS = (
    r"\s*-\s*Live\b.*$",
    r"\s*\(Live[^)]*\)",
    r"\bLive\b",
    r"\s*-\s*Remastered\b.*$",
    r"\s*\(Remastered[^)]*\)",
    r"\bRemastered\b",
    r"\bDigitally\s+Remastered\b",
    r"\s*-\s*\d{4}\s*Recording\b",
    r"\s*\(\d{4}\s*Recording\)",
    r"\b\d{4}\s*Recording\b",
    r"\s*-\s*iTunes;\s*Bonus\b",
    r"\biTunes;\s*Bonus\b",
    r"\bBonus\b",
)
# Words that leave the instrumentation open.
OPEN_INSTRUMENTATION = (
    "horn", "sehnsucht", "lied", "liriche", "duo", "two pianos", "2 pianos", "orchestra", "concerto", "symphony", "violin", "cello",
    "string", "quartet", "choral", "voice",
)
# Later catalogue numbers of the same works.
ALTERNATES = {"189h": "283", "189a": "283", "300i": "331", "300h": "331", "496a": "487", "496": "487", "385g": "397"}
# Roman numbers of movements.
ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10", "xi": "11", "xii": "12"}
# Catalogue numbers after K or KV, and numbers alone in brackets.
CATALOGUE = r"(?i)\bK(?:V)?\.?\s*([0-9]+[A-Za-z0-9]*(?::[0-9]+[A-Za-z0-9]*)?(?:-[0-9]+[A-Za-z0-9]*)?)"
IN_BRACKETS = r"\(\s*([0-9]+[A-Za-z]*)\s*\)"
# Places of a movement in a title (after a colon, in a pair, after a sonata's number, as an ordinal, after
# an opus) and in the name of a folder (in a pair, before a dot or underscore, as an ordinal).
AFTER_COLON = r":\s*([IVX]+|[0-9]+)\s*[.:]"
IN_PAIR = r"\b(\d+)\s*-\s*(\d+)\b"
OF_SONATA = r"(?i)Sonata\s*(\d+)\s*(\d+)(?:st|nd|rd|th)?"
ORDINAL = r"(?i)\b(\d+)(?:st|nd|rd|th)\b"
OF_OPUS = r"(?i)Op\.?\s*(\d+)\s+(\d+)\b"
FOLDER_PAIR = r"(\d+)\s*-\s*(\d+)"
FOLDER_NUMBER = r"^\s*([0-9]+|[IVX]+)[._]"
FOLDER_ORDINAL = r"(?i)^\s*([0-9]+)(?:st|nd|rd|th)"
# Composers by a part of their name, and their period.
COMPOSERS = {"chopin": ("Chopin", "Romantic"), "mozart": ("Mozart", "Classical"), "bach": ("Bach", "Baroque")}


def _lookup(key: Column, values: dict[str, str]) -> Column:
    """The value of a key, else the key."""
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), key)


def composer(c: Column) -> Column:
    """The short name of a known composer, by a part of the name without case and accents, else the trimmed name."""
    known = lambda name: F.coalesce(*[F.when(name.contains(part), short) for part, (short, _) in COMPOSERS.items()])
    return let(clean(c), lambda t: F.coalesce(let(folded(t), known), t))


def period(c: Column) -> Column:
    """The period of a known composer, else ``""``."""
    return let(composer(c), lambda name: F.coalesce(*[F.when(name == short, when) for short, when in COMPOSERS.values()], F.lit("")))


def without_labels(title: Column) -> Column:
    """A title without recording labels, squeezed, without a dash or empty brackets at its end."""
    t = clean(title)
    for pattern in RECORDING_LABELS:
        t = F.regexp_replace(t, f"(?i){pattern}", "")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    t = F.trim(F.regexp_replace(t, r"\s*-\s*$", ""))
    return F.trim(F.regexp_replace(t, r"\s*\(\s*\)", ""))


def catalogue_tokens(text: Column) -> Column:
    """Catalogue numbers after K or KV in order; with any of them, numbers alone in brackets too."""
    main = F.regexp_extract_all(text, F.lit(CATALOGUE), F.lit(1))
    alone = F.regexp_extract_all(text, F.lit(IN_BRACKETS), F.lit(1))
    return let(main, lambda m: F.when(F.size(m) > 0, F.concat(m, F.array_except(alone, m))).otherwise(F.array().cast("array<string>")))


def catalogue(tokens: Column) -> Column:
    """The number compared: the last token, lower-cased, a simple one by its primary number; null without tokens."""
    last = lambda t: F.replace(F.lower(F.trim(F.try_element_at(t, F.size(t)))), F.lit(" "), F.lit(""))
    primary = lambda x: F.when(x.contains(":") | x.contains("-"), x).otherwise(_lookup(x, ALTERNATES))
    return let(tokens, lambda t: F.when(F.size(t) > 0, let(last(t), primary)))


def movement(value: Column) -> Column:
    """A movement as an Arabic number if it is a Roman or Arabic one, without dots, ordinal endings and zeros."""
    s = F.trim(F.regexp_replace(F.replace(F.lower(clean(value)), F.lit("."), F.lit("")), "(st|nd|rd|th)$", ""))
    number = lambda s: F.regexp_replace(_lookup(s, ROMAN), "^0+(?=[0-9])", "")
    return let(let(s, number), lambda n: F.when(n != "", n))


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return let(F.regexp_extract(text, pattern, group), lambda x: F.when(x != "", x))


def movement_in_title(title: Column, short_name: Column, stripped: bool = False) -> Column:
    """The movement that a title names; rules in order, some for one composer only. ``stripped``: without labels already."""

    def found(t: Column) -> Column:
        sonata = F.lower(t).contains("sonata")
        after_colon = _found(t, AFTER_COLON)
        pair = F.when(sonata & short_name.isin("Mozart", "Chopin"), _found(t, IN_PAIR, 2))
        numbered = _found(t, OF_SONATA, 2)
        ordinal = F.when(sonata, _found(t, ORDINAL))
        etude = F.when(F.lower(t).contains("etude"), _found(t, OF_OPUS, 2))
        return F.coalesce(after_colon, pair, F.when(short_name == "Chopin", F.coalesce(numbered, ordinal, etude)))

    return movement(let(title if stripped else without_labels(title), found))


def movement_in_path(path: Column) -> Column:
    """The movement that the folder of a file names."""
    leaf = F.substring_index(parent(path), "/", -1)
    return movement(let(leaf, lambda x: F.coalesce(_found(x, FOLDER_PAIR, 2), _found(x, FOLDER_NUMBER), _found(x, FOLDER_ORDINAL))))


def is_open_instrumentation(title: Column) -> Column:
    """Whether a title leaves its instrumentation open."""
    return functools.reduce(lambda a, b: a | b, [F.lower(clean(title)).contains(w) for w in OPEN_INSTRUMENTATION])


def analysis_work_id(name: Column, number: Column, part: Column) -> Column:
    """The same id for the same composer, catalogue number and movement."""
    return hashed_id("aw_", F.lower(composer(name)), F.lower(clean(number)), F.lower(clean(part)))


def with_identity(df: DataFrame, name: str, title: str, path: str) -> DataFrame:
    """``df`` with catalogue_number, movement_number, title_number, path_number and work_key."""
    title_number = catalogue(catalogue_tokens(F.col(title)))
    path_number = catalogue(catalogue_tokens(F.replace(F.col(path), F.lit("_"), F.lit(" "))))
    short = composer(F.col(name))
    # steps in projections of their own: each is used several times by the next
    rows = df.withColumns({"title_number": title_number, "path_number": path_number, "__short": short, "__title": without_labels(F.col(title))})
    rows = rows.withColumn("catalogue_number", F.coalesce("title_number", "path_number"))
    rows = rows.withColumn("movement_number", F.coalesce(movement_in_title(F.col("__title"), F.col("__short"), stripped=True), movement_in_path(F.col(path))))
    return rows.withColumn("work_key", analysis_work_id(F.col("__short"), F.col("catalogue_number"), F.col("movement_number"))).drop("__short", "__title")


def group_conflicts(identified: DataFrame, group: str, more: Mapping[str, Column] | None = None) -> DataFrame:
    """Per group: several catalogue numbers or movements, title and path that differ, missing evidence, and ``more`` aggregates."""
    apart = F.col("title_number").isNotNull() & F.col("path_number").isNotNull() & (F.col("title_number") != F.col("path_number"))
    rows = identified.groupBy(group).agg(
        F.array_sort(F.collect_set("catalogue_number")).alias("numbers"), F.array_sort(F.collect_set("movement_number")).alias("movements"),
        F.count_if(apart).alias("mismatches"), F.count_if(F.col("catalogue_number").isNull()).alias("without_number"),
        *[c.alias(n) for n, c in (more or {}).items()],
    )
    conflict = (F.size("numbers") > 1) | (F.size("movements") > 1)
    return rows.select(group, F.array_join("numbers", ";").alias("numbers"), F.array_join("movements", ";").alias("movements"), "mismatches", "without_number", conflict.alias("conflict"), *(more or {}))


def decide(rows: DataFrame) -> Column:
    """The decision on a group, first rule that holds: represented, quarantined, uncertain, ambiguous, approved."""
    return (
        F.when(F.col("represented"), "already_represented")
        .when(F.col("conflict") | (F.col("mismatches") > 0), "quarantined")
        .when(F.col("open_instrumentation"), "uncertain")
        .when(F.col("numbers") == "", "ambiguous")
        .otherwise("approved")
    )
