"""String expressions of catalogues: cleaning, identifiers, paths, permissive parsing."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column, nan_is_missing: bool = False) -> Column:
    """Trimmed text with null as ``""``; on request the text "nan" too."""
    t = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.lower(t) == "nan", "").otherwise(t) if nan_is_missing else t


def _bare(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


@functools.cache
def _decompositions() -> tuple[str, str, dict[str, str]]:
    """Letters that decompose to one character without marks, those characters, and letters that decompose to several.

    Made from the Unicode tables: Latin, Greek and Cyrillic letters, full-width forms, and signs like Roman numerals.
    """
    ranges = ((0xAA, 0x250), (0x370, 0x530), (0x1E00, 0x2000), (0x2070, 0x20A0), (0x2100, 0x2190), (0xFB00, 0xFB07), (0xFF01, 0xFF5F))
    found = {chr(i): _bare(chr(i)) for low, high in ranges for i in range(low, high)}
    one = {c: b for c, b in found.items() if len(b) == 1 and b != c}
    return "".join(one), "".join(one.values()), {c: b for c, b in found.items() if len(b) > 1}


@functools.cache
def _several_class() -> str:
    """A pattern of the letters that decompose to several, by ranges: a pattern of single letters tests each of them."""
    points = sorted(map(ord, _decompositions()[2]))
    starts = [p for p in points if p - 1 not in points]
    ends = [p for p in points if p + 1 not in points]
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(starts, ends, strict=True)) + "]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once, as the element of an array of one, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def unaccented(c: Column) -> Column:
    """Text in compatibility decomposition without combining marks: letters lose their accents, ligatures fall apart."""
    ones, bare, several = _decompositions()
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in several.items()])
    rare = lambda plain: F.aggregate(pairs, plain, lambda x, kv: F.replace(x, kv["k"], kv["v"]))
    plain_of = lambda t: F.translate(F.regexp_replace(t, r"\p{M}+", ""), ones, bare)
    some = lambda plain: F.when(plain.rlike(_several_class()), rare(plain)).otherwise(plain)
    return let(c, lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), let(plain_of(t), some)).otherwise(t))


def folded(c: Column) -> Column:
    """Text without accents and case, for comparison."""
    return F.replace(F.lower(unaccented(clean(c))), F.lit("ß"), F.lit("ss"))


def ascii_slug(c: Column, default: str = "passage") -> Column:
    """A slug of the ASCII characters alone: other letters are dropped, not decomposed."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(clean(c), r"[^\x00-\x7F]", "")), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(s, r"\A\z", default)


def slug(c: Column, default: str = "none") -> Column:
    """Accents dropped, runs of anything but ASCII letters and digits as one dash, no dashes at the ends, lower case."""
    s = F.lower(F.regexp_replace(F.regexp_replace(unaccented(clean(c)), "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))
    return F.regexp_replace(s, r"\A\z", default)


def humanize(c: Column) -> Column:
    """Underscores and runs of white space as one space."""
    return F.trim(F.regexp_replace(F.replace(clean(c), F.lit("_"), F.lit(" ")), "\\s+", " "))


def truthy(c: Column, on_counts: bool = True) -> Column:
    """Membership in 1, true, yes, y and, by default, on."""
    return F.lower(clean(c)).isin("1", "true", "yes", "y", *(["on"] if on_counts else []))


def whole(c: Column) -> Column:
    """An integer from text that may be written as a decimal; null if it is neither."""
    return c.try_cast("double").cast("int")


def real(c: Column) -> Column:
    """A finite double; null for anything else."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def is_safe_id(c: Column, colon: bool = False) -> Column:
    """Starts with a letter or digit, goes on with those and ``._-`` (and ``:`` on request)."""
    return clean(c).rlike("^[A-Za-z0-9][A-Za-z0-9._:-]*$" if colon else "^[A-Za-z0-9][A-Za-z0-9._-]*$")


def is_inside(path: Column) -> Column:
    """A relative path that does not leave its root."""
    p = F.replace(clean(path), F.lit("\\"), F.lit("/"))
    return (p != "") & ~p.startswith("/") & ~F.array_contains(F.split(p, "/"), "..")


def suffix(path: Column) -> Column:
    """The lower-case extension with its dot, or ``""``."""
    return F.lower(F.regexp_extract(clean(path), "[^./](\\.[^./]+)$", 1))


def file_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(clean(path), "/", -1)


def parent(path: Column) -> Column:
    """What precedes the last slash, or ``""``."""
    return F.regexp_extract(clean(path), "^(.*)/[^/]*$", 1)


def passage_id(*slugs: Column, start: Column, end: Column, method: Column) -> Column:
    """Slugs and zero-padded bars joined by underscores."""
    bars = [F.lpad(x.cast("string"), 4, "0") for x in (start, end)]
    return F.concat_ws("_", *[slug(s) for s in slugs], *bars, slug(method))


def hashed_id(prefix: str, *parts: Column, length: int = 12) -> Column:
    """A prefix and the first digits of the SHA-1 of the parts, joined by the unit separator."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("\x1f", *[clean(p) for p in parts])), 1, length))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts, joined by the unit separator."""
    return F.sha2(F.concat_ws("\x1f", *[clean(p) for p in parts]), 256)


def folded_contains(value: Column, wanted: str) -> Column:
    """Substring test without regard to case and accents; an empty request matches all."""
    asked = _bare(wanted.strip()).casefold()
    return F.lit(True) if not asked else folded(value).contains(F.lit(asked))


def selection_id(prefix: Column, title: Column, *identity: Column, start: Column, end: Column) -> Column:
    """A prefix, 28 characters of the title's ASCII slug, ten digits of the identity's SHA-256, and bars of three digits."""
    digest = F.substring(F.sha2(F.concat_ws("\x1f", *[clean(i) for i in identity]), 256), 1, 10)
    bars = F.concat(F.lit("b"), F.lpad(start.cast("string"), 3, "0"))
    return F.concat_ws("_", prefix, F.substring(ascii_slug(title), 1, 28), digest, bars, F.lpad(end.cast("string"), 3, "0"))


def multi(values: Column) -> Column:
    """Sorted distinct non-empty values joined by semicolons, as an aggregate."""
    return F.array_join(F.array_sort(F.collect_set(F.nullif(clean(values), F.lit("")))), ";")


def license_allows(c: Column) -> Column:
    """Whether a licence text names cc by, mit or public domain.

    A substring test by definition, so it also holds for words that contain "mit" and for restricted variants.
    """
    t = F.trim(F.regexp_replace(F.lower(clean(c)), "[^a-z0-9]+", " "))
    return t.contains("cc by") | t.contains("mit") | t.contains("public domain")


def seconds_label(c: Column) -> Column:
    """Seconds as ``1h02m03s``, ``2m03s`` or ``3s``."""
    s = F.floor(c).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%dh%02dm%02ds", h, m, r)).when(m > 0, F.format_string("%dm%02ds", m, r)).otherwise(F.format_string("%ds", r))
