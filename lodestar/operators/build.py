"""The composed build of an adapter from canonical tables, its supplement by rendered recordings, and its report.

Rows of an export become passages with times. Each row that is wanted ends as a passage, as an issue (it is not meant
for use) or as an error (it is meant for use and fails a check); one error stops the build. All tables of a build are
committed together (:class:`lodestar.sources.versions.Store`), so that readers never see half of one.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.identity import composer, period
from lodestar.functions.strings import clean, is_inside, suffix, truthy
from lodestar.operators import catalogue, windows
from lodestar.operators.quality import ContractError
from lodestar.sources.versions import Store
from lodestar.sources.workspace import materialize

# What the ids of each kind begin with, the score formats that can be read, the columns that one recording
# and one movement must agree on, the keys of the canonical tables, and the reasons of rows that are left out.
ID_PREFIXES = {"composition_id": "cmp_", "work_id": "wrk_", "score_version_id": "scv_", "performance_id": "prf_", "recording_id": "rec_", "alignment_id": "aln_"}
SCORE_FORMATS = (".mid", ".midi", ".mxl", ".musicxml", ".xml")
RECORDING_FIELDS = ("composer", "period", "composition_id", "work_id", "movement_id", "recording_id", "audio_path", "rights_status", "audio_origin")
SYMBOLIC_FIELDS = ("composer", "period", "composition_id", "work_id", "movement_id", "score_path", "mxl_path", "midi_path", "score_format", "score_version_id")
KEYS = {"works": "work_id", "scores": "score_version_id", "recordings": "recording_id", "alignments": "alignment_id", "assets": "path"}
NOT_ELIGIBLE = "row is not marked eligible_for_clap"
LOCATOR = "score_path is a metadata locator rather than MusicXML/MXL/MIDI"

_HEX = "^[0-9a-f]{64}$"


@dataclass(frozen=True)
class Corpus:
    """Canonical tables: works (work_id, title), scores (score_version_id, sha256), recordings (recording_id, sha256,
    source_dataset), alignments (alignment_id, granularity, method, sha256), events (alignment_id, measure_index,
    performance_time_sec, confidence), and assets (path, sha256, seconds), the files that are there.

    Note alignments need notes (alignment_id, score_onset, performance_onset, confidence, mapping_state) and measures
    (score_version_id, measure, start_seconds, end_seconds) as well.
    """

    works: DataFrame
    scores: DataFrame
    recordings: DataFrame
    alignments: DataFrame
    events: DataFrame
    assets: DataFrame
    notes: DataFrame | None = None
    measures: DataFrame | None = None

    def require_unique(self) -> None:
        """Raises if a key occurs twice; a corpus is looked through once, however many runs it serves."""
        if "unique" not in self.__dict__:
            for name, key in KEYS.items():
                catalogue.require_unique(getattr(self, name), [key], name)
            self.__dict__["unique"] = True


@dataclass(frozen=True)
class Build:
    """Tables of a build, and how many rows were wanted, imported, left out and failed."""

    tables: Mapping[str, DataFrame]
    errors: DataFrame
    counts: Mapping[str, int]


def rights_status(licences: Column) -> Column:
    """Whether licences allow research, by their names."""
    plain = F.trim(F.regexp_replace(F.lower(clean(licences)), "[^a-z0-9]+", " "))
    return F.when(plain.rlike("cc by|mit|public domain"), "licensed_for_research").otherwise("license_review_required")


def _first(rules: Sequence[tuple[Column, str]]) -> Column:
    return functools.reduce(lambda w, r: w.when(F.coalesce(r[0], F.lit(True)), r[1]), rules[1:], F.when(F.coalesce(rules[0][0], F.lit(True)), rules[0][1]))


def _digest(sha: Column) -> Column:
    """A SHA-256 in lower-case digits as 32 bytes, or null if it is none."""
    return F.when(sha.rlike(_HEX), F.unhex(sha))


def _checked(rows: DataFrame, corpus: Corpus, audio_sha: str | None, verify: bool) -> DataFrame:
    """What the canonical tables say of each row, by ``row``, and ``error``, the first check that it fails.

    ``audio_sha``: the column of the rows that holds the digest of their audio; without it the recordings hold it. Only the
    key of a row goes to each table, and only the outcome comes back: rows of an export are wide, and digests longer still.
    """
    corpus.require_unique()
    of = lambda c: clean(F.col(c))
    yes, empty = F.lit(True), F.lit(None).cast("string")
    # many alignments lie in few files: the paths come first, and meet the rows without moving these
    paths = materialize(rows.select(of("alignment_path").alias("path")).distinct(), "paths")
    there = materialize(corpus.assets.select("path").join(paths, "path", "left_semi"), "paths")
    ids = _first([((~of(c).startswith(p)) | (F.length(of(c)) <= len(p)), f"{c} must be an opaque ID beginning with {p}") for c, p in ID_PREFIXES.items()])
    inside = _first([(~is_inside(F.col(f"{n}_path")), f"{n} asset path must remain relative") for n in ("score", "audio", "alignment")])
    head = rows.select("row", "__needs_recording", ids.alias("__ids"), inside.alias("__inside"), of("work_id").alias("work_id"), of("alignment_path").alias("path"))
    head = head.join(there.withColumn("__alignment_there", yes), "path", "left").drop("path")
    head = head.join(corpus.works.select("work_id", F.col("title").alias("__title"), yes.alias("__work")), "work_id", "left").drop("work_id")
    digest = _digest(F.lower(of("sha256"))).alias("digest")
    scores = rows.select("row", of("score_version_id").alias("id"), of("score_path").alias("path"))
    scores = scores.join(corpus.scores.select(F.col("score_version_id").alias("id"), digest, yes.alias("known")), "id", "left")
    audio = rows.select("row", of("recording_id").alias("id"), of("audio_path").alias("path"), *([_digest(F.lower(of(audio_sha))).alias("own")] if audio_sha else []))
    known = corpus.recordings.select(F.col("recording_id").alias("id"), *([] if audio_sha else [digest.alias("own")]), F.col("source_dataset").alias("dataset"), yes.alias("known"))
    audio = audio.join(known, "id", "left")
    claims = scores.select("row", "path", "digest", "known", empty.alias("dataset"), F.lit("score").alias("kind"))
    claims = claims.unionByName(audio.select("row", "path", F.col("own").alias("digest"), "known", "dataset", F.lit("audio").alias("kind")))
    files = corpus.assets.select("path", _digest(F.lower("sha256")).alias("found"), F.col("seconds").cast("double").alias("seconds"), yes.alias("there"))
    met = claims.join(files, "path", "left").select("row", "kind", "known", "dataset", "there", "seconds", F.col("digest").isNotNull().alias("valid"), (F.col("digest") == F.col("found")).alias("same"))
    by = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    met = met.groupBy("row").agg(
        *[by(kind, c).alias(f"__{kind}_{c}") for kind in ("score", "audio") for c in ("known", "there", "valid", "same")], by("audio", "seconds").alias("__audio_seconds"), F.max("dataset").alias("__dataset"),
    )
    anchors = corpus.events.select("alignment_id")
    if corpus.notes is not None:
        anchors = anchors.unionByName(corpus.notes.select("alignment_id"))
    anchors = anchors.distinct().withColumn("__anchored", yes)
    named = corpus.alignments.select("alignment_id", F.lower(of("granularity")).alias("__granularity"), F.col("method").alias("__method"), (F.length(of("sha256")) == 64).alias("__hashed"), yes.alias("__alignment"))
    timed = rows.select("row", of("alignment_id").alias("alignment_id"), *([of("score_version_id").alias("score_version_id")] if corpus.notes is not None else []))
    timed = timed.join(named, "alignment_id", "left").join(anchors, "alignment_id", "left").withColumn("__granularity", F.coalesce("__granularity", F.lit("")))
    rules = [(F.col(c).isNull(), f"{n} is not in the canonical tables") for n, c in (("work", "__work"), ("score", "__score_known"), ("alignment", "__alignment"))]
    rules.append((F.col("__audio_known").isNull() & F.col("__needs_recording"), "recording is not in the canonical tables"))
    last = [(F.col(f"__{n}_there").isNull(), f"{n} asset does not exist") for n in ("score", "audio", "alignment")]
    for name in ("score", "audio"):
        last.append((~F.col(f"__{name}_valid"), f"{name}_sha256 is not a valid SHA-256 digest"))
        if verify:
            last.append((~F.col(f"__{name}_same"), f"{name}_sha256 does not match the file"))
    last.append((~F.col("__hashed"), "canonical alignment source hash is missing"))
    last.append((F.col("__anchored").isNull(), "alignment store has no rows for alignment_id"))
    error = F.coalesce("__ids", _first(rules), F.col("__inside"), _first(last))
    return head.join(met, "row").join(timed, "row").select("row", "alignment_id", *(["score_version_id"] if corpus.notes is not None else []), "__granularity", "__method", "__title", "__dataset", F.col("__audio_seconds").alias("seconds"), error.alias("error"))


def timings(rows: DataFrame, corpus: Corpus) -> DataFrame:
    """(row, score_measure, onset_seconds, offset_seconds, confidence, problem) of rows (row, alignment_id,
    score_version_id, granularity, seconds); ``problem`` is set on every measure of an alignment that cannot be used."""
    beats = rows.filter("granularity <> 'note'")
    numbers = {c: F.col(c).try_cast("double") for c in ("measure_index", "performance_time_sec", "confidence")}
    events = corpus.events.withColumns(numbers).dropna(subset=list(numbers)).filter("measure_index >= 1 and performance_time_sec >= 0")
    own = beats.select("row", "alignment_id", "seconds").join(events, "alignment_id").withColumn("score_measure", F.col("measure_index").cast("int"))
    # the keys hold that of the join, so that the events of a row stay where it left them
    at = windows.offsets(own, ["alignment_id", "row"], "score_measure", "performance_time_sec", "seconds", lone=0.5, flat=True, more={"confidence": F.min("confidence")})
    whole = Window.partitionBy("alignment_id", "row")
    gap = F.count(F.lit(1)).over(whole) != F.max("score_measure").over(whole)
    flat = F.count_if(F.col("onset").isNull()).over(whole) > 0
    problem = F.when(gap, "measures are not contiguous and one-based").when(flat, "an interval is not positive")
    out = at.withColumn("problem", problem).withColumnsRenamed({"onset": "onset_seconds", "offset": "offset_seconds"})
    columns = ["row", "score_measure", "onset_seconds", "offset_seconds", "confidence", "problem"]
    if corpus.notes is not None and corpus.measures is not None:
        notes = rows.filter("granularity = 'note'").select("row", "alignment_id", "score_version_id", "seconds")
        anchors = notes.select("row", "alignment_id").join(corpus.notes, "alignment_id").drop("alignment_id")
        measures = notes.select("row", "score_version_id", "seconds").join(corpus.measures, "score_version_id").select("row", "measure", "start_seconds", "end_seconds")
        read = windows.note_timings(measures, anchors, ["row"]).join(notes.select("row", "seconds"), "row")
        read = read.withColumn("offset_seconds", F.least("offset_seconds", F.coalesce("seconds", "offset_seconds"))).filter("offset_seconds > onset_seconds")
        out = out.select(columns).unionByName(read.select("row", F.col("measure").cast("int").alias("score_measure"), "onset_seconds", "offset_seconds", "confidence", F.lit(None).cast("string").alias("problem")))
    return out.select(columns)


def _passages(rows: DataFrame, bars: DataFrame, origin: Column) -> DataFrame:
    """Rows that passed, in the adapter's columns, with as many bars as they have measures."""
    name, path = composer(F.col("composer")), clean(F.col("score_path"))
    kind, empty = suffix(path), F.lit("")
    of = lambda c: clean(F.col(c))
    dataset = F.coalesce(F.nullif(of("original_source_dataset"), empty), clean(F.col("__dataset")))
    return rows.join(bars, "row").select(
        of("export_row_id").alias("passage_id"), name.alias("composer"), period(name).alias("period"), of("work_id").alias("work_id"), of("work_id").alias("movement_id"), of("recording_id").alias("recording_id"),
        path.alias("score_path"), F.when(kind.isin(".mxl", ".musicxml", ".xml"), path).otherwise("").alias("mxl_path"), of("audio_path").alias("audio_path"), F.when(kind.isin(".mid", ".midi"), path).otherwise("").alias("midi_path"),
        of("performance_midi_path").alias("performance_midi_path"), of("alignment_path").alias("alignment_path"), F.lit(1).alias("bar_start"), F.col("bars").cast("int").alias("bar_end"),
        F.regexp_replace(kind, r"^\.", "").alias("score_format"), F.concat(F.lit("cpc_canonical_"), F.col("__granularity")).alias("alignment_format"), rights_status(F.col("licenses")).alias("rights_status"),
        F.lit("complete_movement").alias("segment_type"), F.when(F.lower(of("alignment_quality")).contains("partial"), "false").otherwise("true").alias("fully_aligned"), F.lit("true").alias("eligible_for_clamp"),
        F.lit("ready").alias("availability_status"), of("composition_id").alias("composition_id"), F.coalesce(F.nullif(clean(F.col("__title")), empty), of("work_id")).alias("work_title"), of("score_version_id").alias("score_version_id"),
        of("performance_id").alias("performance_id"), of("alignment_id").alias("alignment_id"), origin.alias("audio_origin"), F.col("__granularity").alias("alignment_granularity"), clean(F.col("__method")).alias("alignment_method"),
        of("alignment_quality").alias("alignment_quality"), dataset.alias("source_dataset"), of("licenses").alias("licenses"),
    )


def cohorts(passages: DataFrame) -> DataFrame:
    """Distinct recordings, compositions and works per composer, origin and granularity."""
    return passages.groupBy("composer", "audio_origin", "alignment_granularity").agg(*[F.count_distinct(f"{c}_id").alias(f"{c}_count") for c in ("recording", "composition", "work")])


def _timed(sound: DataFrame, corpus: Corpus) -> tuple[DataFrame, DataFrame]:
    """Times of the measures of checked rows, and the rows whose times cannot be used, with the problem."""
    asked = sound.withColumnRenamed("__granularity", "granularity")
    times = materialize(timings(asked, corpus), "timings")
    count = times.groupBy("row").agg(F.count(F.lit(1)).alias("bars"), F.max(F.col("problem").isNotNull()).alias("odd"))
    # a row whose times are all sound needs no more than that; what is wrong with the others is looked up
    bad = asked.select("row").join(count, "row", "left").filter("bars is null or odd").select("row", F.col("bars").isNull().alias("none"))
    said = times.filter("problem is not null").select("row", "problem").distinct()
    problem = F.when(F.col("none"), "alignment contains no usable anchors").otherwise(F.col("problem"))
    return times, materialize(bad.join(said, "row", "left").select("row", problem.alias("problem")), "problems")


def _good(rows: DataFrame, sound: DataFrame, bad: DataFrame) -> DataFrame:
    """Rows that passed all checks, with what the canonical tables say of them."""
    said = sound.join(bad, "row", "left_anti").select("row", "__granularity", "__method", "__title", "__dataset")
    return rows.join(said, "row")


def _measures(times: DataFrame, rows: DataFrame) -> DataFrame:
    names = rows.select("row", clean(F.col("recording_id")).alias("recording_id"), clean(F.col("work_id")).alias("movement_id"), clean(F.col("alignment_id")).alias("alignment_id"), F.col("__granularity").alias("granularity"), clean(F.col("__method")).alias("method"), clean(F.col("alignment_quality")).alias("quality_label"))
    return times.drop("problem").join(names, "row").select("recording_id", "movement_id", "alignment_id", "score_measure", F.col("score_measure").cast("string").alias("score_measure_label"), "onset_seconds", "offset_seconds", "confidence", "granularity", "method", "quality_label")


def build(export: DataFrame, corpus: Corpus, composers: Sequence[str] | None = None, verify: bool = True) -> Build:
    """Passages, measures, issues and cohorts of an export whose rows are numbered by ``row``.

    ``composers`` narrows the export by name in any spelling; rows that are not eligible or have no readable score are
    issues, eligible rows that fail are errors.
    """
    rows = export.withColumn("__needs_recording", F.lit(True))
    if composers is not None:
        wanted = [F.lit(c) for c in composers]
        rows = rows.filter(functools.reduce(lambda a, b: a | b, [composer(F.col("composer")) == composer(c) for c in wanted]))
    reason = F.when(~truthy(F.col("eligible_for_clap")), NOT_ELIGIBLE).when(~suffix(clean(F.col("score_path"))).isin(*SCORE_FORMATS), LOCATOR)
    rows = rows.withColumn("reason", reason)
    issues = rows.filter("reason is not null").select("row", clean(F.col("recording_id")).alias("recording_id"), "reason")
    meant = rows.filter("reason is null")
    checked = materialize(_checked(meant, corpus, None, verify), "checked")
    sound = checked.filter("error is null")
    times, bad = _timed(sound, corpus)
    failed = checked.filter("error is not null").select("row", "error").unionByName(bad.withColumnRenamed("problem", "error"))
    errors = meant.select("row", "recording_id").join(materialize(failed, "errors"), "row")
    good = _good(meant, sound, bad)
    origin = F.when(truthy(F.col("synthetic_audio")), "synthetic_rendering").otherwise("source_recording")
    passages = _passages(good, times.groupBy("row").agg(F.count(F.lit(1)).alias("bars")), origin)
    tables = {"passages": passages, "measures": _measures(times, good), "issues": issues, "cohorts": cohorts(passages)}
    counts = {"target_rows": rows.count(), "issues": issues.count(), "errors": failed.count()}
    return Build(tables, errors, counts | {"imported_rows": counts["target_rows"] - counts["issues"] - counts["errors"]})


def publish(store: Store, built: Build, inputs: Mapping[str, DataFrame] | None = None) -> int:
    """Commit all tables of a build as the store's next version, or nothing: any error stops it, and so does an empty build."""
    if built.counts["errors"]:
        first = built.errors.orderBy("row").limit(5).collect()
        raise ContractError(f"{built.counts['errors']} eligible rows failed: " + "; ".join(f"row {r['row']} ({r['recording_id']}): {r['error']}" for r in first))
    if not built.counts["imported_rows"]:
        raise ContractError("no usable rows remain")
    version = store.commit(built.tables, inputs=inputs, note={"counts": dict(built.counts)})
    if store.read("passages", version).count() != built.counts["imported_rows"]:
        raise ContractError("the written passages are not as many as those imported")
    return version


def supplement(store: Store, renders: DataFrame, export: DataFrame, corpus: Corpus, verify: bool = True) -> dict[str, int]:
    """Append rendered recordings to the newest version and commit the next one; returns the counts.

    A render (output_recording_id, output_audio_path, output_sha256, performance_id, work_id, score_version_id,
    alignment_id, score_path, alignment_quality, source_dataset, work_title, source_midi_path) is new if no passage has
    its recording. It takes its row of the export from those of its performance and work, narrowed by its score, its
    alignment, rendered and eligible rows in turn; none or several left, or a failing check, count as unmatched. A second
    run adds nothing, and commits nothing.
    """
    known = store.read("passages").select(F.col("recording_id").alias("output_recording_id")).distinct()
    fresh = renders.filter(clean(F.col("output_recording_id")) != "").join(known, "output_recording_id", "left_anti").withColumn("row", F.monotonically_increasing_id())
    fresh = materialize(fresh, "renders")  # the numbers must stay what they are
    keys = ["performance_id", "work_id"]
    mine = {c: f"__x_{c}" for c in ("score_version_id", "alignment_id", "synthetic_audio", "eligible_for_clap", "composer", "composition_id", "licenses", "export_row_id", "original_source_dataset", "performance_midi_path", "alignment_quality")}
    both = fresh.join(export.select(*keys, *[F.col(c).alias(n) for c, n in mine.items()]), keys)
    same = lambda c: (clean(F.col(c)) != "") & (clean(F.col(c)) == clean(F.col(mine[c])))
    picked = catalogue.narrowed(both, [*keys, "row"], [same("score_version_id"), same("alignment_id"), truthy(F.col(mine["synthetic_audio"])), truthy(F.col(mine["eligible_for_clap"]))])
    or_else = lambda a, b: F.coalesce(F.nullif(clean(F.col(a)), F.lit("")), F.col(b))
    notes = materialize(corpus.alignments.filter(F.lower(clean(F.col("granularity"))) == "note").select(F.col("alignment_id").alias("__a")).distinct(), "notes")
    rows = picked.join(notes, clean(F.col("alignment_id")) == F.col("__a"), "left").select(
        "row", *keys, "score_version_id", "alignment_id", F.col("output_recording_id").alias("recording_id"), F.col("__x_composition_id").alias("composition_id"), F.col("__x_composer").alias("composer"),
        F.col("__x_licenses").alias("licenses"), F.col("__x_export_row_id").alias("export_row_id"), "score_path", F.col("output_audio_path").alias("audio_path"),
        F.when(F.col("__a").isNotNull(), "data/canonical/alignment_notes.csv").otherwise("data/canonical/alignment_events.csv").alias("alignment_path"), "output_sha256",
        or_else("alignment_quality", "__x_alignment_quality").alias("alignment_quality"), or_else("source_dataset", "__x_original_source_dataset").alias("original_source_dataset"),
        or_else("source_midi_path", "__x_performance_midi_path").alias("performance_midi_path"), clean(F.col("work_title")).alias("__render_title"), F.lit(False).alias("__needs_recording"),
    )
    rows = materialize(rows.filter(suffix(clean(F.col("score_path"))).isin(*SCORE_FORMATS)), "picked")
    sound = materialize(_checked(rows, corpus, "output_sha256", verify), "checked").filter("error is null")
    times, bad = _timed(sound, corpus)
    good = _good(rows, sound, bad).withColumn("__title", F.coalesce(F.nullif(F.col("__render_title"), F.lit("")), F.col("__title")))
    added = materialize(_passages(good, times.groupBy("row").agg(F.count(F.lit(1)).alias("bars")), F.lit("synthetic_rendering")), "added")
    n, offered = added.count(), fresh.count()
    if n:
        old = store.read("passages")
        passages = old.unionByName(added.select(old.columns))
        measures = store.read("measures")
        store.commit(
            {"passages": passages, "measures": measures.unionByName(_measures(times, good).select(measures.columns)), "cohorts": cohorts(passages)},
            note={"added": n, "unmatched": offered - n},
        )
    return {"offered": offered, "added": n, "unmatched": offered - n, "total": store.read("passages").count()}


def _some(c: str) -> Column:
    """Trimmed text with nothing as null."""
    return F.nullif(clean(F.col(c)), F.lit(""))


def _symbolic() -> Column:
    return F.coalesce(_some("mxl_path"), _some("score_path"), _some("midi_path"))


def _paths(rows: DataFrame, assets: DataFrame) -> DataFrame:
    """Each path of the rows once: whether its file is there, and per kind its rows and the items that share it.

    Files meet paths, not rows: what is asked of the rows of an item is added up before they move, and the items of a path
    before they meet, so that a path of very many rows is no large group.
    """
    item = lambda c: F.coalesce(_some(c), F.col("passage_id"))
    use = lambda kind, path, key, allowed, covered: F.struct(F.lit(kind).alias("kind"), path.alias("path"), item(key).alias("item"), allowed.cast("long").alias("allowed"), covered.cast("long").alias("covered"))
    none = F.lit(0)
    used = rows.select(F.inline(F.array(use(1, _some("audio_path"), "recording_id", F.col("__allowed"), F.col("__covered")), use(2, _symbolic(), "movement_id", none, none))))
    files = assets.select(none.alias("kind"), "path", F.lit(None).cast("string").alias("item"), none.cast("long").alias("allowed"), none.cast("long").alias("covered"))
    items = used.unionByName(files).filter("path is not null").groupBy("kind", "path", "item").agg(F.count(F.lit(1)).alias("n"), F.sum("allowed").alias("allowed"), F.sum("covered").alias("covered"))
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value).otherwise(0))
    one = F.col("item").isNotNull().cast("long")
    found = items.groupBy("path").agg(
        F.max(F.col("kind") == 0).alias("there"), of(1, F.col("n")).alias("audio"), of(1, one).alias("recordings"), F.sum("allowed").alias("allowed"), F.sum("covered").alias("covered"),
        of(2, F.col("n")).alias("symbolic"), of(2, one).alias("movements"),
    )
    return materialize(found.filter("audio > 0 or symbolic > 0"), "paths")


def _conflicts(rows: DataFrame, key: str, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """How many keys there are, and the conflicts of their columns.

    A key of one row cannot disagree with itself: where most rows are such, only the others go on. Where few are, every
    row goes to its key, once and whole, not once for each of its columns.
    """
    n = rows.select(_some(key).alias("key")).filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    met = materialize(n.groupBy(F.when(F.col("rows") > 1, F.col("key")).alias("key")).agg(F.count(F.lit(1)).alias("keys"), F.sum("rows").alias("rows")), "keys", share=8)
    alone, several = met.agg(F.sum(F.when(F.col("key").isNull(), F.col("rows"))), F.sum(F.when(F.col("key").isNotNull(), F.col("rows")))).first()
    wide = rows.filter(_some(key).isNotNull()).select(key, *[c for c in fields if c in rows.columns and c != key])
    if (several or 0) > (alone or 0):
        dealt = wide.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    else:
        dealt = wide.join(met.filter("key is not null").select(F.col("key").alias("__key")), _some(key) == F.col("__key"), "left_semi")
    # written by as many tasks as there are parts: the values of all columns are told apart here
    found = materialize(catalogue.conflicts(dealt, key, wide.columns[1:]).select(key, "field", "n"), "conflicts")
    return met.agg(F.coalesce(F.sum("keys"), F.lit(0)).alias("value")), found


def report(rows: DataFrame, assets: DataFrame, allowed: Sequence[str], covered: Column) -> DataFrame:
    """(section, name, value, status) of a manifest: counters, counts by label, what is shared, conflicts, and the status.

    Conflicts of a recording's columns are errors; those of a movement's, shared paths, missing files, audio without rights
    and alignment gaps are warnings. ``assets`` (path) are the files that are there; ``covered`` says whether a row's measures
    are all aligned. The last row is the worst status of all.
    """
    labels = ("composer", "rights_status", "audio_origin", "score_format", "alignment_format")
    may, nameless = F.lower(clean(F.col("rights_status"))).isin(*[a.strip().lower() for a in allowed]), _some("recording_id").isNull() | _some("movement_id").isNull()
    keep = [c for c in dict.fromkeys((*RECORDING_FIELDS, *SYMBOLIC_FIELDS, *labels)) if c in rows.columns]
    # a passage is named only where it stands for a recording or a movement without a name
    rows = materialize(rows.select(*keep, F.when(nameless, F.col("passage_id")).alias("passage_id"), may.alias("__allowed"), (may & F.coalesce(covered, F.lit(False))).alias("__covered")), "report")
    paths = _paths(rows, assets)
    part = lambda df, section: df.select(F.lit(section).alias("section"), F.col("name").cast("string").alias("name"), F.col("value").cast("long").alias("value"))
    counters = lambda df: part(df.unpivot([], df.columns, "name", "value"), "counters")
    bad_path = lambda c: c.isNotNull() & ~is_inside(c)
    out = counters(rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad_path(_symbolic())).alias("invalid_symbolic_paths"), F.count_if(bad_path(_some("audio_path"))).alias("invalid_audio_paths")))
    total = lambda c, where: F.coalesce(F.sum(F.when(where, c)), F.lit(0))
    there, may, whole = F.col("there"), F.col("allowed"), F.col("covered")
    out = out.unionByName(counters(paths.agg(
        total(F.col("symbolic"), there).alias("symbolic_ready"), total(F.col("symbolic"), ~there).alias("missing_symbolic_paths"), total(F.col("audio"), there).alias("local_audio"), total(F.col("audio"), ~there).alias("missing_audio_paths"),
        total(may, there).alias("authorized_audio"), total(F.col("audio") - may, there).alias("unauthorized_audio"), total(whole, there).alias("fully_aligned"), total(may - whole, there).alias("alignment_gaps"),
    )))
    for c in labels:
        out = out.unionByName(part(rows.groupBy(clean(F.col(c)).alias("name")).agg(F.count(F.lit(1)).alias("value")), f"{c} counts"))
    origin = rows.filter(clean(F.col("audio_origin")) != "").groupBy(F.concat_ws("|", clean(F.col("audio_origin")), clean(F.col("composer"))).alias("name")).agg(F.count_distinct(_some("recording_id")).alias("value"))
    out = out.unionByName(part(origin, "cohort recordings"))
    for value, section in (("recordings", "shared audio paths"), ("movements", "shared symbolic paths")):
        out = out.unionByName(part(paths.filter(F.col(value) > 1).select(F.col("path").alias("name"), F.col(value).alias("value")), section))
    compositions = rows.groupBy(_some("composition_id").alias("name")).agg(F.count_distinct(_some("recording_id")).alias("value")).filter("name is not null")
    compositions = materialize(compositions, "compositions", share=8)
    out = out.unionByName(part(compositions.filter("value > 1"), "several recordings"))
    out = out.unionByName(counters(compositions.agg(F.count(F.lit(1)).alias("compositions")))).unionByName(counters(rows.agg(F.count_distinct(_some("work_id")).alias("works"))))
    for key, fields, section in (("recording_id", RECORDING_FIELDS, "recording conflicts"), ("movement_id", SYMBOLIC_FIELDS, "symbolic conflicts")):
        number, found = _conflicts(rows, key, fields)
        out = out.unionByName(counters(number.withColumnRenamed("value", f"{key[:-3]}s")))
        out = out.unionByName(part(found.select(F.concat_ws("|", F.col(key), "field").alias("name"), F.col("n").alias("value")), section))
    error = (F.col("section") == "recording conflicts") | F.col("name").isin("invalid_symbolic_paths", "invalid_audio_paths") & (F.col("section") == "counters") & (F.col("value") > 0)
    named = F.col("name").isin("missing_symbolic_paths", "missing_audio_paths", "unauthorized_audio", "alignment_gaps") & (F.col("section") == "counters") & (F.col("value") > 0)
    out = materialize(out.withColumn("status", F.when(error, "error").when(F.col("section").isin("symbolic conflicts", "shared audio paths", "shared symbolic paths") | named, "warning").otherwise("ok")), "report", share=8)
    worst = out.agg(F.when(F.bool_or(F.col("status") == "error"), "error").when(F.bool_or(F.col("status") == "warning"), "warning").otherwise("ok").alias("status"), F.count_if(F.col("status") != "ok").alias("value"))
    return out.unionByName(worst.select(F.lit("status").alias("section"), F.lit("overall").alias("name"), "value", "status"))
