import dataclasses

import pytest
from pyspark.sql import functions as F

from lodestar.operators import build as B
from lodestar.operators import windows
from lodestar.operators.quality import ContractError
from lodestar.sources.versions import Store
from lodestar.sources.workspace import new_path

SHA = {n: c * 64 for n, c in (("score", "a"), ("audio", "b"), ("align", "c"), ("render", "d"))}
ROW = {
    "row": 2, "export_row_id": "e1", "composer": "Frédéric Chopin", "eligible_for_clap": "true", "score_path": "s/1.mxl", "audio_path": "a/1.wav", "alignment_path": "data/events.csv", "composition_id": "cmp_1", "work_id": "wrk_1",
    "score_version_id": "scv_1", "performance_id": "prf_1", "recording_id": "rec_1", "alignment_id": "aln_1", "licenses": "CC-BY", "alignment_quality": "partial", "synthetic_audio": "", "original_source_dataset": "", "performance_midi_path": "",
}


def _export(spark, *changes):
    rows = [ROW | {"row": 2 + k, "export_row_id": f"e{k}"} | c for k, c in enumerate(changes)]
    return spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} {'long' if k == 'row' else 'string'}" for k in ROW))


def _corpus(spark, events=None, **more):
    make = spark.createDataFrame
    events = events or [("aln_1", "1", "0.5", "0.9"), ("aln_1", "1", "0.7", "0.8"), ("aln_1", "2", "2.5", "0.7"), ("aln_1", "x", "3", "1"), ("aln_1", "3", "4.5", None)]
    return dataclasses.replace(B.Corpus(
        works=make([("wrk_1", "A work")], "work_id string, title string"), scores=make([("scv_1", SHA["score"].upper())], "score_version_id string, sha256 string"),
        recordings=make([("rec_1", SHA["audio"], "asap"), ("rec_2", "short", "asap")], "recording_id string, sha256 string, source_dataset string"),
        alignments=make([("aln_1", "Beat", "dtw", SHA["align"]), ("aln_2", "beat", "dtw", ""), ("aln_3", "beat", "dtw", SHA["align"]), ("aln_n", "note", "nw", SHA["align"])], "alignment_id string, granularity string, method string, sha256 string"),
        events=make(events, "alignment_id string, measure_index string, performance_time_sec string, confidence string"),
        assets=make([("s/1.mxl", SHA["score"], None), ("s/2.mid", SHA["render"], None), ("a/1.wav", SHA["audio"], 3.0), ("a/2.wav", SHA["render"], 9.0), ("data/events.csv", "", None), ("data/canonical/alignment_events.csv", "", None)], "path string, sha256 string, seconds double"),
    ), **more)


def test_rows_become_passages_issues_and_measures(spark):
    export = _export(spark, {}, {"eligible_for_clap": "no"}, {"score_path": "imslp.org/x"}, {"composer": "Liszt", "recording_id": "nonsense"})
    built = B.build(export, _corpus(spark), ["CHOPIN"])
    assert built.counts == {"target_rows": 3, "issues": 2, "errors": 0, "imported_rows": 1}
    (p,) = built.tables["passages"].collect()
    assert (p["composer"], p["period"], p["bar_end"], p["mxl_path"], p["midi_path"], p["rights_status"], p["fully_aligned"], p["source_dataset"], p["work_title"]) == ("Chopin", "Romantic", 2, "s/1.mxl", "", "licensed_for_research", "false", "asap", "A work")
    times = [(r["score_measure"], r["onset_seconds"], r["offset_seconds"], r["confidence"]) for r in built.tables["measures"].orderBy("score_measure").collect()]
    assert times == [(1, 0.5, 2.5, 0.8), (2, 2.5, 3.0, 0.7)]  # the recording ends after three seconds
    assert sorted(r["reason"] for r in built.tables["issues"].collect()) == sorted([B.NOT_ELIGIBLE, B.LOCATOR])
    assert [tuple(r) for r in built.tables["cohorts"].collect()] == [("Chopin", "source_recording", "beat", 1, 1, 1)]


@pytest.mark.parametrize(
    "change, error",
    [
        ({"work_id": "wrk_"}, "work_id must be an opaque ID"), ({"work_id": "wrk_9"}, "work is not in"), ({"score_version_id": None}, "score_version_id must be"), ({"recording_id": "rec_9"}, "recording is not in"),
        ({"alignment_id": "aln_9"}, "alignment is not in"), ({"audio_path": "../a/1.wav"}, "audio asset path must remain"), ({"audio_path": "a/9.wav"}, "audio asset does not exist"), ({"alignment_path": "data/x.csv"}, "alignment asset does not"),
        ({"recording_id": "rec_2"}, "audio_sha256 is not a valid"), ({"score_path": "s/2.mid"}, "score_sha256 does not match"), ({"alignment_id": "aln_2"}, "canonical alignment source hash"), ({"alignment_id": "aln_3"}, "no rows for alignment_id"),
    ],
)
def test_the_first_check_that_fails(spark, change, error):
    built = B.build(_export(spark, {}, change), _corpus(spark))
    assert built.counts["errors"] == 1 and error in built.errors.first()["error"]


@pytest.mark.parametrize(
    "events, error",
    [
        ([("aln_1", "1", "0.5", "1"), ("aln_1", "3", "2", "1")], "contiguous"), ([("aln_1", "2", "0.5", "1")], "contiguous"), ([("aln_1", "1", "2", "1"), ("aln_1", "2", "1", "1")], "not positive"),
        ([("aln_1", "0", "2", "1"), ("aln_1", "1", "-1", "1")], "no usable anchors"),
    ],
)
def test_times_that_cannot_be_used(spark, events, error):
    built = B.build(_export(spark, {}), _corpus(spark, events))
    assert built.counts["errors"] == 1 and error in built.errors.first()["error"]


def test_notes_give_times_too(spark):
    notes = spark.createDataFrame([("aln_n", 0.0, 1.0, 0.5, "matched"), ("aln_n", 4.0, 3.0, 0.9, "Interpolated"), ("aln_n", 9.0, 99.0, 0.1, "skipped")], "alignment_id string, score_onset double, performance_onset double, confidence double, mapping_state string")
    measures = spark.createDataFrame([("scv_1", 1, 0.0, 2.0), ("scv_1", 2, 2.0, 4.0), ("scv_1", 3, 4.0, 4.0)], "score_version_id string, measure int, start_seconds double, end_seconds double")
    built = B.build(_export(spark, {"alignment_id": "aln_n"}), _corpus(spark, notes=notes, measures=measures))
    times = [(r["score_measure"], r["onset_seconds"], r["offset_seconds"], r["confidence"]) for r in built.tables["measures"].orderBy("score_measure").collect()]
    assert built.counts["errors"] == 0 and times == [(1, 1.0, 2.0, 0.5), (2, 2.0, 3.0, 0.5)]


def test_one_failure_leaves_the_old_version(spark):
    store, corpus = Store(spark, new_path(spark, "adapter")), _corpus(spark)
    export = _export(spark, {})
    assert B.publish(store, B.build(export, corpus), inputs={"export": export}) == 1
    with pytest.raises(ContractError, match="row 3 .rec_1.: audio asset does not exist"):
        B.publish(store, B.build(_export(spark, {}, {"audio_path": "a/9.wav"}), corpus))
    with pytest.raises(ContractError, match="no usable rows"):
        B.publish(store, B.build(_export(spark, {"eligible_for_clap": ""}), corpus))
    assert store.versions() == [1] and store.read("passages").count() == 1
    assert store.stale({"export": export}) == [] and len(store.stale({"export": _export(spark, {"licenses": "x"})})) == 1


def test_supplement_appends_once(spark):
    store, corpus = Store(spark, new_path(spark, "adapter")), _corpus(spark)
    export = _export(spark, {}, {"performance_id": "prf_2", "synthetic_audio": "1", "composition_id": "cmp_2"}, {"performance_id": "prf_2", "composition_id": "cmp_3"}, {"performance_id": "prf_3"}, {"performance_id": "prf_3"})
    B.publish(store, B.build(export.filter("row = 2"), corpus))
    fields = "output_recording_id output_audio_path output_sha256 performance_id work_id score_version_id alignment_id score_path alignment_quality source_dataset work_title source_midi_path".split()
    render = lambda i, p="prf_2", sha=SHA["render"], audio="a/2.wav", score="scv_1", path="s/1.mxl": (i, audio, sha, p, "wrk_1", score, "aln_1", path, "", "", "Mine", "")
    renders = spark.createDataFrame([
        render("rec_r1"), render("rec_r2", p="prf_3"), render("rec_r3", p="prf_9"), render("rec_r4", sha="x"), render("rec_r5", audio="a/9.wav"), render("rec_r6", path="x.pdf"), render("rec_1"), render(""), render("rec_r7", score="scv_9"),
    ], ", ".join(f"{f} string" for f in fields))
    got = B.supplement(store, renders, export, corpus)
    assert got == {"offered": 7, "added": 1, "unmatched": 6, "total": 2}
    new = store.read("passages").filter("recording_id = 'rec_r1'").first()
    assert (new["composition_id"], new["audio_origin"], new["work_title"], new["alignment_quality"], new["bar_end"]) == ("cmp_2", "synthetic_rendering", "Mine", "partial", 2)
    assert store.read("measures").filter("recording_id = 'rec_r1'").count() == 2 and store.read("cohorts").count() == 2 and store.versions() == [1, 2]
    assert B.supplement(store, renders, export, corpus) == {"offered": 6, "added": 0, "unmatched": 6, "total": 2} and store.versions() == [1, 2]


def test_report_finds_conflicts(spark):
    names = ["passage_id", "composer", "composition_id", "work_id", "movement_id", "recording_id", "rights_status", "audio_origin", "audio_path", "mxl_path", "score_path", "midi_path", "score_format", "alignment_format"]
    row = lambda i, rec, audio, composer="Bach": (i, composer, "c", "w", "m", rec, "ok", "o", audio, "s.mxl", "", "", "mxl", "x")
    rows = spark.createDataFrame([row("p1", "r1", "a.wav"), row("p2", "r1", "b.wav"), row("p3", "r2", "a.wav")], ", ".join(f"{n} string" for n in names))
    files = spark.createDataFrame([("a.wav",), ("s.mxl",)], "path string")
    got = {(r["section"], r["name"]): (r["value"], r["status"]) for r in B.report(rows, files, ["OK"], F.lit(True)).collect()}
    assert got["recording conflicts", "r1|audio_path"] == (2, "error") and got["shared audio paths", "a.wav"] == (2, "warning")
    assert got["counters", "missing_audio_paths"] == (1, "warning") and got["counters", "authorized_audio"] == (2, "ok")
    assert got["several recordings", "c"] == (2, "ok") and got["status", "overall"] == (3, "error")
    fine = {r["section"]: r["status"] for r in B.report(rows.filter("passage_id = 'p1'"), files, ["ok"], F.lit(True)).collect()}
    assert fine["status"] == "ok"


def test_note_timings_send_both_ends_through_the_curve_once(spark):
    measures = spark.createDataFrame([(1, 1, 0.0, 2.0), (1, 2, 2.0, 4.0), (1, 3, None, 5.0), (2, 1, 0.0, 2.0)], "id long, measure int, start_seconds double, end_seconds double")
    notes = spark.createDataFrame([(1, 0.0, 1.0, 0.5, "matched"), (1, 4.0, 9.0, 0.7, " Interpolated"), (1, 2.0, 0.0, 0.1, "unmatched"), (2, 0.0, 1.0, 0.5, "unmatched")], "id long, score_onset double, performance_onset double, confidence double, mapping_state string")
    got = windows.note_timings(measures, notes, ["id"])
    assert got._jdf.queryExecution().executedPlan().toString().count("Join ") == 1
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1.0, 5.0, 0.5), (1, 2, 5.0, 9.0, 0.5)]


def _moves(df, what="Exchange hashpartitioning"):
    return df._jdf.queryExecution().executedPlan().toString().count(what)


@pytest.fixture
def sorted_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_times_move_events_once(spark, sorted_joins):
    rows = spark.createDataFrame([(1, "aln_1", "beat", 3.0), (2, "aln_1", "beat", 9.0), (3, "aln_2", "beat", 9.0)], "row long, alignment_id string, granularity string, seconds double")
    corpus = _corpus(spark, [("aln_1", "1", "0.5", "0.9"), ("aln_1", "1", "0.5", "0.8"), ("aln_1", "2", "2.5", "0.7"), ("aln_2", "1", "4", "1"), ("aln_2", "2", "3", "1")])
    got = B.timings(rows, corpus)
    assert _moves(got) == 2  # the rows and the events, each to their alignment
    flat = "an interval is not positive"
    assert sorted(map(tuple, got.collect())) == [(1, 1, 0.5, 2.5, 0.8, None), (1, 2, 2.5, 3.0, 0.7, None), (2, 1, 0.5, 2.5, 0.8, None), (2, 2, 2.5, 4.5, 0.7, None), (3, 1, None, None, 1.0, flat), (3, 2, 3.0, 5.0, 1.0, flat)]


def test_checks_leave_wide_rows_where_they_are(spark, sorted_joins):
    export = _export(spark, {}, {"audio_path": "a/9.wav"}).withColumn("__needs_recording", F.lit(True))
    got = B._checked(export, _corpus(spark), None, True)
    assert not {"licenses", "export_row_id", "__score_sha"} & set(got.columns)
    moved = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "licenses" in line and "Project" in line]
    assert moved == [] and sorted((r["row"], r["error"]) for r in got.collect()) == [(2, None), (3, "audio asset does not exist")]


def test_a_corpus_is_looked_through_once(spark, monkeypatch):
    seen, real = [], B.catalogue.require_unique
    monkeypatch.setattr(B.catalogue, "require_unique", lambda df, keys, what: seen.append(what) or real(df, keys, what))
    corpus = _corpus(spark)
    B.build(_export(spark, {}), corpus)
    B.build(_export(spark, {}), corpus)
    assert sorted(seen) == ["alignments", "assets", "recordings", "scores", "works"]
    with pytest.raises(ValueError, match="assets: path is not unique"):
        B.build(_export(spark, {}), dataclasses.replace(corpus, assets=corpus.assets.unionByName(corpus.assets.limit(1))))


_REPORT = "passage_id composer composition_id work_id movement_id recording_id rights_status audio_origin audio_path mxl_path score_path midi_path score_format alignment_format".split()


def _manifest(spark, *changes):
    row = dict(zip(_REPORT, ("p", "Bach", "c", "w", "m", "r", "ok", "o", "a.wav", "s.mxl", "", "", "mxl", "x"), strict=True))
    return spark.createDataFrame([tuple((row | {"passage_id": f"p{k}"} | c).values()) for k, c in enumerate(changes)], ", ".join(f"{c} string" for c in _REPORT))


def test_a_report_moves_keys_and_leaves_its_rows(spark, sorted_joins, monkeypatch):
    plans, real = [], B.materialize
    monkeypatch.setattr(B, "materialize", lambda df, label, **k: plans.append((label, df._jdf.queryExecution().executedPlan().toString())) or real(df, label, **k))
    files = spark.createDataFrame([("a.wav",), ("s.mxl",)], "path string")
    got = B.report(_manifest(spark, {}, {"recording_id": "r2"}), files, ["ok"], F.lit(True))
    assert [label for label, plan in plans if "Coalesce " in plan and "inline" in plan] == []  # few tasks write the report, all of them look for conflicts
    assert [label for label, plan in plans if "Join" in plan] == ["conflicts"] and "Exchange" not in plans[0][1]
    assert [line for label, plan in plans if label == "paths" for line in plan.splitlines() if "Exchange" in line and "composer" in line] == []
    assert {r["name"]: r["value"] for r in got.collect()}["symbolic_ready"] == 2


def test_conflicts_stay_with_rows_that_lie_at_their_key(spark):
    found = B.catalogue.conflicts(_manifest(spark, {}, {"composer": "Liszt"}).repartition("movement_id"), "movement_id", ["composer", "mxl_path"])
    assert _moves(found) == 1 and [tuple(r) for r in found.collect()] == [("m", "composer", "Bach;Liszt", 2)]


@pytest.mark.parametrize("alone", [0, 9])
def test_report_of_keys_with_and_without_company(spark, alone):
    """Keys in two spellings, paths of both kinds, and rows without names, whether or not most keys have one row."""
    more = [{"recording_id": f"x{k}", "movement_id": f"y{k}", "audio_path": "", "mxl_path": ""} for k in range(alone)]
    rows = _manifest(spark, {}, {"recording_id": " r", "rights_status": "no"}, {"composer": "Liszt", "audio_path": "s.mxl"}, {"recording_id": None, "movement_id": "", "audio_path": "b.wav"}, {"recording_id": " ", "movement_id": None, "audio_path": "b.wav", "mxl_path": "../s"}, *more)
    files = spark.createDataFrame([("s.mxl",), ("s.mxl",), (None,), ("b.wav",)], "path string")
    got = {(r["section"], r["name"]): r["value"] for r in B.report(rows, files, ["OK"], F.when(F.col("composer") == "Bach", True)).collect()}
    n = {name: value for (section, name), value in got.items() if section == "counters"}
    assert n == {
        "rows": 5 + alone, "compositions": 1, "works": 1, "movements": 1 + alone, "recordings": 1 + alone, "symbolic_ready": 4, "missing_symbolic_paths": 1, "local_audio": 3, "missing_audio_paths": 2,
        "authorized_audio": 3, "unauthorized_audio": 0, "fully_aligned": 2, "alignment_gaps": 1, "invalid_symbolic_paths": 1, "invalid_audio_paths": 0,
    }
    twisted = {name: value for (section, name), value in got.items() if section.endswith("conflicts")}
    assert twisted == {"r|composer": 2, "r|audio_path": 2, "m|composer": 2}
    assert got["shared audio paths", "b.wav"] == 2 and got["shared symbolic paths", "s.mxl"] == 2 and ("shared audio paths", "a.wav") not in got
    assert ("several recordings", "c") in got if alone else ("several recordings", "c") not in got
