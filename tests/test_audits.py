"""Gates, sources and statistics against small cases worked out by hand or by brute force."""

import io
import itertools
import json
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import audit, filters, stats
from lodestar.operators.quality import ContractError
from lodestar.sources import bundles, schemas, sinks, tables
from lodestar.sources.workspace import exists, made, materialize, new_path, release
from lodestar.streaming import registry


def _brute(a, b):
    pool, k, seen = a + b, len(a), abs(np.mean(a) - np.mean(b))
    hits = [abs(np.mean([pool[i] for i in pick]) - np.mean([pool[i] for i in range(len(pool)) if i not in pick])) >= seen - 1e-12 for pick in itertools.combinations(range(len(pool)), k)]
    return round(float(np.mean(hits)), 6), len(hits)


def test_permutations_of_any_number_of_units(spark):
    rng = np.random.default_rng(2)
    groups = {"even": (4, 5), "many_few": (30, 2), "few_many": (1, 200), "wide": (21, 3), "sampled": (11, 11), "large": (150, 150)}
    data = {k: (rng.normal(0.6, 1, n).tolist(), rng.normal(0, 1, m).tolist()) for k, (n, m) in groups.items()}
    rows = [(k, f"{s}{i}", s, x) for k, sides in data.items() for s, xs in zip("ab", sides, strict=True) for i, x in enumerate(xs)] + [("none", "a0", "a", 1.0), ("even", "a9", "a", None)]
    units = spark.createDataFrame(rows, "key string, unit string, side string, x double")
    got = {r["key"]: r for r in stats.permutation_test(units, ["key"], "unit", "side", "a", "b", "x", 2500).collect()}
    assert sorted(got) == sorted(groups)
    for k, (a, b) in data.items():
        if math.comb(len(a) + len(b), len(a)) <= 2500:
            assert (got[k]["p_value"], got[k]["tested"], got[k]["method"]) == (*_brute(a, b), "exact")
        else:
            assert (got[k]["tested"], got[k]["method"]) == (2500, "monte_carlo")
            assert abs(got[k]["p_value"] * 2501 - round(got[k]["p_value"] * 2501)) < 0.01
    assert got["large"]["p_value"] < 0.01


def test_families_and_titles(spark):
    rows = spark.createDataFrame([("Emotion", "Op. 1 Fragment"), ("literal", "Study"), (" EMOTION ", None)], "f string, t string")
    assert [r[0] for r in rows.select(filters.of_family(F.col("f"), "Emotional")).collect()] == [True, False, True]
    assert [r[0] for r in rows.select(filters.of_family(F.col("f"), "formal")).collect()] == [False, True, False]
    assert [r[0] for r in rows.select(filters.excluded_title(F.col("t"), ["FRAG", "sketch"])).collect()] == [True, False, False]
    wide = filters.with_columns(rows, ["t", "z"], only=True)
    assert wide.columns == ["t", "z"] and {r["z"] for r in wide.collect()} == {""}
    assert filters.numeric_columns(spark.range(1).select(F.lit("1").alias("a"), F.lit(1).alias("b"), F.lit(1.5).alias("c")), ["c", "a", "b", "d"]) == ["c", "b"]
    names = spark.createDataFrame([("Frédéric Chopin", "w1"), ("CHOPIN", "w2"), ("Bach", "w1")], "n string, w string")
    assert [r[0] for r in names.select(filters.of_composer(F.col("n"), "chópin", F.col("w"), "w1")).collect()] == [True, False, False]


def test_model_that_fails_for_some(spark):
    def model(payloads):
        if any(b"bad" in p for p in payloads):
            raise RuntimeError("bad payload")
        return [np.array([np.inf if p == b"inf" else len(p)]) for p in payloads]

    rows = spark.createDataFrame([(1, "one"), (2, "bad"), (3, "inf"), (4, None), (5, "")], "id long, p string").coalesce(1)
    got = {r["id"]: (r["vector"], r["status"], r["error"]) for r in audit.embedded(rows, "id", "p", model).collect()}
    assert got[1] == ([3.0], "success", None) and got[5] == ([0.0], "success", None)
    assert got[2] == (None, "failed", "RuntimeError: bad payload") and got[3][1] == got[4][1] == "failed"


def test_named_vectors_and_archives(spark, tmp_path):
    for name, v in (("a", np.arange(1, 4.0)), ("b", np.ones((1, 3))), ("c", np.ones(2)), ("d", np.zeros(3))):
        np.save(tmp_path / f"{name}.npy", v)
    (tmp_path / "e.npy").write_bytes(b"nothing")
    got = {r["item_id"]: (r["vector"], r["error"] is None) for r in tables.read_named_vectors(spark, str(tmp_path), 3).collect()}
    assert got["a"] == ([1.0, 2.0, 3.0], True) and got["b"] == ([1.0, 1.0, 1.0], True) and not any(got[k][1] for k in "cde")
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep/x.xml", "<x/>")
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("top.mxl", b"m")
        z.writestr("read.me", b"r")
        z.writestr("in/side.zip", inner.getvalue())
    (tmp_path / "z").mkdir()
    (tmp_path / "z/all.zip").write_bytes(outer.getvalue())
    (tmp_path / "z/broken.zip").write_bytes(b"PK no")
    found = tables.archive_members(tables.read_files(spark, str(tmp_path / "z"))).collect()
    assert {(r["member"], bytes(r["content"])) for r in found if not r["error"]} == {("top.mxl", b"m"), ("in/side.zip!deep/x.xml", b"<x/>")}
    assert sum(r["error"] is not None for r in found) == 1


def test_lookup_release_and_overrides(spark, tmp_path):
    assert tables.read_lookup(spark, f"{tmp_path}/absent.csv", "id").count() == 0
    assert tables.newest_release(spark, f"{tmp_path}/absent") == "unknown"
    for name, text in (("r1.json", '{"release": "one"}'), ("r2.json", '{"corpus_release": " two "}'), ("r3.json", "{broken")):
        (tmp_path / name).write_text(text)
    assert tables.newest_release(spark, str(tmp_path)) == "two"
    (tmp_path / "o.csv").write_text("sha256,reason,evidence\nAB,r,e\ncd,r,e\n")
    assert {r["sha256"] for r in tables.read_overrides(spark, f"{tmp_path}/o.csv", "sha256").collect()} == {"ab", "cd"}
    for bad in ("AB,r,e\nab,r,e", "x,,e", "x,r,", ",r,e"):
        (tmp_path / "p.csv").write_text(f"sha256,reason,evidence\n{bad}\n")
        with pytest.raises(ContractError):
            tables.read_overrides(spark, f"{tmp_path}/p.csv", "sha256")


def test_corpus_contract(spark, tmp_path):
    def write(*rows, extra=""):
        head = [*schemas.CORPUS, "usable"]
        lines = [",".join(str(r.get(c, "x" if c in ("composer",) else "")) for c in head) for r in rows]
        (tmp_path / "c.csv").write_text(",".join(head) + "\n" + "\n".join(lines) + "\n")
        return f"{tmp_path}/c.csv"

    good = {"passage_id": "p:1", "recording_id": "r", "work_id": "w", "bar_start": 1, "bar_end": 4, "usable": "true"}
    path = write(good, {**good, "passage_id": "p2"})
    assert tables.read_corpus(spark, path, "usable").count() == 2
    with pytest.raises(ContractError, match="other_flag"):
        tables.read_corpus(spark, path, "other_flag")
    with pytest.raises(ContractError, match="several values of work_id"):
        tables.read_corpus(spark, write(good, {**good, "passage_id": "p2", "work_id": "v"}))


def test_a_run_has_one_content(spark):
    rows = spark.createDataFrame([(f"i{k}", "passage", "c2", "fixed_4_bars", f"h{k}", k, [float(k), 1.0]) for k in range(4)], "item_id string, item_type string, model_space string, passage_generation_method string, content_hash string, embedding_row long, embedding array<double>")
    path = new_path(spark, "registry")
    assert bundles.snapshot(rows, path, "one") == (4, 0) == bundles.snapshot(rows, path, "one")
    assert bundles.snapshot(rows, path, "two") == (0, 4)
    with pytest.raises(ContractError, match="other content"):
        bundles.snapshot(rows.limit(3), path, "one")
    assert spark.read.parquet(path).count() == 4
    one = bundles.provenance(rows.select("item_id"), spark.createDataFrame([("b", 1, "x"), ("a", 2, "y")], "path string, size long, digest string"), {"z": 1, "a": 2}).first()
    assert one["rows"] == 4 and [f["path"] for f in json.loads(one["inputs"])] == ["a", "b"] and one["settings"] == '{"a":2,"z":1}'


def test_manifest_bundle_and_discovery(spark, tmp_path):
    rows = spark.createDataFrame([("p1", "a, b"), ("p2", "")], "id string, note string")
    path = f"{tmp_path}/bundle"
    assert sinks.write_manifest_bundle(rows, rows.limit(1), path, {"kind": "clean"}) == {"kind": "clean", "rows": 2, "issue_rows": 1}
    with pytest.raises(ContractError):
        sinks.write_manifest_bundle(rows, rows, path, {})
    with pytest.raises(ContractError):
        sinks.write_manifest_bundle(rows.limit(0), rows, f"{tmp_path}/other", {})
    good = spark.createDataFrame([("i", [1.0], 0, "success")], "item_id string, embedding array<double>, embedding_row long, status string")
    bundles.write_bundle(good, f"{tmp_path}/store/x/one", {"model_space": "c2"})
    found = tables.discover_bundles(spark, [f"{tmp_path}/store", f"{tmp_path}/absent"]).collect()
    assert [r["bundle"].rsplit("/", 2)[1:] for r in found] == [["x", "one"]]
    text = sinks.render_report(spark.createDataFrame([("b", 2, "ok"), ("a", 1, "error")], "metric string, value long, status string"), "Audit")
    assert text.splitlines() == ["# Audit", "", "| metric | value | status |", "|-|-|-|", "| a | 1 | error |", "| b | 2 | ok |"]


def test_working_tables_are_released(spark):
    a, b, c = materialize(spark.range(3), "a"), materialize(spark.range(4), "b"), materialize(spark.range(5), "c")
    gone, kept = a.inputFiles()[0].rsplit("/", 1)[0], b.inputFiles()[0].rsplit("/", 1)[0]
    release(b, [p for p in made() if "/a-" in p or "/b-" in p])
    assert not exists(spark, gone) and exists(spark, kept) and b.count() == 4 and c.count() == 5


def test_progress_of_streams(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    seen = registry.Progress()
    spark.streams.addListener(seen)
    try:
        query = registry.append_new(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", "id", "id", f"{tmp_path}/state")
        query.awaitTermination()
        spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        assert seen.rows[str(query.id)] == 5 and not seen.failed
    finally:
        spark.streams.removeListener(seen)
