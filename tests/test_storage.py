import pytest
from pyspark.sql import functions as F

from lodestar.operators.quality import ContractError, report, worst
from lodestar.sources import bundles, schemas, tables
from lodestar.sources.workspace import materialize, new_path
from lodestar.streaming import registry

HEAD = ",".join(schemas.PASSAGES)


def _csv(tmp_path, *lines):
    p = tmp_path / "m.csv"
    p.write_text("﻿" + "\n".join([HEAD, *lines]) + "\n", encoding="utf-8")
    return str(p)


def test_manifest(spark, tmp_path):
    got = tables.read_manifest(spark, _csv(tmp_path, "p1,Chopin,W,1,a/b.xml,1,8,C,4/4"), [".xml"]).first()
    assert (got["passage_id"], got["start_bar"], got["end_bar"]) == ("p1", 1, 8)


@pytest.mark.parametrize("line", ["p1,C,W,1,a.xml,1,8,C,", "p1,C,W,1,../a.xml,1,8,C,4/4", "p1,C,W,1,a.xml,8,1,C,4/4", "p1,C,W,1,a.mid,1,8,C,4/4", "-p,C,W,1,a.xml,1,8,C,4/4"])
def test_manifest_defects(spark, tmp_path, line):
    with pytest.raises(ContractError):
        tables.read_manifest(spark, _csv(tmp_path, line), [".xml"])


def test_manifest_without_a_column(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("passage_id\nx\n")
    with pytest.raises(ContractError, match="meter"):
        tables.read_manifest(spark, str(p), [".xml"])


def test_last_lookup_wins(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_text("id,v\na,1\na,2\nb,\n")
    assert {r["id"]: r["v"] for r in tables.read_lookup(spark, str(p), "id").collect()} == {"a": "2", "b": ""}


def test_log_tail_and_command_output(spark, tmp_path):
    p = tmp_path / "x.log"
    p.write_text("a\nb\nc\n")
    assert [(r["line_number"], r["line"]) for r in tables.read_log_tail(spark, str(p), 2).orderBy("line_number").collect()] == [(2, "b"), (3, "c")]
    assert [tuple(r) for r in tables.read_command_output(spark, "1|R\n2\n3|D|x|y", ["id", "s"]).collect()] == [("1", "R"), ("2", ""), ("3", "D")]


def _rows(spark, n=2):
    return spark.createDataFrame([(f"i{k}", "passage", "c2", "fixed_4_bars" if k else "fixed_8_bars", f"h{k}", "pending") for k in range(n + 1)], "item_id string, item_type string, model_space string, passage_generation_method string, content_hash string, status string")


def test_bundle(spark):
    vectors = spark.createDataFrame([("i0", [1.0, 0.0]), ("i1", [0.0, 1.0])], "item_id string, embedding array<double>")
    rows = bundles.aligned(_rows(spark), vectors, size=2)
    path = new_path(spark, "bundle")
    bundles.write_bundle(rows, path, {"model_space": "c2"})
    back, metadata = bundles.read_bundle(spark, path)
    assert metadata == {"model_space": "c2", "rows": 2}
    assert {r["item_id"]: (r["embedding_row"], r["status"]) for r in back.collect()} == {"i0": (0, "success"), "i1": (1, "success"), "i2": (None, "failed")}
    with pytest.raises(ContractError):
        bundles.write_bundle(rows, path, {})
    with pytest.raises(ContractError):
        bundles.aligned(_rows(spark), vectors, size=3)
    assert bundles.successes(back).count() == 2


def test_snapshot_twice(spark):
    path = new_path(spark, "registry")
    rows = _rows(spark, 1).withColumn("embedding_row", F.lit(0))
    assert bundles.snapshot(rows, path, "r1") == (2, 0) and bundles.snapshot(rows, path, "r2") == (0, 2)
    assert sorted(r["window_bars"] for r in spark.read.parquet(path).collect()) == ["4", "8"]


def test_lock(spark):
    path = new_path(spark, "lock")
    assert bundles.lock(spark, path, {"a": 1}) == bundles.lock(spark, path, {"a": 1})
    with pytest.raises(ContractError):
        bundles.lock(spark, path, {"a": 2})


def test_stream_appends_each_key_once(spark):
    source, path, state = new_path(spark, "in"), new_path(spark, "out"), new_path(spark, "state")
    run = lambda: registry.append_new(spark.readStream.schema("k long, t long").parquet(source), path, "k", "t", state).awaitTermination()
    spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "k long, t long").write.parquet(f"{source}")
    run()
    spark.createDataFrame([(2, 5), (3, 5)], "k long, t long").write.mode("append").parquet(f"{source}")
    run()
    assert sorted((r["k"], r["t"]) for r in spark.read.parquet(path).collect()) == [(1, 0), (2, 0), (3, 5)]


def test_resume_and_cache(spark):
    done = spark.createDataFrame([(1, "success"), (2, "failed")], "k long, status string")
    assert [r["k"] for r in registry.remaining(spark.range(1, 4).toDF("k"), done, "k").collect()] == [3]
    assert sorted(r["k"] for r in registry.remaining(spark.range(1, 4).toDF("k"), done, "k", True).collect()) == [2, 3]
    cache = spark.createDataFrame([(1, "v1", 10), (2, "v0", 20)], "k long, version string, x int")
    got = registry.cached(spark.range(1, 3).toDF("k"), cache, "k", "v1", lambda m: m.withColumn("x", F.lit(99)).select("k", "x"))
    assert {r["k"]: r["x"] for r in got.select("k", "x").collect()} == {1: 10, 2: 99}


def test_report_severity(spark):
    rows = report(spark.createDataFrame([(1, 0)], "a int, b int"), errors=["b"], warnings=["a"])
    assert worst(rows) == "warning" and {r["metric"]: r["status"] for r in rows.collect()} == {"a": "warning", "b": "ok"}


def test_materialize_reads_back(spark):
    df = materialize(spark.range(5), "t")
    assert df.count() == 5 and "lodestar" in df.inputFiles()[0]
