import time

import pytest
from pyspark.sql import functions as F

from lodestar.operators.quality import ContractError
from lodestar.sources import schemas, sinks, tables
from lodestar.sources.workspace import materialize, new_path


def _passages(spark):
    row = {c: "1" for c in schemas.PASSAGES} | {"license": "mit", "work_id": ""}
    return spark.createDataFrame([row])


def test_snapshot_keeps_filled_columns(spark):
    path = new_path(spark, "snapshot")
    assert sinks.write_manifest_snapshot(_passages(spark), path) == [*schemas.PASSAGES, "license"]
    assert tables.read_text_table(spark, path, schemas.PASSAGES).first()["license"] == "mit"
    with pytest.raises(ContractError):
        sinks.write_manifest_snapshot(_passages(spark), path)
    with pytest.raises(ContractError):
        sinks.write_manifest_snapshot(_passages(spark).limit(0), new_path(spark, "snapshot"))


def test_similarities_and_reports(spark):
    rows = spark.createDataFrame([("p", "c", "q", None, 0.5)], "passage_id string, composer string, prompt_id string, prompt_text string, cosine_similarity double")
    path = new_path(spark, "similarity")
    sinks.write_similarities(rows, path)
    sinks.write_similarities(rows, path, force=True)
    assert tables.read_text_table(spark, path, ["prompt_text"]).first()["prompt_text"] == ""
    sinks.write_report(rows, f"{path}-report")
    assert spark.read.json(f"{path}-report").count() == 1


def test_failures_and_review(spark):
    records = spark.createDataFrame([(1, "A"), (2, " a "), (3, "b")], "k long, composer string")
    states = spark.createDataFrame([(1, "success", ""), (2, "failed", "no path")], "k long, status string, error_message string")
    assert [(r["k"], r["error_message"]) for r in sinks.failures(records, states, "k").collect()] == [(2, "no path")]
    assert [r["k"] for r in sinks.review(records, [F.desc("k")], 1, composer="A").collect()] == [2]


def test_exchanges_of_a_working_table_leave_no_files(spark):
    files = lambda: spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").count("shuffle_")
    before = files()
    held = materialize(spark.range(1000).repartition(3, "id"), "t")
    deadline = time.time() + 20  # files go in the background
    while files() > before and time.time() < deadline:
        time.sleep(0.2)
    assert files() <= before
    assert len(held.collect()) == 1000
