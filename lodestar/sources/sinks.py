"""Writers of tables and reports. Spark's committer makes each write appear whole or not at all."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.quality import ContractError
from lodestar.sources import schemas
from lodestar.sources.workspace import exists


def write_text_table(rows: DataFrame, path: str, columns: Sequence[str] | None = None, force: bool = False, allow_empty: bool = True) -> None:
    """A CSV table with a header, missing as ``""``; an existing path is replaced only if forced."""
    if not force and exists(rows.sparkSession, path):
        raise ContractError(f"{path} exists")
    out = rows.select(*(columns or rows.columns))
    if not allow_empty and not out.limit(1).count():
        raise ContractError(f"nothing to write to {path}")
    text = out.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in out.columns])
    text.write.mode("overwrite" if force else "errorifexists").csv(path, header=True, emptyValue="", nullValue="")


def write_similarities(rows: DataFrame, path: str, force: bool = False) -> None:
    """The long table of similarities: passage, composer, prompt, text, value."""
    write_text_table(rows, path, ["passage_id", "composer", "prompt_id", "prompt_text", "cosine_similarity"], force)


def write_manifest_snapshot(rows: DataFrame, path: str, force: bool = False) -> list[str]:
    """Required columns and those optional ones that any row fills; returns the columns written."""
    extras = [c for c in schemas.PASSAGE_EXTRAS if c in rows.columns]
    used = rows.agg(*[F.bool_or(F.coalesce(F.col(c), F.lit("")) != "").alias(c) for c in extras]).first() if extras else {}
    columns = [*schemas.PASSAGES, *[c for c in extras if used[c]]]
    write_text_table(rows, path, columns, force, allow_empty=False)
    return columns


def failures(records: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """Records whose state is not success, with the state and its message."""
    bad = states.filter("status <> 'success'").select(key, "status", "error_message")
    return records.join(bad, key)


def review(records: DataFrame, order: Sequence[str], limit: int, **wanted: str) -> DataFrame:
    """Records whose columns have the wanted values, the first ``limit`` in an order: a review list of that length."""
    for column, value in wanted.items():
        records = records.filter(F.lower(F.trim(F.col(column))) == value.strip().lower())
    return records.orderBy(*order).limit(limit)


def write_report(report: DataFrame, path: str, force: bool = False) -> None:
    """A report of a few rows as one JSON file."""
    report.coalesce(1).write.mode("overwrite" if force else "errorifexists").json(path)


def write_manifest_bundle(rows: DataFrame, issues: DataFrame, path: str, report: dict) -> dict:
    """A clean table, the rows left out and a report with counts, in one folder that must not exist; the report is written
    last, so a folder with a report is whole. A table without rows is an error."""
    spark = rows.sparkSession
    if exists(spark, path):
        raise ContractError(f"{path} exists")
    write_text_table(rows, f"{path}/manifest", allow_empty=False)
    write_text_table(issues, f"{path}/issues")
    counts = {k: spark.read.csv(f"{path}/{k}", header=True, multiLine=True, escape='"').count() if df.columns else 0 for k, df in (("manifest", rows), ("issues", issues))}
    written = {**report, "rows": counts["manifest"], "issue_rows": counts["issues"]}
    one = spark.createDataFrame([(json.dumps(written, sort_keys=True),)], "report string").withColumn("fingerprint", F.sha2("report", 256))
    write_report(one, f"{path}/report")
    return written


def render_report(report: DataFrame, title: str) -> str:
    """A report of a few rows (metric, value, status) as Markdown; it is small by nature."""
    lines = [f"| {r['metric']} | {r['value']} | {r['status']} |" for r in report.orderBy("metric").collect()]
    return "\n".join([f"# {title}", "", "| metric | value | status |", "|-|-|-|", *lines, ""])
