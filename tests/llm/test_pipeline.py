import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from lodestar.llm import packing, rules, tokens
from lodestar.llm.oracles import ORACLES
from lodestar.llm.queries import QUERIES
from lodestar.sources.workspace import materialize
from tests.llm.helpers import components, rule_counts

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the shared tables are absent")


def _duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_agrees(spark, name):
    df = QUERIES[name](spark, DATA)
    rel = _duck().sql(ORACLES[name])
    order = sorted(df.columns)
    assert order == sorted(rel.columns)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    at = [list(rel.columns).index(c) for c in order]
    assert got == sorted((tuple(r[k] for k in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - {"op11_collocations", "op13_neighbours"}))
def test_one_row_per_document_or_page(spark, name):
    rows = QUERIES[name](spark, DATA)
    table = "pages" if name in ("op5_warc", "op10_html") else "documents"
    n = spark.read.parquet(f"{DATA}/{table}.parquet").count()
    assert rows.count() == n if name != "op6_packing" else rows.select("doc_id").distinct().count() == n


def test_each_query_vector_has_its_neighbours(spark):
    rows = QUERIES["op13_neighbours"](spark, DATA).groupBy("query_id").count().collect()
    assert {r["query_id"] for r in rows} == set(range(0, 500, 20)) and {r["count"] for r in rows} == {20}


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 14)} <= {x[: x.index("_") + 1] for x in names if x.startswith("op") and x[2].isdigit()} and "pipeline" in names


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    start = {r["doc_id"]: r for r in docs.collect()}
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = seen
        seen = materialize(stage(spark, before, DATA), "stage")
        assert seen.columns == docs.columns
        ids = [r["doc_id"] for r in seen.collect()]
        if name == "quality rules":
            want = {i for i, r in start.items() if (c := rule_counts(r["text"]))[0] >= rules.MIN_WORDS and 100 * c[4] <= rules.MAX_REPEAT_PERCENT * c[0]}
            assert set(ids) == want
        elif name == "n-gram Jaccard join":
            rows = sorted(before.collect(), key=lambda r: r["doc_id"])
            groups = components([r["text"] for r in rows])
            assert sorted(ids) == sorted({rows[g]["doc_id"] for g in groups})
        elif name == "mixing":
            assert set(ids) <= {r["doc_id"] for r in before.collect()} and max(ids.count(i) for i in set(ids)) <= 3
        else:
            assert set(ids) <= {r["doc_id"] for r in before.collect()} and len(ids) > 0.8 * before.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, seen, DATA).collect()
    assert sum(p["length"] for p in pieces) == sum(len(tokens.encode(r["text"], special=True)) + 1 for r in seen.collect())
    assert {"sequence_id", "offset"} <= set(packing._NAMES)


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, one id on unlike texts, and columns named like the stages' own."""
    words = lambda k, n=60: " ".join(f"w{k}x{i}" for i in range(n))
    good = [(i, words(i), "en", f"s{i % 3}", "c") for i in range(12)]
    rows = [*good, good[0], (3, words(300), "en", None, "c"), (None, words(400), "en", "s1", "c"), (None, words(400), "en", "s1", "c"), (20, None, None, None, None), (21, "", "en", "s1", "c"), (22, words(22, 60_000), "en", "s2", "c")]
    names = ["taken", "finish", "size", "row", "score", "predicted", "__id", "__node", "__keep", "base_failed", "n_words", "key", "word"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string")
    docs = docs.withColumns({n: F.lit(n) for n in names})
    spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen = materialize(stage(spark, seen, str(tmp_path)), "stage")
        assert seen.columns == docs.columns
        assert all(r[n] == n for r in seen.collect() for n in names)
    left = [(r["doc_id"], len(r["text"].split())) for r in seen.collect()]
    assert {i for i, _ in left} <= {None, 22, *range(12)} and (20, 0) not in left
    assert corpus_pipeline.STAGES[-1][1](spark, seen, str(tmp_path)).count() > 0


def test_empty_table_through_all_stages(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen = materialize(stage(spark, seen, str(tmp_path)), "stage")
        assert seen.columns == docs.columns and seen.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, seen, str(tmp_path)).count() == 0
