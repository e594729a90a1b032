import pytest
from pyspark.sql import functions as F

from lodestar.operators import catalogue as C
from lodestar.operators import windows as W


def test_reconcile(spark):
    wanted = spark.createDataFrame([("m", "d1"), ("new", "d1")], "id string, place string")
    have = spark.createDataFrame([("m", "d1"), ("old", "d1"), ("other", "d2")], "id string, place string")
    got = {r["id"]: r["status"] for r in C.reconcile(wanted, have, "id", "place").collect()}
    assert got == {"m": "matched", "new": "unmatched", "old": "stale"}


def test_conflicts_and_what_is_left(spark):
    rows = spark.createDataFrame([("a", "s1"), ("a", "s2"), ("b", "s3"), ("b", "")], "key string, path string")
    got = C.conflicts(rows, "key", ["path"]).collect()
    assert [(r["key"], r["values"]) for r in got] == [("a", "s1;s2")]
    assert C.without_conflicts(rows, "key", ["path"]).count() == 2


def test_registry_takes_the_first_of_a_batch(spark):
    batch = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "z")], "k int, id string")
    known = spark.createDataFrame([("y",)], "id string")
    assert sorted(r["k"] for r in C.new_entries(batch, known, "id", ["k"]).collect()) == [1, 4]


def test_balanced_selection(spark):
    rows = spark.createDataFrame([(g, f"{g}{c}", i) for g in "ab" for c in range(3) for i in range(4)], "g string, c string, i int")
    got = C.balanced(rows, "g", "c", "i", 1, 2, "seed").collect()
    assert len(got) == 4 and all(len({r["c"] for r in got if r["g"] == g}) == 2 for g in "ab")


def test_narrowing_ignores_hints_that_none_meets(spark):
    rows = spark.createDataFrame([(1, "a", True), (1, "b", False), (2, "a", False), (2, "b", False)], "k int, v string, good boolean")
    assert [(r["k"], r["v"]) for r in C.narrowed(rows, ["k"], [F.col("good"), F.lit(False)]).collect()] == [(1, "a")]


def test_labelled_join_raises(spark):
    facts, labels = spark.createDataFrame([(1, "x"), (2, "y")], "k int, c string"), spark.createDataFrame([(1, "x")], "k int, c string")
    with pytest.raises(ValueError):
        C.labelled_join(facts, labels, ["k"], ["c"])
    assert C.labelled_join(facts.filter("k = 1"), labels, ["k"], ["c"]).count() == 1
    with pytest.raises(ValueError):
        C.labelled_join(facts, labels.union(labels), ["k"])


def test_windows_of_eighteen_bars(spark):
    m = spark.createDataFrame([("m", 1, 18), ("short", 1, 3)], "id string, low int, high int")
    got = [(r["bar_start"], r["bar_end"], r["method"]) for r in W.fixed_windows(m, "low", "high", 8).collect()]
    assert got == [(1, 8, "fixed_8_bars"), (9, 16, "fixed_8_bars")]
    got = W.fixed_windows(m, "low", "high", 8, 4).collect()
    assert [(r["bar_start"], r["bar_end"]) for r in got] == [(1, 8), (5, 12), (9, 16)] and got[0]["method"] == "fixed_8_bars_stride_4"


def test_coverage_of_a_gap(spark):
    r = spark.createDataFrame([("a", 1, 3), ("a", 3, 3), ("b", 1, 2)], "id string, bar_start int, bar_end int")
    e = spark.createDataFrame([("a", 1, 0.0, 1.0), ("a", 3, 2.0, 3.0), ("b", 1, 5.0, 5.0)], "id string, m int, onset double, off double")
    got = {(x["id"], x["bar_start"]): x for x in W.coverage(r, e, ["id"], "m", "onset", "off", bucket=2).collect()}
    assert got["a", 1]["missing"] == [2] and got["a", 1]["time_start"] is None
    assert (got["a", 3]["time_start"], got["a", 3]["time_end"]) == (2.0, 3.0)
    assert got["b", 1]["missing"] == [1, 2] and got["b", 1]["covered"] == 0


def test_offsets_of_two_anchors(spark):
    e = spark.createDataFrame([("r", 1, 0.25, 3.0), ("r", 2, 1.25, 3.0)], "id string, m int, t double, length double")
    got = W.offsets(e, ["id"], "m", "t", "length").orderBy("m").collect()
    assert [(r["onset"], r["offset"]) for r in got] == [(0.25, 1.25), (1.25, 2.25)]


def test_islands_with_and_without_tail(spark):
    b = spark.createDataFrame([("p", 4, 1, 10), ("p", 7, 1, 10), ("p", 99, 1, 10)], "id string, at int, low int, high int")
    rows = lambda t: sorted((r["bar_start"], r["bar_end"]) for r in W.islands(b, ["id"], "at", "low", "high", t).collect())
    assert rows(True) == [(1, 4), (5, 7), (8, 10)] and rows(False) == [(1, 4), (5, 7)]


def test_interpolation_goes_on_and_never_below_zero(spark):
    a = spark.createDataFrame([("r", 1.0, 1.0), ("r", 2.0, 3.0), ("r", 3.0, 2.0)], "id string, x double, y double")
    q = spark.createDataFrame([("r", 0.0), ("r", 1.5), ("r", 4.0)], "id string, x double")
    got = [r["value"] for r in W.interpolate(a, q, ["id"], "x", "y").orderBy("x").collect()]
    assert got == [0.0, 2.0, 3.0]


def test_chunks_keep_the_last_part(spark):
    d = spark.createDataFrame([("a", 25.0), ("b", 0.0)], "id string, n double")
    assert [(r["start"], r["end"]) for r in W.chunks(d, "n", 10.0, 0.0).collect()] == [(0.0, 10.0), (10.0, 20.0), (20.0, 25.0)]


def test_parsed_ranges(spark):
    d = spark.createDataFrame([("1-4, 5:8,9-12,x,4-2", 1, 10)], "t string, low int, high int")
    assert [(r["bar_start"], r["bar_end"]) for r in W.parse_ranges(d, "t", "low", "high").collect()] == [(1, 4), (5, 8)]


def test_states_of_both_sides(spark):
    a, b = spark.createDataFrame([(1, "R"), (2, None)], "j int, s string"), spark.createDataFrame([(2, "D"), (3, "F")], "j int, s string")
    got = {r["j"]: (r["s"], r["source"]) for r in C.merge_states(a, b, "j", ["s"]).collect()}
    assert got == {1: ("R", "live"), 2: ("D", "both"), 3: ("F", "recorded")}


def test_numbers_without_gaps(spark):
    rows = C.numbered(spark.range(1000).repartition(7).withColumn("k", F.col("id") * 3 % 1000), ["k"], "n", 1)
    assert [(r["k"], r["n"]) for r in rows.orderBy("n").collect()] == [(i, i + 1) for i in range(1000)]
    assert C.numbered(spark.range(0), ["id"], "n").count() == 0


def test_merged_bundles(spark):
    from lodestar.operators.quality import ContractError
    from lodestar.sources.bundles import merged

    a = spark.createDataFrame([("b", "c2", [1.0]), ("x", "c2", None)], "item_id string, model_space string, embedding array<double>")
    b = spark.createDataFrame([("a", "c2", [2.0], 1)], "item_id string, model_space string, embedding array<double>, extra int")
    assert {r["item_id"]: r["embedding_row"] for r in merged([a, b]).collect()} == {"a": 0, "b": 1, "x": None}
    with pytest.raises(ContractError):
        merged([a, a])


def test_windows_and_islands_are_made_in_the_row_of_a_movement(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    m = spark.createDataFrame([(1, 1, 3), (2, 1, 4), (3, 3, 10), (4, 2, 13)], "id long, low int, high int")
    got = W.window_modes(m, "low", "high", (4, 8))
    assert "Exchange" not in plan(got) and "Window" not in plan(got)
    assert sorted(map(tuple, got.collect())) == [
        (1, 1, 3, "complete_movement"), (2, 1, 4, "complete_movement"), (3, 3, 6, "fixed_4_bars"), (3, 3, 10, "complete_movement"), (3, 7, 10, "fixed_4_bars"),
        (4, 2, 5, "fixed_4_bars"), (4, 2, 9, "fixed_8_bars"), (4, 2, 13, "complete_movement"), (4, 6, 9, "fixed_4_bars"), (4, 10, 13, "fixed_4_bars"),
    ]
    marks = spark.createDataFrame([(1, 1, 9, 4), (1, 1, 9, 4), (1, 1, 9, 7), (1, 1, 9, 12), (2, 1, 4, 4)], "id long, low int, high int, at int")
    islands = W.islands(marks, ["id"], "at", "low", "high", True)
    assert "Window" not in plan(islands) and "Union" not in plan(islands)
    assert sorted(map(tuple, islands.collect())) == [(1, 1, 4), (1, 5, 7), (1, 8, 9), (2, 1, 4)]
