import pytest
from pyspark.sql import functions as F

from lodestar.operators import digests, extraction
from lodestar.operators.quality import ContractError
from lodestar.sources.versions import Replaced, Store, bucket
from lodestar.sources.workspace import exists, new_path


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_commit_is_all_or_nothing(spark):
    store = Store(spark, new_path(spark, "store"))
    with pytest.raises(ContractError):
        store.read("a")
    a, b = spark.range(5), spark.range(3).withColumn("x", F.lit("y"))
    assert store.commit({"a": a, "b": b}) == 1
    broken = spark.range(4).select((F.lit(1) / F.assert_true(F.col("id") < 2).cast("int")).alias("id"))
    with pytest.raises(Exception):  # noqa: B017
        store.commit({"a": spark.range(9), "b": broken})
    assert store.versions() == [1] and store.read("a").count() == 5  # the old version stays readable
    assert store.commit({"a": spark.range(7)}) == 2
    assert store.read("a").count() == 7 and store.read("b").count() == 3 and store.read("a", 1).count() == 5


def test_two_writers_of_one_version(spark):
    path = new_path(spark, "store")
    first, second = Store(spark, path), Store(spark, path)
    first.commit({"a": spark.range(1)})
    record = second.manifest()
    first.commit({"a": spark.range(2)})
    with pytest.raises(ContractError, match="another writer"):
        second._publish(record | {"version": 2})
    assert first.read("a").count() == 2


def test_buckets_are_replaced_alone(spark):
    store = Store(spark, new_path(spark, "store"))
    rows = spark.range(40).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v")).withColumn("bucket", bucket("k", 4))
    store.commit({"t": Replaced(rows, [0, 1, 2, 3])})
    before = store.manifest()["tables"]["t"]["parts"]
    store.commit({"t": Replaced(rows.filter("bucket = 2").withColumn("v", F.lit(2)), [2])})
    after = store.manifest()["tables"]["t"]["parts"]
    assert {b for b in after if after[b] != before[b]} == {"2"}
    want = [(r["k"], 2 if r["bucket"] == 2 else 1) for r in rows.collect()]
    assert _rows(store.read("t")) == sorted(want)
    store.commit({"t": Replaced(rows.filter("false"), [1])})  # a bucket that has become empty
    assert _rows(store.read("t")) == sorted(w for w, r in zip(want, rows.collect(), strict=True) if r["bucket"] != 1)


def test_staleness_by_partition(spark):
    store = Store(spark, new_path(spark, "store"))
    rows = spark.range(1000).withColumn("x", F.lit(1.5))
    store.commit({"a": spark.range(1)}, inputs={"r": rows})
    assert store.stale({"r": rows.repartition(7)}) == []
    changed = rows.withColumn("x", F.when(F.col("id") == 77, 2.0).otherwise(F.col("x")))
    stale = store.stale({"r": changed})
    part = changed.filter("id = 77").select(digests.part(["id"])).first()[0]
    assert stale == [("r", part)]
    assert store.stale({"other": rows.limit(1)}) and store.stale({"r": rows.unionByName(rows.limit(1))})
    store.commit({"a": spark.range(2)})
    assert store.stale({"r": rows}) == []  # a commit without inputs keeps those of its base


def test_expired_data_goes(spark):
    path = new_path(spark, "store")
    store = Store(spark, path)
    for n in (1, 2, 3):
        store.commit({"a": spark.range(n)})
    assert store.expire(keep=1) == 2 and store.versions() == [3] and store.read("a").count() == 3
    assert not exists(spark, f"{path}/manifests/v00000001.json")


def test_differences(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1.0), (3, None, 2.0), (4, "z", 0.0), (4, "z", 0.0), (5, "w", 1.0), (None, "n", 1.0)], "k int, s string, v double")
    b = spark.createDataFrame([(1, None, None), (2, "y", 1.0), (3, "", 2.0), (4, "z", 0.0), (6, "w", 1.0), (None, "n", 1.0)], "k int, s string, v double")
    got = _rows(digests.differences(a, b, ["k"]))
    assert got == [(1, "changed"), (3, "changed"), (4, "repeated"), (5, "missing"), (6, "unexpected")]
    assert digests.differences(a, a.repartition(3), ["k"]).collect() == []
    assert digests.table_digest(a) == digests.table_digest(a.orderBy(F.desc("k")).repartition(2)) != digests.table_digest(b)
    one, other = (spark.createDataFrame([r], "p string, q string") for r in (("a", None), (None, "a")))
    assert digests.table_digest(one) != digests.table_digest(other)  # a null is not skipped


def test_equal_tables_are_not_joined(spark):
    rows = spark.range(100).withColumn("v", F.col("id") * 2)
    plan = digests.differences(rows, rows.repartition(3), ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan or "LocalRelation <empty>" in plan


ITEMS = [(1, "d1", "ok", None), (2, "d1", "ok", None), (3, "d2", "bad", None), (4, "d3", "ok too", None), (5, None, None, "unsupported"), (6, "d4", "odd", None)]


def _selected(spark, items=ITEMS):
    return spark.createDataFrame(items, "item int, digest string, payload string, problem string")


def _measure(value):
    if value == "bad":
        raise ValueError("cannot be read")
    return len(value)


def test_cache_and_failures(spark):
    store = Store(spark, new_path(spark, "cache"))
    run = lambda version, f=_measure, retry=False, items=ITEMS: extraction.extract(store, _selected(spark, items), "item", version, extraction.attempted(f, "int"), retry)
    first = run("1")
    assert first.counts == {"selected": 6, "unreadable": 1, "digests": 4, "computed": 4, "computed_well": 3, "succeeded": 4, "failed": 2}
    assert _rows(first.successes) == [(1, "d1", 2), (2, "d1", 2), (4, "d3", 6), (6, "d4", 3)]
    assert {r["item"]: r["reason"] for r in first.failures.collect()} == {3: "ValueError: cannot be read", 5: "unsupported"}
    def never(value):
        raise AssertionError("computed again")

    again = run("1", never)
    assert again.counts["computed"] == 0 and _rows(again.successes) == _rows(first.successes) and store.versions() == [1]
    more = run("1", items=[*ITEMS, (7, "d5", "new", None)])
    assert (more.counts["computed"], more.counts["succeeded"], more.counts["failed"]) == (1, 5, 2)
    mended = run("1", len, retry=True)
    assert mended.counts["computed"] == 1 and mended.counts["failed"] == 1  # the failure is gone from its table
    assert store.read("failures").count() == 0
    newer = run("2", lambda value: -1)
    assert newer.counts["computed"] == 4 and {r["features"] for r in newer.successes.collect()} == {-1}
    assert store.read("features").filter("version = '1' and digest <> 'd5'").count() == 0  # a digest has one version
    assert store.read("features").filter("digest = 'd5'").first()["version"] == "1"


def test_a_run_that_breaks_leaves_the_cache(spark):
    store = Store(spark, new_path(spark, "cache"))
    extraction.extract(store, _selected(spark), "item", "1", extraction.attempted(_measure, "int"))
    twice = lambda df: extraction.attempted(len, "int")(df).unionByName(extraction.attempted(len, "int")(df))
    with pytest.raises(ContractError, match="several results"):
        extraction.extract(store, _selected(spark), "item", "2", twice)
    assert store.versions() == [1] and store.read("features").filter("version = '1'").count() == 3
    nothing = extraction.extract(store, _selected(spark), "item", "3", lambda df: extraction.attempted(len, "int")(df).filter("false"))
    assert nothing.counts["succeeded"] == 0 and {r["reason"] for r in nothing.failures.collect()} == {"no result", "unsupported"}
    empty = extraction.extract(Store(spark, new_path(spark, "cache")), _selected(spark, []), "item", "1", extraction.attempted(len, "int"))
    assert set(empty.counts.values()) == {0}
