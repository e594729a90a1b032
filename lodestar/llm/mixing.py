"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Each source's documents are shuffled by a hash of their id. A pass of a document has a virtual finish time: the words
of its source up to and with it, over all passes, divided by the source's target. The mix is the schedule in the order
of finish times (ties by source, pass and place), truncated at the total budget, the size of the corpus.

A document in which its source's target ends is a packet too long: it is cut there, and what is before has finish time 1.
So all sources reach their targets together at time 1, and what the budget leaves after rounding (less than a word a
source) goes to the next packets. Packets that begin after time 1 are never reached and are not made.

Nothing is gathered. Cumulative sums are exact: documents fall into ``PIECES`` hash ranges whose sums are added up
per source first; packets fall into ``RANGES`` ranges of finish time, whose sums say in which of them the budget ends,
and only that range is sorted to find the one packet in which it does. A pass is taken if it sorts before that packet.

Defined cases: null text has size 0 and is never taken, empty and very long texts are counted whole; a null source is a
source of its own, last in order; rows with one id and one source are ordered by size, equal ones share their fate
by place; a source whose documents are all empty has target 0; an empty table gives an empty result. The rows travel as
one struct, ``row``, so columns of any name come through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import text_of, words_of
from lodestar.operators.catalogue import numbered
from lodestar.sources.workspace import materialize

WEIGHTS, MAX_PASSES, PIECES, RANGES = (5, 2, 1), 3, 4096, 4096
#: Where a packet stands in the schedule.
PLACE = ("finish", "key", "pass", "start")


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size) of every document: all that the mix needs to know."""
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.size(words_of(text_of(text))).cast("long").alias("size"))


def targets(totals: DataFrame) -> DataFrame:
    """``source_size`` and ``target`` by ``key`` from rows (key, name, source_size), one of each source.

    Water filling: with the sources in the order of the level at which each is full (``MAX_PASSES`` sizes by weight), one
    is not full as soon as what the ones before leave, shared among it and all after it, does not reach its level. The
    sources are range-sorted by level; sums of each range and running sums inside it tell the first such source, which
    alone reaches the driver.
    """
    rows = numbered(totals.withColumn("__null", F.col("name").isNull()), ["__null", "name"], "__rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("__rank") % len(WEIGHTS) + 1).cast("int"))
    rows = rows.select("key", "source_size", weight.alias("weight"), (MAX_PASSES * F.col("source_size").cast("double")).alias("cap"))
    rows = rows.withColumn("level", F.col("cap") / F.col("weight")).repartitionByRange("level", "key").withColumn("range", F.spark_partition_id())
    rows = materialize(rows, "sources")
    sums = rows.groupBy("range").agg(F.sum("cap").alias("c"), F.sum("weight").alias("w"), F.sum("source_size").alias("s"))
    every = Window.orderBy("range")  # a row of each range
    before = lambda c: F.coalesce(F.sum(c).over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    whole = lambda c: F.sum(c).over(Window.partitionBy(F.lit(0))).cast("double")
    ranges = sums.select("range", (whole("s") - before("c")).alias("__left"), (whole("w") - before("w")).alias("__shared"))
    inner = Window.partitionBy("range").orderBy("level", "key").rowsBetween(Window.unboundedPreceding, -1)
    run = lambda c: F.coalesce(F.sum(c).over(inner), F.lit(0.0))
    seen = rows.join(ranges, "range").select("level", "key", (F.col("__left") - run("cap")).alias("left"), (F.col("__shared") - run("weight")).alias("shared"))
    first = seen.filter(F.col("left") / F.col("shared") <= F.col("level")).orderBy("level", "key").limit(1).collect()
    if not first:  # all are full
        return rows.select("key", "source_size", F.col("cap").alias("target"))
    at = first[0]
    full = (F.col("level") < at["level"]) | (F.col("level") == at["level"]) & (F.col("key") < at["key"])
    share = F.col("weight") * F.lit(at["left"]) / F.lit(at["shared"])
    return rows.select("key", "source_size", F.when(full, F.col("cap")).otherwise(F.least("cap", share)).alias("target"))


def _packets(queue: DataFrame) -> DataFrame:
    """(:data:`PLACE`, words) of every packet that begins before virtual time 1."""
    per = queue.filter("size > 0").select("key", "start", "passes").select("key", "start", F.posexplode("passes").alias("pass", "p"))
    return per.select("key", "start", "pass", F.explode("p").alias("packet")).select("packet.finish", "key", "pass", "start", "packet.words").filter("words > 0")


def _cut(queue: DataFrame) -> tuple:
    """The packet in which the total budget ends, as (:data:`PLACE`, words that still fit); empty if all fit."""
    budget = queue.agg(F.sum("size")).first()[0] or 0
    packets = _packets(queue).withColumn("range", F.least(F.floor(F.col("finish") * RANGES), F.lit(RANGES)).cast("int"))
    sums = {r["range"]: r["w"] for r in packets.groupBy("range").agg(F.sum("words").alias("w")).collect()}  # RANGES + 1 rows at most
    before = 0
    for at in sorted(sums):
        if before + sums[at] >= budget:
            break
        before += sums[at]
    else:
        return ()
    w = Window.partitionBy("range").orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, -1)
    inside = packets.filter(F.col("range") == at).withColumn("before", F.coalesce(F.sum("words").over(w), F.lit(0)) + F.lit(before))
    row = inside.filter((F.col("before") < budget) & (F.col("before") + F.col("words") >= budget)).first()
    return (*[row[c] for c in PLACE], budget - row["before"]) if row else ()


def fair_queue(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", size: str | None = None) -> DataFrame:
    """(row, size, source_size, target, taken, key, start, passes) of every document.

    ``row`` holds the columns of ``docs``; ``taken`` are the words that the mix takes, over all passes; ``passes`` the
    packets of each pass, (finish, words), and ``start`` the words of the source before the document. ``size`` names a
    column of sizes that are known already.
    """
    sizes = F.size(words_of(text_of(text))).cast("long") if size is None else F.col(f"`{size}`")
    name = F.col(f"`{source}`").cast("string")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), sizes.alias("size"), F.when(name.isNull(), "-").otherwise(F.concat(F.lit("+"), name)).alias("key"), name.alias("name"),
        F.md5(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))).alias("hash"), F.col(f"`{doc_id}`").alias("id"),
    ).withColumn("piece", F.conv(F.substring("hash", 1, 3), 16, 10).cast("int"))
    sums = materialize(rows.groupBy("key", "name", "piece").agg(F.sum("size").alias("n")), "mix", share=8)
    known = targets(sums.groupBy("key").agg(F.first("name").alias("name"), F.sum("n").alias("source_size")))
    before = Window.partitionBy("key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("key", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")).join(known, "key")
    inner = Window.partitionBy("key", "piece").orderBy("hash", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(inner), F.lit(0)) + F.col("offset")
    queue = rows.join(offsets, ["key", "piece"]).select("row", "size", "source_size", "target", "key", start.alias("start"))

    def pass_(i: int) -> Column:
        begins = i * F.col("source_size") + F.col("start")
        ends, line = begins + F.col("size"), F.floor("target")
        packet = lambda finish, words: F.struct(finish.cast("double").alias("finish"), words.cast("long").alias("words"))
        whole = F.array(packet(ends / F.col("target"), F.col("size")))
        cut = F.array(packet(F.lit(1.0), F.greatest(line - begins, F.lit(0))), packet(ends / F.col("target"), ends - F.greatest(line, begins)))
        none = F.array(packet(F.lit(0.0), F.lit(0)))
        return F.when((begins >= F.col("target")) | (F.col("size") == 0), none).when(ends <= F.col("target"), whole).otherwise(cut)

    # written once: the sums of the ranges, the one range and the result read only the columns that they need
    queue = materialize(queue.withColumn("passes", F.array(*[pass_(i) for i in range(MAX_PASSES)])), "queue")
    end = _cut(queue)
    if end:
        here = F.struct(*[F.lit(v).cast(t) for v, t in zip(end[:4], ("double", "string", "int", "long"), strict=True)])
        words = lambda i, p: _clipped(F.struct(p["finish"], F.col("key"), F.lit(i), F.col("start")), here, p["words"], end[4])
    else:
        words = lambda i, p: p["words"]
    zero = F.lit(0).cast("long")
    of = lambda i: F.aggregate(F.transform(F.col("passes")[i], lambda p: words(i, p)), zero, lambda s, n: s + n)
    taken = sum((of(i) for i in range(MAX_PASSES)), zero)
    return queue.select("row", "size", "source_size", "target", taken.alias("taken"), "key", "start", "passes")


def _clipped(place: Column, end: Column, words: Column, fit: int) -> Column:
    """The words of a packet that the budget holds, by its place in the schedule."""
    return F.when(place < end, words).when(place == end, F.least(words, F.lit(fit))).otherwise(F.lit(0)).cast("long")


def schedule(queue: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs``, one of each pass taken, range-sorted by their place in the schedule.

    A pass that the budget cuts is kept if at least half of it fits.
    """
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    rows = queue.filter("taken > 0").withColumn("n", copies).filter("n > 0")
    finishes = F.slice(F.transform("passes", lambda p: F.element_at(p, -1)["finish"]), F.lit(1), F.col("n"))
    return rows.select("row", "key", "start", F.posexplode(finishes).alias("pass", "finish")).orderBy(*PLACE).select("row.*")
