"""Approximate nearest neighbours by largest inner product: multiprobe p-stable hashing with exact reranking.

Rows get one more component, the root of the largest squared norm less their own, and queries a zero, so that the largest
inner product is the smallest distance. A table's bucket of a vector is its tuple of ``floor((a x + b) / w)`` over ``K``
normal directions ``a``. A query visits its own bucket and perturbed ones in the order of their estimated chance of
holding a neighbour at the typical distance: the sum of the logarithms of a normal step's chance to land in each
shifted slot. The best ``T`` of all perturbations come from a beam over the functions, which loses none, since a
prefix of one of the ``T`` best tuples is among the ``T`` best prefixes.

``K`` and ``T`` are fitted on a bounded sample (:data:`SAMPLE_ROWS` and :data:`SAMPLE_QUERIES`): for every ``K`` the
least ``T`` with which the sample's neighbours are met in any table with the wanted recall, and of these the cheapest.
If none reaches it, all rows are one bucket, so the wanted recall is always met. Every row is indexed.
On random vectors without structure neighbours are hardly nearer than strangers, and most rows must be visited.

Equal vectors are one class that keeps its ``k + 1`` smallest ids, as no answer can hold more of them. A bucket of more
than :data:`BLOCK_ROWS` classes or :data:`BLOCK_QUERIES` queries is dealt out as a grid of blocks, so neither a hot
vector nor a dense region meets in one task, and nothing is capped. A block multiplies two matrices and keeps its
``k + 1`` best for every query; what all tables find is merged by rank.

Defined cases: rows with a null id or a vector that is null, empty, zero or holds null or non-finite components take no
part; vectors of unlike lengths never meet; ties go to the smaller id; a row that is repeated with its vector counts
once, and of an id with several vectors each is a candidate, with a query of that id answered for each; other columns are
not read; empty tables have no answers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import map_batches, mix64, skew_join
from lodestar.sources.workspace import materialize, share_code

#: Bounds of the fitted sample, of the probes of a table and of a block.
SAMPLE_ROWS, SAMPLE_QUERIES, MOST_PROBES = 8192, 128, 512
BLOCK_ROWS, BLOCK_QUERIES = 8192, 2048
#: Steps of a slot that a probe may take in each function.
STEPS = np.arange(-3, 4)
#: What one probe of a query costs beside one candidate: a shuffled row beside one product of vectors.
PROBE_COST = 100.0


@dataclass(frozen=True)
class Hashes:
    """The fitted tables: directions (L, K, d + 1), offsets (L, K), slot width, typical distance, largest norm, probes."""

    directions: np.ndarray
    offsets: np.ndarray
    slot: float
    distance: float
    norm: float
    probes: int


def _slots(x: np.ndarray, extra: np.ndarray, directions: np.ndarray, offsets: np.ndarray, slot: float) -> np.ndarray:
    """Positions in units of slots: (rows, L, K)."""
    d = x.shape[1]
    tables, functions, _ = directions.shape
    flat = directions.reshape(tables * functions, directions.shape[2])
    return (x @ flat[:, :d].T + extra[:, None] * flat[:, -1] + offsets.ravel()).reshape(len(x), tables, functions) / slot


def _normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, to seven digits."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = np.exp(-x * x / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x > 0, 1 - tail, tail)


def _chances(position: np.ndarray, slot: float, distance: float) -> np.ndarray:
    """The logarithm of the chance that a neighbour lies a step further, for every function and step."""
    inside = position - np.floor(position)
    scale = slot / max(distance, 1e-9)
    low = (STEPS - inside[..., None]) * scale
    return np.log(np.maximum(_normal(low + scale) - _normal(low), 1e-30))


def _probes(chances: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Steps (rows, T, K) and log chances (rows, T) of the ``most`` likeliest perturbations of one table, likeliest first."""
    rows, functions, steps = chances.shape
    score, taken = np.zeros((rows, 1)), np.zeros((rows, 1, 0), np.int8)
    for f in range(functions):
        wide = (score[:, :, None] + chances[:, None, f, :]).reshape(rows, -1)
        if wide.shape[1] > most:
            keep = np.argpartition(-wide, most - 1, axis=1)[:, :most]
            keep = np.take_along_axis(keep, np.argsort(-np.take_along_axis(wide, keep, 1), axis=1, kind="stable"), 1)
        else:
            keep = np.argsort(-wide, axis=1, kind="stable")
        score = np.take_along_axis(wide, keep, 1)
        before = np.take_along_axis(taken, (keep // steps)[:, :, None], 1)
        taken = np.concatenate([before, STEPS[keep % steps][:, :, None].astype(np.int8)], 2)
    return taken, score


def _keys(slots: np.ndarray, table: int, dims: int) -> np.ndarray:
    """64-bit names of buckets from whole slot numbers (..., K)."""
    h = np.full(slots.shape[:-1], (dims << 16) + table + 1, np.uint64)
    for f in range(slots.shape[-1]):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + slots[..., f].astype(np.int64).view(np.uint64))
    return h.view(np.int64)


def fit(rows: np.ndarray, queries: np.ndarray, own: np.ndarray, count: int, k: int, norm: float, tables: int, recall: float, seed: int) -> Hashes:
    """Tables for ``count`` rows from a sample of them and of queries; ``own[i, j]``: query ``i`` is row ``j``.

    A neighbour of rank ``k`` among all rows has the rank ``k * sample / count`` in the sample, one at least; with fewer
    sampled rows the neighbours are further away than the true ones, so the fit errs to more probes.
    """
    d = rows.shape[1]
    extra = np.sqrt(np.maximum(norm * norm - (rows * rows).sum(1), 0))
    product = queries @ rows.T
    product[own] = -np.inf
    rank = max(1, min(len(rows) - 1, math.ceil(k * len(rows) / max(count, 1))))
    near = np.argsort(-product, axis=1, kind="stable")[:, :rank]
    pairs = [(i, j) for i in range(len(queries)) for j in near[i] if np.isfinite(product[i, j])]
    if not pairs:
        return Hashes(np.zeros((1, 0, d + 1)), np.zeros((1, 0)), 1.0, 1.0, norm, 1)
    left, right = (np.array([p[s] for p in pairs], np.int64) for s in (0, 1))
    gaps = (queries[left] ** 2).sum(1) + norm * norm - 2 * product[left, right]
    distance = float(np.sqrt(max(np.quantile(gaps, 0.5), 0)))
    slot = max(distance, 1e-6 * norm)
    draw = np.random.default_rng(seed)
    deepest = max(1, min(12, math.ceil(math.log2(max(count, 2) / 64))))
    directions = draw.standard_normal((tables, deepest, d + 1))
    offsets = draw.random((tables, deepest)) * slot
    place, asked = _slots(rows, extra, directions, offsets, slot), _slots(queries, np.zeros(len(queries)), directions, offsets, slot)
    chances = _chances(asked, slot, distance)
    best: tuple[float, int, int] = (math.inf, 0, 1)  # one bucket with all rows, if no table reaches the recall
    worse = 0
    for functions in range(1, deepest + 1):
        found = [_probes(chances[:, t, :functions], MOST_PROBES) for t in range(tables)]
        # a pair's probe is found by its score: the step of each function, if there is such a step
        step = np.floor(place[right][:, :, :functions]) - np.floor(asked[left][:, :, :functions]) - STEPS[0]
        reach = ((step >= 0) & (step < len(STEPS))).all(2)
        index = np.clip(step, 0, len(STEPS) - 1).astype(int)
        own_score = np.take_along_axis(chances[left][:, :, :functions], index[..., None], 3)[..., 0].sum(2)
        tried, probes = found[0][1].shape[1], 1
        while True:
            use = min(probes, tried)
            met = np.zeros(len(left), bool)
            for t in range(tables):
                met |= reach[:, t] & (own_score[:, t] >= found[t][1][left, use - 1] - 1e-9)
            if met.mean() >= recall or use == tried:
                break
            probes = math.ceil(probes * 1.25)
        if met.mean() < recall:
            break  # deeper tables reach no more
        visited = 0.0
        for t in range(tables):
            names, sizes = np.unique(_keys(np.floor(place[:, t, :functions]), t, d), return_counts=True)
            wanted = _keys(np.floor(asked[:, t, None, :functions]) + found[t][0][:, :use], t, d)
            at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
            visited += np.where(names[at] == wanted, sizes[at], 0).sum() / len(queries)
        cost = visited * count / len(rows) + PROBE_COST * tables * use
        worse = 0 if cost < best[0] else worse + 1
        if cost < best[0]:
            best = (cost, functions, use)
        if worse == 3:
            break
    _, functions, probes = best
    kept = tables if functions else 1
    return Hashes(directions[:kept, :functions].copy(), offsets[:kept, :functions].copy(), slot, distance, norm, probes)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _hashed(df: DataFrame, hashes: Hashes, probing: bool) -> DataFrame:
    """``df`` (cls, v, ...) with one row per table and probe and its ``bucket``."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("v")
            lengths = np.diff(batch.column(at).offsets.to_numpy())
            for dims in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dims))
                for low in range(0, part.num_rows, 256 if probing else 4096):
                    piece = part.slice(low, 256 if probing else 4096)
                    x = _matrix(piece.column(at))
                    extra = np.zeros(len(x)) if probing else np.sqrt(np.maximum(hashes.norm**2 - (x * x).sum(1), 0))
                    known = dims + 1 == hashes.directions.shape[2]  # other lengths are one bucket each
                    place = _slots(x, extra, hashes.directions, hashes.offsets, hashes.slot) if known else np.zeros((len(x), 1, 0))
                    keys = []
                    for t in range(place.shape[1]):
                        base = np.floor(place[:, t])
                        if probing:
                            steps, _ = _probes(_chances(place[:, t], hashes.slot, hashes.distance), hashes.probes)
                            keys.append(_keys(base[:, None, :] + steps, t, int(dims)))
                        else:
                            keys.append(_keys(base, t, int(dims))[:, None])
                    flat = np.concatenate(keys, 1)
                    lists = pa.ListArray.from_arrays(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32), pa.array(flat.ravel()))
                    yield pa.RecordBatch.from_arrays([*piece.columns, lists], names=[*piece.schema.names, "keys"])

    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return map_batches(df, name, f"{fields}, keys array<long>").withColumn("bucket", F.explode(F.array_distinct("keys"))).drop("keys")


def _meet(k: int):
    """The ``k`` best rows of one block for every query of another."""
    schema = pa.schema([("q", pa.int64()), ("cls", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])

    def meet(_: tuple, asked: pa.Table, rows: pa.Table) -> pa.Table:
        if not asked.num_rows or not rows.num_rows:
            return schema.empty_table()
        a, b = (_matrix(t.column("v").combine_chunks()) for t in (asked, rows))
        names = asked.column("cls").to_numpy()
        scores = a @ b.T
        least = np.partition(scores, len(b) - min(k, len(b)), axis=1)[:, len(b) - min(k, len(b))]
        i, j = np.nonzero(scores >= (least - 1e-9 * (1 + np.abs(least)))[:, None])
        exact = np.concatenate([(a[i[s : s + 65536]] * b[j[s : s + 65536]]).sum(1) for s in range(0, len(i), 65536)])
        ids = rows.column("ids").combine_chunks()
        low = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets.to_numpy()[0]]
        order = np.lexsort((low[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        first = np.searchsorted(i, i)
        top = np.arange(len(i)) - first < k
        return pa.table([pa.array(names[i[top]]), rows.column("cls").take(pa.array(j[top])), ids.take(pa.array(j[top])), pa.array(exact[top])], schema=schema)

    return meet


def _usable(v: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & F.forall(v, lambda x: F.coalesce(fine(x), F.lit(False))) & F.exists(v, lambda x: x != 0)


def _sample(df: DataFrame, n: int) -> pa.Table:
    return df.orderBy(F.xxhash64("cls"), "cls").limit(n).select("cls", F.col("v").cast("array<double>").alias("v")).toArrow()


def nearest(rows: DataFrame, is_query: Column, k: int = 20, item: str = "vec_id", vector: str = "embedding", tables: int = 2, recall: float = 0.96, seed: int = 1) -> DataFrame:
    """(query_id, rank, vec_id, score): of every row that ``is_query`` the ``k`` rows found with the largest inner product.

    ``recall`` is what the fit asks of its sample; ``tables`` is the number of independent tables.
    """
    spark = rows.sparkSession
    share_code(spark)
    valid = rows.filter(F.col(item).isNotNull() & _usable(F.col(vector))).select(F.col(item).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("asks"))
    low = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    ids = F.array_sort(F.collect_set("id")).alias("ids")
    few = valid.withColumn("low", low).filter(F.col("low") <= k + 1).groupBy("v").agg(ids)
    asked = materialize(valid.filter("asks").select("id", "v").distinct(), "asked")
    # whether a class is asked for is known by its vector, as its asking row may not be among the smallest ids
    classes = few.join(asked.select("v").distinct().withColumn("asks", F.lit(True)), "v", "left")
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("cls"), "v", "ids", F.coalesce("asks", F.lit(False)).alias("asks")), "classes")
    out = "query_id long, rank int, vec_id long, score double"
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    seen = classes.agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("most"), F.max(F.size("v")).alias("dims")).first()
    if not seen["n"]:
        return spark.createDataFrame([], out)
    sizes = F.size("v") == seen["dims"]
    sample, wanted = _sample(classes.filter(sizes), SAMPLE_ROWS), _sample(classes.filter("asks").filter(sizes), SAMPLE_QUERIES)
    wanted = wanted if wanted.num_rows else sample.slice(0, SAMPLE_QUERIES)
    x, q = (_matrix(t.column("v").combine_chunks()) for t in (sample, wanted))
    own = wanted.column("cls").to_numpy()[:, None] == sample.column("cls").to_numpy()[None, :]
    hashes = fit(x, q, own, seen["n"], k, math.sqrt(seen["most"]), tables, recall, seed)

    index = _hashed(classes.select("cls", "v", "ids"), hashes, False)
    probes = _hashed(classes.filter("asks").select("cls", "v"), hashes, True)
    dealt = lambda n, most: F.greatest(F.ceil(n / most), F.lit(1)).cast("int")
    load = index.groupBy("bucket").agg(F.count(F.lit(1)).alias("r")).join(probes.groupBy("bucket").agg(F.count(F.lit(1)).alias("a")), "bucket")
    load = materialize(load.select("bucket", dealt(F.col("r"), BLOCK_ROWS).alias("rows"), dealt(F.col("a"), BLOCK_QUERIES).alias("asking")), "load")
    part = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = index.join(load, "bucket").select("cls", "v", "ids", "bucket", part("rows").alias("x"), every("asking").alias("y"))
    right = right.toDF(*right.columns)  # a table of its own: both sides come from one
    left = probes.join(load, "bucket").select("cls", "v", "bucket", every("rows").alias("x"), part("asking").alias("y"))
    met = left.groupBy("bucket", "x", "y").cogroup(right.groupBy("bucket", "x", "y")).applyInArrow(_meet(k + 1), "q long, cls long, ids array<long>, score double")
    # a class that several tables found has one place in the order, so equal rows share a rank
    place = F.dense_rank().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0], "cls"))
    merged = met.withColumn("place", place).filter(F.col("place") <= k + 1).dropDuplicates(["q", "cls"])
    merged = merged.select("q", "score", F.explode("ids").alias("id"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    merged = merged.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
    lists = merged.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("best"))
    answers = materialize(lists.join(classes.select(F.col("cls").alias("q"), "v"), "q").select("v", "best"), "answers")
    found = skew_join(asked, answers, "v").select(F.col("id").alias("query_id"), F.slice(F.filter("best", lambda b: b["id"] != F.col("id")), 1, k).alias("best"))
    return found.select("query_id", F.posexplode("best").alias("rank", "b")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), F.col("b.score").alias("score"))
