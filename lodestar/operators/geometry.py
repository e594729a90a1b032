"""Centroids, axes, leave-one-out probes and neighbour searches over labelled vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.vectors import dot, minus, unit
from lodestar.sources.workspace import share_code


def mean_vectors(df: DataFrame, keys: Sequence[str], vector: str = "embedding", normalised: bool = True) -> DataFrame:
    """The mean vector of each group as ``vector``, with the group's row count ``n``.

    Elements are averaged as (group, position) pairs, so the sums combine on the map side and a large group is never
    gathered; only one value per position and task is shuffled.
    """
    long = df.select(*keys, F.posexplode(vector).alias("pos", "x"))
    sums = long.groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("x").alias("n"))
    lists = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"), F.max("n").alias("n"))
    mean = F.transform("v", lambda s: s["x"])
    return lists.select(*keys, (unit(mean) if normalised else mean).alias("vector"), "n")


def similarity_to(targets: DataFrame, anchors: DataFrame, target_vector: Column, anchor_vector: Column) -> DataFrame:
    """Every target with every anchor and ``similarity``, rounded to six digits; the vectors are of unit length.

    Anchors (prompts, centroids) are few by nature; the planner broadcasts them only while they are below its limit.
    """
    return targets.crossJoin(anchors).withColumn("similarity", F.round(dot(target_vector, anchor_vector), 6))


def axis_between(centroids: DataFrame, key: str, positive, negative) -> DataFrame:
    """One row ``axis``: the unit difference of two groups' centroids."""
    pick = lambda k: F.max_by("vector", F.when(F.col(key) == k, 1))
    both = centroids.filter(F.col(key).isin(positive, negative)).agg(pick(positive).alias("a"), pick(negative).alias("b"))
    return both.select(unit(minus(F.col("a"), F.col("b"))).alias("axis"))


def leave_one_out(units: DataFrame, unit_id: str, group: str, vector: str = "vector") -> DataFrame:
    """Each unit against each group's centroid, its own group without the unit itself: (unit, group, other, similarity).

    The own centroid is the group's sum minus the unit, so nothing is joined per held-out unit. A unit alone in its
    group has no own centroid and its row for it is missing.
    """
    long = units.select(F.col(group).alias("__g"), F.posexplode(vector).alias("pos", "x"))
    sums = long.groupBy("__g", "pos").agg(F.sum("x").alias("x"), F.count("x").alias("n"))
    sums = sums.groupBy("__g").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("__sum"), F.max("n").alias("__n"))
    pairs = units.crossJoin(sums.withColumnRenamed("__g", "other"))
    own = F.col(group) == F.col("other")
    left = F.when(own, minus(F.col("__sum"), F.col(vector))).otherwise(F.col("__sum"))
    pairs = pairs.filter(~own | (F.col("__n") > 1)).withColumn("__c", unit(left))
    return pairs.select(unit_id, group, "other", F.round(dot(F.col(vector), F.col("__c")), 6).alias("similarity"))


def predict(pairs: DataFrame, unit_id: str, group: str) -> DataFrame:
    """The most similar group of every unit; ties go to the smallest group."""
    best = F.max_by("other", F.struct("similarity", (-F.col("other")).alias("o")))
    return pairs.groupBy(unit_id, group).agg(best.alias("predicted"))


def margins(pairs: DataFrame, unit_id: str, group: str) -> DataFrame:
    """Similarity to the own centroid minus that to the best other; units without peers are left out."""
    own = F.max(F.when(F.col("other") == F.col(group), F.col("similarity")))
    best = F.max(F.when(F.col("other") != F.col(group), F.col("similarity")))
    rows = pairs.groupBy(unit_id, group).agg(own.alias("own"), best.alias("best_other"))
    return rows.filter("own is not null").withColumn("margin", F.round(F.col("own") - F.col("best_other"), 6))


def _matrix(t: pa.Table, column: str) -> np.ndarray:
    """Vectors of one length as unit rows of a matrix."""
    flat = t.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(t.num_rows, -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


#: Bytes of one block's vectors in double precision, and the pairs of rows that are held at a time.
BLOCK_BYTES, TILE = 16 << 20, (512, 2048)


def _extent(df: DataFrame, vector: str, block_rows: int | None) -> tuple[int, int]:
    """How many rows there are, and how many of their vectors make a block: a row is copied once per block, so that copies
    become fewer the larger the blocks are; products are made in tiles and don't grow with them."""
    n, widest = df.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    return n, block_rows or max(1, BLOCK_BYTES // (8 * max(1, widest or 1)))


def _tasks(df: DataFrame) -> int:
    """Tasks that keep the cluster busy; more would only copy more."""
    return min(_width(df), 8 * df.sparkSession.sparkContext.defaultParallelism)


def _steps(n: int, most: int) -> list[tuple[int, int]]:
    """Ranges of ``n`` places, growing to ``most``: what the first ones find spares the others from being looked at."""
    cuts, size = [0], 16
    while cuts[-1] < n:
        cuts.append(min(n, cuts[-1] + size))
        size = min(4 * size, most)
    return [*zip(cuts[:-1], cuts[1:], strict=True)]


class _Best:
    """The ``k`` best partners of each of ``n`` rows. Partners come in the order of their ids, so that one with an equal
    similarity never takes the place of one that is there."""

    def __init__(self, n: int, k: int):
        self.k, self.s, self.i = k, np.full((n, k), -2.0), np.zeros((n, k), np.int64)

    def cut(self, start: int, stop: int) -> np.ndarray:
        """What a similarity must exceed, before it is rounded, to be looked at."""
        return self.s[start:stop, -1] + 4e-7

    def offer(self, rows: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        s = np.round(s, 6)
        better = s > self.s[rows, -1]
        rows, ids, s = rows[better], ids[better], s[better]
        if not len(rows):
            return
        seen = np.unique(rows)
        rows, ids, s = np.concatenate([np.repeat(seen, self.k), rows]), np.concatenate([self.i[seen].ravel(), ids]), np.concatenate([self.s[seen].ravel(), s])
        order = np.lexsort((ids, -s, rows))
        rows, ids, s = rows[order], ids[order], s[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
        use = place < self.k
        self.s[rows[use], place[use]], self.i[rows[use], place[use]] = s[use], ids[use]

    def table(self, ids: np.ndarray, schema: pa.Schema) -> pa.Table:
        use = self.s > -2
        return pa.table([pa.array(np.broadcast_to(ids[:, None], use.shape)[use]), pa.array(self.i[use]), pa.array(self.s[use])], schema=schema)


def _above(rough: np.ndarray, x: np.ndarray, y: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where products of unit rows exceed a cut: (row, column, product in double precision), from products in single
    precision, which are off by less than one of its steps for each element and a few more."""
    slack = (x.shape[1] + 16) * 2.0**-23
    at = np.flatnonzero(rough > (cut - slack).astype(np.float32))
    if 8 * len(at) * x.shape[1] > BLOCK_BYTES:  # so many that all are made again
        sure = x @ y.T
        u, v = np.nonzero(sure > cut)
        return u, v, sure[u, v]
    u, v = np.divmod(at, rough.shape[1])
    return u, v, np.einsum("ij,ij->i", x[u], y[v])


def _grid(n: int, partitions: int, most_rows: int) -> int:
    """Into how many blocks rows are dealt: each pair of blocks is a task, so about the root of the number of tasks, and
    more only where a block would hold too many rows. A row is copied once per block."""
    return max(1, math.ceil(math.sqrt(2 * partitions)) if n > partitions else 1, -(-n // most_rows))


def _block(by: str, blocks: int) -> Column:
    """The block of a row, of the width of the numbers that blocks are paired with: both sides of a cogroup are dealt out by
    the hashes of their keys, and equal numbers of two widths have two hashes."""
    return F.pmod(F.xxhash64(by), F.lit(blocks)).cast("int")


def _dealt(df: DataFrame, blocks: int, names: Sequence[str]) -> DataFrame:
    """(names, v, b) with the block of each row."""
    return df.select(*names, F.col("v").cast("array<double>").alias("v"), _block(names[0], blocks).alias("b"))


def _met(rows: DataFrame, names: Sequence[str], blocks: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of every unordered pair of blocks (lb, rb); a block meets itself on the left side only.

    A pair is much work for its bytes, so the number of partitions is given: by their bytes they would be put together.
    """
    tasks = min(blocks * (blocks + 1) // 2, _width(rows))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o")
    left = rows.select(*names, F.col("b").alias("lb"), every).withColumnRenamed("o", "rb").filter("lb <= rb")
    right = rows.select(*names, F.col("b").alias("rb"), every).withColumnRenamed("o", "lb").filter("lb < rb")
    right = right.toDF(*right.columns)  # a table of its own: both sides come from one
    return left.repartition(tasks, "lb", "rb"), right.repartition(tasks, "lb", "rb")


def _width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def nearest(df: DataFrame, k: int, item: str = "vec_id", vector: str = "embedding", block_rows: int | None = None) -> DataFrame:
    """The ``k`` most similar other items of every item: (item, neighbour, similarity, rank); ties to the lower id.

    A blocked nested loop: items fall into blocks, each unordered pair of blocks meets in one task as two matrices whose
    product serves both sides, and the partial results are ranked. Products are made in tiles and in single precision; only
    what may exceed the ``k``-th best so far is made again in double precision and sorted. Memory is two blocks and a tile, whatever the table's size; the number of blocks
    follows the number of tasks, not of rows, as long as they fit.
    """
    share_code(df.sparkSession)
    n, most = _extent(df, vector, block_rows)
    blocks = _grid(n, _tasks(df), most)
    rows = _dealt(df.select(F.col(item).alias("id"), F.col(vector).alias("v")), blocks, ["id"])
    left, right = _met(rows, ["id", "v"], blocks)
    schema = pa.schema([("id", pa.int64()), ("neighbour", pa.int64()), ("similarity", pa.float64())])

    def meet(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        alone = key[0].as_py() == key[1].as_py()
        b = a if alone else b
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        (i, x), (j, y) = ((ids[o], _matrix(t, "v")[o]) for t in (a, b) for ids in (t.column("id").to_numpy(),) for o in (np.argsort(ids),))
        rough = [m.astype(np.float32) for m in (x, y)]
        mine, theirs = _Best(len(i), k), _Best(len(j), k)
        for r, r_end in _steps(len(i), TILE[0]):
            for c, c_end in _steps(len(j), TILE[1]):
                s = rough[0][r:r_end] @ rough[1][c:c_end].T
                u, v, sure = _above(s, x[r:r_end], y[c:c_end], mine.cut(r, r_end)[:, None])
                if alone:
                    u, v, sure = (t[i[u + r] != j[v + c]] for t in (u, v, sure))
                mine.offer(u + r, j[v + c], sure)
                if not alone:
                    u, v, sure = _above(s, x[r:r_end], y[c:c_end], theirs.cut(c, c_end)[None, :])
                    theirs.offer(v + c, i[u + r], sure)
        return mine.table(i, schema) if alone else pa.concat_tables([mine.table(i, schema), theirs.table(j, schema)])

    part = left.groupBy("lb", "rb").cogroup(right.groupBy("lb", "rb")).applyInArrow(meet, "id long, neighbour long, similarity double")
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    return part.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).withColumnRenamed("id", item)


def _products(a: pa.Table, b: pa.Table, digits: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Rounded products of all rows of ``a`` and ``b`` and, where some have none, which: those of a null vector and of
    vectors of two lengths."""
    sizes = [pc.fill_null(pc.list_value_length(t.column("v")), -1).to_numpy() for t in (a, b)]
    same = len(found := np.unique(np.concatenate(sizes))) == 1 and found[0] >= 0
    s = np.zeros((a.num_rows, b.num_rows))
    none = None if same else np.ones(s.shape, bool)
    for size in found[found >= 0]:
        at = [np.flatnonzero(n == size) for n in sizes]
        x, y = (t.column("v").take(pa.array(r)).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(r), size) for t, r in zip((a, b), at, strict=True))
        if same:
            s = x @ y.T
        else:
            s[np.ix_(*at)], none[np.ix_(*at)] = x @ y.T, False
    return np.round(s, digits) + 0.0, none  # without negative zeros


def matched(a: DataFrame, b: DataFrame, key: str, item_a: str, item_b: str, vector: str = "vector", block_rows: int = 1024) -> DataFrame:
    """(item_a, item_b, key, similarity): every row of ``a`` with every row of ``b`` of its key, the inner product in six
    digits; null for a null vector. A null key matches nothing.

    The rows of a key fall into blocks on both sides, as many as it has rows for, and two blocks meet as matrices: no task
    holds a key, and a row is copied once for some thousand pairs.
    """
    share_code(a.sparkSession)
    kinds = [dict(df.dtypes)[c] for df, c in ((a, item_a), (b, item_b), (a, key))]
    shape = pa.schema([(item_a, pa.int64()), (item_b, pa.int64()), (key, pa.int64()), ("similarity", pa.float64())])
    ones = [df.select(F.col(key).alias("key"), F.lit(side).alias("side")) for df, side in ((a, 0), (b, 1))]
    n = lambda side: F.ceil(F.count_if(F.col("side") == side) / block_rows).cast("int")
    counts = ones[0].unionByName(ones[1]).filter("key is not null").groupBy("key").agg(n(0).alias("m"), n(1).alias("n")).filter("m > 0 and n > 0")
    wide = counts.filter("m > 1 or n > 1")  # a key of one block needs no count: there are never many of the others

    def dealt(df: DataFrame, item: str, own: str, others: str, mine: str, other: str) -> DataFrame:
        rows = df.select(F.col(item).alias("id"), F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).filter("key is not null")
        rows = rows.join(wide, "key", "left").fillna(1, ["m", "n"])
        block = F.pmod(F.xxhash64("id", "v"), F.col(own)).cast("int")
        rows = rows.select("id", "key", "v", block.alias(mine), F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(other))
        return rows.repartition(_width(df), "key", "lb", "rb")

    left, right = dealt(a, item_a, "m", "n", "lb", "rb"), dealt(b, item_b, "n", "m", "rb", "lb")
    right = right.toDF(*right.columns)  # a table of its own: both sides may come from one

    def meet(group: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return shape.empty_table()
        s, none = _products(x, y, 6)
        i, j = (t.column("id").combine_chunks() for t in (x, y))
        i, j = i.take(pa.array(np.repeat(np.arange(len(i)), len(j)))), j.take(pa.array(np.tile(np.arange(len(j)), len(i))))
        where = pa.array(np.full(s.size, group[0].as_py(), np.int64))
        return pa.table([i, j, where, pa.array(s.ravel(), mask=None if none is None else none.ravel())], schema=shape)

    return left.groupBy("key", "lb", "rb").cogroup(right.groupBy("key", "lb", "rb")).applyInArrow(
        meet, f"`{item_a}` {kinds[0]}, `{item_b}` {kinds[1]}, `{key}` {kinds[2]}, similarity double"
    )


def cross_similarities(a: DataFrame, b: DataFrame, vector: str = "vector", block_rows: int = 4096) -> DataFrame:
    """(similarity, n): how many pairs of a row of ``a`` and a row of ``b`` have each similarity, in six digits.

    Blocks of both sides meet as matrices in a grid of tasks; at most two million values leave a task or the whole.
    """
    share_code(a.sparkSession)
    side = max(1, math.ceil(math.sqrt(_width(a))))
    m, n = (max(side, -(-t.count() // block_rows)) for t in (a, b))
    numbered = lambda t, blocks, mine, other, others: t.select(
        F.col(vector).cast("array<double>").alias("v"), _block(vector, blocks).alias(mine), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other)
    )
    left, right = numbered(a, m, "lb", "rb", n), numbered(b, n, "rb", "lb", m)
    right = right.toDF(*right.columns)  # a table of its own: both sides may come from one
    schema = pa.schema([("micro", pa.int64()), ("n", pa.int64())])

    def meet(_: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return schema.empty_table()
        values, counts = np.unique(np.rint(np.round(_matrix(x, "v") @ _matrix(y, "v").T, 6) * 1e6).astype(np.int64), return_counts=True)
        return pa.table([pa.array(values), pa.array(counts)], schema=schema)

    part = left.groupBy("lb", "rb").cogroup(right.groupBy("lb", "rb")).applyInArrow(meet, "micro long, n long")
    return part.groupBy("micro").agg(F.sum("n").alias("n")).select((F.col("micro") / 1e6).alias("similarity"), "n")


def top_across(df: DataFrame, group: str, item: str, k: int, vector: str = "vector", block_rows: int = 4096) -> DataFrame:
    """(group_a, group_b, item_a, item_b, similarity): of each pair of groups the ``k`` most similar pairs of items, ties to
    the lower ids. Blocks meet as matrices, each task keeps the best of its pairs of groups, and these are ranked."""
    share_code(df.sparkSession)
    blocks = _grid(df.count(), _width(df), block_rows)
    rows = _dealt(df.select(F.col(item).alias("id"), F.col(group).alias("g"), F.col(vector).alias("v")), blocks, ["id", "g"])
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o")
    left = rows.select("id", "g", "v", F.col("b").alias("lb"), every).withColumnRenamed("o", "rb").filter("lb <= rb")
    right = rows.select("id", "g", "v", F.col("b").alias("rb"), every).withColumnRenamed("o", "lb").filter("lb < rb")
    right = right.toDF(*right.columns)  # a table of its own: both sides come from one
    schema = pa.schema([("group_a", pa.int64()), ("group_b", pa.int64()), ("item_a", pa.int64()), ("item_b", pa.int64()), ("similarity", pa.float64())])

    def meet(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        alone = key[0].as_py() == key[1].as_py()
        b = a if alone else b
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        (i, g, x), (j, h, y) = ((t.column("id").to_numpy(), t.column("g").to_numpy().astype(np.int64), _matrix(t, "v")) for t in (a, b))
        s = np.round(x @ y.T, 6)
        parts = []
        for p in np.unique(g):
            for q in np.unique(h):
                if p == q or alone and p > q:
                    continue
                r, c = np.flatnonzero(g == p), np.flatnonzero(h == q)
                t = s[np.ix_(r, c)].ravel()
                least = np.partition(t, len(t) - min(k, len(t)))[len(t) - min(k, len(t))]
                near = np.flatnonzero(t >= least)  # the best and all that tie with the last of them
                u, v = i[r[near // len(c)]], j[c[near % len(c)]]
                u, v = (u, v) if p < q else (v, u)
                order = np.lexsort((v, u, -t[near]))[:k]
                parts.append(pa.table([pa.array(np.full(len(order), min(p, q))), pa.array(np.full(len(order), max(p, q))), pa.array(u[order]), pa.array(v[order]), pa.array(t[near][order])], schema=schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    part = left.groupBy("lb", "rb").cogroup(right.groupBy("lb", "rb")).applyInArrow(meet, "group_a long, group_b long, item_a long, item_b long, similarity double")
    w = Window.partitionBy("group_a", "group_b").orderBy(F.desc("similarity"), "item_a", "item_b")
    return part.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


#: Values of a similarity from 0 to 1, and the pairs that are counted at a time.
_MICRO, _COUNTED = 1_000_000, 4 << 20


def pair_similarities(df: DataFrame, item: str, group: str, vector: str = "embedding", block_rows: int | None = None) -> DataFrame:
    """Histograms of the similarities of all pairs ``i < j``: (within, similarity, n), similarity in six digits.

    Counting equal rounded values where the pairs are made keeps the output small: at most two million values and
    two classes, whatever the number of pairs. Products are made and counted in tiles, so memory is two blocks, a tile and
    the counts.
    """
    share_code(df.sparkSession)
    n, most = _extent(df, vector, block_rows)
    blocks = _grid(n, _tasks(df), most)
    rows = df.select(F.col(item).alias("id"), F.col(group).alias("g"), F.col(vector).cast("array<double>").alias("v"), _block(item, blocks).alias("b"))
    left, right = _met(rows, ["id", "g", "v"], blocks)
    schema = pa.schema([("within", pa.bool_()), ("micro", pa.int64()), ("n", pa.int64())])

    def meet(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        alone = key[0].as_py() == key[1].as_py()
        b = a if alone else b
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        (i, g, x), (j, h, y) = ((t.column("id").to_numpy(), t.column("g").to_numpy(), _matrix(t, "v")) for t in (a, b))
        for m in (x, y):
            m[np.isnan(m).any(1)] = 0  # what has no direction is like nothing
        counts = np.zeros(2 * (2 * _MICRO + 1), np.int64)  # of each value first those between, then those within
        tall = max(1, _COUNTED // min(len(j), TILE[1]))
        for r in range(0, len(i), tall):
            for c in range(0, len(j), TILE[1]):
                u, v = slice(r, r + tall), slice(c, c + TILE[1])
                s = x[u] @ y[v].T
                np.rint(np.multiply(s, _MICRO, out=s), out=s)
                place = (s + _MICRO).astype(np.int64)
                place *= 2
                place += g[u, None] == h[None, v]
                if alone:
                    place = place[i[u, None] < j[None, v]]
                if place.size:
                    least = int(place.min())
                    found = np.bincount((place - least).ravel())
                    counts[least : least + len(found)] += found
        at = np.flatnonzero(counts)
        return pa.table([pa.array(at % 2 == 1), pa.array(at // 2 - _MICRO), pa.array(counts[at])], schema=schema)

    part = left.groupBy("lb", "rb").cogroup(right.groupBy("lb", "rb")).applyInArrow(meet, "within boolean, micro long, n long")
    return part.groupBy("within", "micro").agg(F.sum("n").alias("n")).select("within", (F.col("micro") / 1e6).alias("similarity"), "n")


def cross_fitted(units: DataFrame, unit_id: str, group: str, positive, negative, vector: str = "vector") -> DataFrame:
    """Each unit of two groups on the axis between the groups without it: (unit, group, score, predicted)."""
    rows = units.filter(F.col(group).isin(positive, negative))
    long = rows.select(F.col(group).alias("__g"), F.posexplode(vector).alias("pos", "x"))
    sums = long.groupBy("__g", "pos").agg(F.sum("x").alias("x"), F.count("x").alias("n"))
    lists = sums.groupBy("__g").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("s"))
    pick = lambda k: F.max_by("s", F.when(F.col("__g") == k, 1))
    both = lists.agg(pick(positive).alias("pa"), pick(negative).alias("pb"))
    less = lambda k, c: F.when(F.col(group) == k, minus(F.col(c), F.col(vector))).otherwise(F.col(c))
    axis = unit(minus(unit(less(positive, "pa")), unit(less(negative, "pb"))))
    scored = rows.crossJoin(both).select(unit_id, group, F.round(dot(F.col(vector), axis), 6).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0, F.lit(positive)).otherwise(F.lit(negative)))


#: Most rows of the small side of :func:`against_few`.
FEW = 4096


def against_few(rows: DataFrame, few: DataFrame, row: str, vector: str, item: str, item_vector: str, digits: int = 6) -> DataFrame:
    """(row, item, score): the inner product of every row with each of a few items, whose number is checked.

    The items travel with the tasks as one matrix, so each batch of rows is one product and nothing is joined.
    """
    share_code(rows.sparkSession)
    t = few.select(item, F.col(item_vector).cast("array<double>").alias("v")).limit(FEW + 1).toArrow()
    if t.num_rows > FEW:
        raise ValueError(f"at most {FEW} items can be given to all rows")
    ids, kinds = t.column(item).combine_chunks(), (dict(rows.dtypes)[row], dict(few.dtypes)[item])
    flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    matrix = flat.reshape(t.num_rows, len(flat) // max(1, t.num_rows))

    def run(batches):
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            s = np.round(x @ matrix.T, digits)
            places = pa.array(np.repeat(np.arange(batch.num_rows), len(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(places), ids.take(pa.array(np.tile(np.arange(len(ids)), batch.num_rows))), pa.array(s.ravel())], names=["row", "item", "score"])

    out = rows.select(row, F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, f"row {kinds[0]}, item {kinds[1]}, score double")
    return out.withColumnsRenamed({"row": row, "item": item})


def fold_axes(units: DataFrame, unit_id: str, group: str, positive, negative, vector: str = "vector") -> DataFrame:
    """(unit, group, axis, vector): for each unit of two groups the unit axis between the groups' centroids without it.

    A fold's sums are the whole sums less the unit's own row, so all folds come from two vectors; a fold whose unit is alone
    in its group has no axis and is left out.
    """
    rows = units.filter(F.col(group).isin(positive, negative)).select(unit_id, group, vector)
    means = mean_vectors(rows, [group], vector, normalised=False)
    scaled = means.select(group, F.transform("vector", lambda x: x * F.col("n")).alias("s"), "n")
    pick = lambda k, c: F.max_by(c, F.when(F.col(group) == k, 1))
    both = scaled.agg(*[pick(k, c).alias(f"{c}{i}") for i, k in enumerate((positive, negative)) for c in ("s", "n")])
    sides = rows.crossJoin(F.broadcast(both))  # one row
    less = lambda k, i: F.when(F.col(group) == k, minus(F.col(f"s{i}"), F.col(vector))).otherwise(F.col(f"s{i}"))
    alone = (F.col(group) == positive) & (F.col("n0") < 2) | (F.col(group) == negative) & (F.col("n1") < 2) | F.col("n0").isNull() | F.col("n1").isNull()
    axis = unit(minus(unit(less(positive, 0)), unit(less(negative, 1))))
    return sides.filter(~alone).select(unit_id, group, axis.alias("axis"), vector)


def stratum_measures(units: DataFrame, stratum: str, group: str, positive, negative, vector: str = "vector") -> DataFrame:
    """One row per stratum in which both groups have units: counts, cosine of the two centroids, mean similarity of pairs
    within and between all of the stratum's groups, their difference, and how many units of the two groups lie nearer
    to their own centroid than to the other when they are left out of it.

    Sums over pairs come from sums of vectors: all pairs of a set are half of the square of its sum less its squares.
    """
    per = mean_vectors(units, [stratum, group], vector, normalised=False)
    per = per.select(stratum, group, "n", F.transform("vector", lambda x: x * F.col("n")).alias("s"))
    squares = units.groupBy(stratum, group).agg(F.sum(dot(F.col(vector), F.col(vector))).alias("q"))
    per = per.join(squares, [stratum, group]).withColumn("within", (dot(F.col("s"), F.col("s")) - F.col("q")) / 2)
    whole = mean_vectors(units, [stratum], vector, normalised=False).select(stratum, F.col("n").alias("all"), F.transform("vector", lambda x: x * F.col("n")).alias("t"))
    pick = lambda k, c: F.max_by(c, F.when(F.col(group) == k, 1))
    sums = per.groupBy(stratum).agg(
        *[pick(k, c).alias(f"{c}{i}") for i, k in enumerate((positive, negative)) for c in ("s", "n")], F.sum("within").alias("w"), F.sum("q").alias("q"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("nw"),
    ).filter("n0 is not null and n1 is not null").join(whole, stratum)
    pairs, total = F.col("all") * (F.col("all") - 1) / 2, (dot(F.col("t"), F.col("t")) - F.col("q")) / 2
    within, between = F.try_divide("w", "nw"), F.try_divide(total - F.col("w"), pairs - F.col("nw"))
    own = units.filter(F.col(group).isin(positive, negative)).join(sums.select(stratum, "s0", "s1", "n0", "n1"), stratum)
    mine = F.col(group) == positive
    left = lambda i, same: unit(F.when(same, minus(F.col(f"s{i}"), F.col(vector))).otherwise(F.col(f"s{i}")))
    gap = F.round(dot(F.col(vector), left(0, mine)), 9) - F.round(dot(F.col(vector), left(1, ~mine)), 9)
    able = F.when(mine, F.col("n0") > 1).otherwise(F.col("n1") > 1)
    held = own.filter(able).groupBy(stratum).agg(F.count(F.lit(1)).alias("held_out"), F.count_if(F.when(mine, gap > 0).otherwise(gap < 0)).alias("nearer"))
    r = lambda c: F.round(c, 6)
    return sums.join(held, stratum, "left").select(
        stratum, F.col("all").alias("units"), F.col("n0").alias("units_a"), F.col("n1").alias("units_b"), r(dot(unit(F.col("s0")), unit(F.col("s1")))).alias("centroid_similarity"),
        r(within).alias("within_mean"), r(between).alias("between_mean"), r(within - between).alias("difference"), F.coalesce("held_out", F.lit(0)).alias("held_out"), F.coalesce("nearer", F.lit(0)).alias("nearer"),
    )
