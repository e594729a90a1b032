"""N-gram Jaccard self-join by a size-aware heavy-light scheme, down to connected components.

A document is the set of its five-word shingles. Equal sets are one node. Two nodes link when 100 times their
intersection is at least 75 times their union, which for sizes a and b is an overlap of ``required(a, b)``.

* Light: two sets of at most ``boundary`` shingles link exactly if they share a subset of the required size. Each
  enumerates its subsets of the sizes that its partners can require; in a bucket of equal subsets every member that
  links to any other also links to the smallest, so a star of links is exact.
* Heavy: a set of more shingles is entered in the inverted lists of its rarest shingles, as many as a partner could
  avoid at most, and lists are scanned. Rarity is a count over all documents in a sketch of ``SKETCH`` counters;
  any order is correct, this one keeps lists short.
* The boundary is the size for which enumerating all smaller sets and scanning for the rest costs least, from the
  numbers of small sets and the measured length of their lists.

Lists are scanned twice. First each entry is held against the first entry of its size class and the one before it,
a number linear in the list; these links already join large groups of copies. Then the entries of different
components in one list are held against each other, all of them, so no link is lost; entries known to be in one
component are never paired. Pairs are verified on whole sets, which only pairs that their bitmaps allow are joined with:
pairs of large sets that share a passage by chance grow with the square of the documents, and a set is twenty times as
wide as its bitmap.

Defined cases: null text is empty; documents without words have no shingles and link to nothing; very long texts are
cut into shingles whole; equal texts, as in repeated rows, are one component; rows are documents, so rows with one doc_id
may be in different components; a null doc_id links to nothing and its component is null; an empty table gives an
empty result; only the two columns named are read, and ``representatives`` returns the others as they are, whatever
their names.
Shingles, and nodes, are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import column_arrays, map_batches, mix64, schema_with, skew_join, text_of, width, word_hashes
from lodestar.llm.components import connected
from lodestar.sources.workspace import discard, made, materialize, release

SHINGLE = 5
#: Similarity as a fraction.
ABOVE, BELOW = 75, 100
#: Counters of the rarity sketch, in blocks, and the size up to which a set may be light.
SKETCH, BLOCKS, LIGHTEST = 1 << 20, 64, 14
#: Bits of the smallest and the largest parity bitmap.
LEAST_BITS, MOST_BITS = 256, 1 << 16
#: Columns of a bitmap of one size for all sets, held inside list entries.
SHORT = [f"p{k}" for k in range(16)]
#: Keys of a set that an entry carries to tell whether its own is the first that a pair shares.
EARLIER = 32
#: Remainders of ids in the filter that keeps texts nobody asked for out of an exchange; it is broadcast.
REMAINDERS = 1 << 20
#: What verifying a candidate costs, in entries of an inverted list.
VERIFY = 8.0
#: Sets that a task remembers to enter copies once.
REMEMBERED = 1 << 18
#: Entries of a list that are scanned together.
_ROWS = 1 << 16
_STEP = np.random.default_rng(5).integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def required(a: int, b: int) -> int:
    """The overlap that sets of these sizes need: the least o with ``BELOW * o >= ABOVE * (a + b - o)``."""
    return -(-ABOVE * (a + b) // (ABOVE + BELOW))


def _required(a: Column, b: Column) -> Column:
    return F.ceil(ABOVE * (a + b) / (ABOVE + BELOW))


def smallest_partner(n: int) -> int:
    """The least size that a set of ``n`` shingles can link to."""
    return -(-ABOVE * n // BELOW)


def shingles(text: str) -> np.ndarray:
    """Distinct shingle hashes of a text, sorted; a text of fewer words than a shingle is one shingle."""
    w = word_hashes(text)
    if not len(w):
        return w
    if len(w) < SHINGLE:
        h = np.zeros(1, np.uint64)
        for k, x in enumerate(w):
            h += mix64(w[k : k + 1] ^ _STEP[k]) * _STEP[k]
        return mix64(h + np.uint64(len(w)))
    n = len(w) - SHINGLE + 1
    h = np.full(n, SHINGLE, np.uint64)
    for k in range(SHINGLE):
        h += mix64(w[k : k + n] ^ _STEP[k]) * _STEP[k]
    return np.unique(mix64(h))


def node_of(found: np.ndarray) -> int:
    """A signed 64-bit digest of a sorted set."""
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def parity(found: np.ndarray) -> np.ndarray:
    """A bitmap of the set, about two bits a shingle: each shingle flips one bit. Two bitmaps differ in at most as many
    bits as the sets have elements apart, so a pair with too many is no link."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(found) - 1).bit_length()))
    flips = np.bincount((found >> np.uint64(64 - MOST_BITS.bit_length() + 1)).astype(np.int64) & (bits - 1), minlength=bits)
    return np.packbits((flips & 1).astype(np.uint8), bitorder="little")


def words(found: np.ndarray) -> list[int]:
    """A parity bitmap of one size for all sets, as signed words."""
    bits = 64 * len(SHORT)
    flips = np.bincount((found >> np.uint64(64 - MOST_BITS.bit_length() + 1)).astype(np.int64) & (bits - 1), minlength=bits)
    return np.packbits((flips & 1).astype(np.uint8), bitorder="little").view("<i8").tolist()


def fold(bitmap: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of ``size`` bytes from a longer one; its bits stay parities."""
    while len(bitmap) > size:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] ^ bitmap[half:]
    return bitmap


def subset_sizes(n: int, boundary: int) -> list[int]:
    """The overlaps that light partners can require of a set of ``n`` shingles."""
    partners = range(smallest_partner(n), min(boundary, n * BELOW // ABOVE) + 1)
    return sorted({c for b in partners if (c := required(n, b)) <= min(n, b)})


def prefix(n: int) -> int:
    """How many of its rarest shingles a set is listed under: one of them is shared with every partner."""
    return n - required(n, smallest_partner(n)) + 1


def choose_boundary(sizes: dict[int, int], length: float) -> int:
    """The size up to which sets are light: the cheapest, in list entries, for ``sizes`` sets of each size whose
    shingles' lists have ``length`` entries on average."""
    costs = {}
    for x in range(LIGHTEST + 1):
        light = sum(n * sum(math.comb(s, c) for c in subset_sizes(s, x)) for s, n in sizes.items() if s <= x)
        listed = sum(n * prefix(s) for s, n in sizes.items() if s >= smallest_partner(x + 1))
        scanned = sum(n * prefix(s) * VERIFY * max(0.0, length - 1) for s, n in sizes.items() if s > x)
        costs[x] = light + listed + scanned
    return min(costs, key=lambda x: (costs[x], x))


def _sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n, node, few, bits) of every document, ``few`` the shingles of a small set and ``bits`` its parity
    bitmap; and the counts of the shingles of the task's documents as rows with a ``block``."""
    share = SKETCH // BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.int64)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), *[pa.int64()] * len(SHORT), pa.int32(), pa.binary())
        names = ["doc_id", "n", "node", "few", "bits", *SHORT, "block", "counts"]
        for batch in batches:
            ids, texts = column_arrays(batch, "doc_id", "text")
            found = [shingles(t) for t in texts]
            if found:
                counts += np.bincount((np.concatenate(found) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
            maps = [parity(s) if len(s) else None for s in found]
            short = [(None,) * len(SHORT) if s is None or not len(s) else words(s) for s in found]
            columns = [
                ids,
                [len(s) for s in found],
                [node_of(s) if len(s) else None for s in found],
                [s.view(np.int64).tolist() if 0 < len(s) <= LIGHTEST else None for s in found],
                [None if m is None else m.tobytes() for m in maps],
                *[[x[k] for x in short] for k in range(len(SHORT))],
                [None] * len(ids),
                [None] * len(ids),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        if counts.any():
            for b in range(BLOCKS):
                raw = counts[b * share : (b + 1) * share].astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*[None] * (5 + len(SHORT)), b, raw), kinds, strict=True)], names=names)

    rows = docs.select(F.col("doc_id"), F.col("text"))
    return map_batches(rows, run, "doc_id long, n long, node long, few array<long>, bits binary, " + "".join(f"{p} long, " for p in SHORT) + "block int, counts binary")


def _levels(blocks: DataFrame) -> np.ndarray:
    """The sketch summed over all tasks, as one byte per counter (bits of the count); ``SKETCH`` bytes in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, raw in zip(*column_arrays(batch, "block", "counts"), strict=True):
                sums[b] = sums.get(b, 0) + np.frombuffer(raw, "<u4").astype(np.int64)
        for b, s in sums.items():
            level = np.frexp(s.astype(float))[1].astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["block", "level"])

    dealt = blocks.filter("block is not null").select("block", "counts").repartitionById(min(BLOCKS, width(blocks.sparkSession)), F.col("block"))
    rows = map_batches(dealt, run, "block int, level binary").collect()
    out = np.zeros(SKETCH, np.uint8)
    for r in rows:
        out[r["block"] * (SKETCH // BLOCKS) : (r["block"] + 1) * (SKETCH // BLOCKS)] = np.frombuffer(r["level"], np.uint8)
    return out


def _entries(docs: DataFrame, levels: np.ndarray, boundary: int) -> DataFrame:
    """(key, node, n, at): a set's list entries with the place of the key among its shingles, rarest first; and its
    subsets, with ``at`` minus the subset's size. Of the copies that a task reads, the first makes entries; the scan
    drops what other tasks repeat."""
    listed = smallest_partner(boundary + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(REMEMBERED, np.int64)  # the last node at each remainder
        for batch in batches:
            (texts,) = column_arrays(batch, "text")
            keys, nodes, sizes, places = [], [], [], []
            for t in texts:
                s = shingles(t)
                n = len(s)
                if not n:
                    continue
                node, count = node_of(s), len(keys)
                if seen[node % REMEMBERED] == node:
                    continue
                seen[node % REMEMBERED] = node
                if n <= boundary:
                    for c in subset_sizes(n, boundary):
                        picks = s[np.array(list(itertools.combinations(range(n), c)))]
                        keys.append(mix64((picks * _STEP[0]).sum(1, dtype=np.uint64) ^ mix64(np.array([c], np.uint64))))
                        places.append(np.full(len(picks), -c, np.int32))
                if n >= listed:
                    order = (levels[(s & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                    p = prefix(n)
                    first = np.argpartition(order, p - 1)[:p] if p < n else np.arange(n)
                    keys.append(s[first[np.argsort(order[first])]])
                    places.append(np.arange(p, dtype=np.int32))
                for k in keys[count:]:
                    nodes.append(np.full(len(k), node, np.int64))
                    sizes.append(np.full(len(k), n, np.int32))
            join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array(join(keys, np.uint64).view(np.int64)), pa.array(join(nodes, np.int64)), pa.array(join(sizes, np.int32)), pa.array(join(places, np.int32))],
                names=["key", "node", "n", "at"],
            )

    return map_batches(docs.select("text"), run, "key long, node long, n int, at int")


_NEAR = "key long, node long, n int, at int, lead long, lead_n int, lead_at int, last long, last_n int, last_at int"


def feasible(rows: np.ndarray) -> np.ndarray:
    """Which of the rows (key, node, n, at), sorted by key and n, have a partner in their list by size and place.

    A partner's size m must be within ``smallest_partner`` and what the own rest allows, and its own rest must allow
    the sum: ``(ABOVE + BELOW) * (m - at) >= ABOVE * (n + m)``. The second is a maximum over a range of sizes, from a
    table of maxima over powers of two. Subsets are always kept.
    """
    key, n, at = rows[:, 0], rows[:, 2], rows[:, 3]
    both = ABOVE + BELOW
    group = np.cumsum(np.append(False, key[1:] != key[:-1]))
    wide = int(n.max()) * 2 + 2
    place = group * wide + n
    most = np.minimum(n * BELOW // ABOVE, np.maximum((both * (n - at)) // ABOVE - n, 0))
    low = np.searchsorted(place, group * wide + -(-ABOVE * n // BELOW), "left")
    high = np.searchsorted(place, group * wide + np.minimum(most, wide - 1), "right")
    score = both * (n - at) - ABOVE * n
    table = [score]
    while (1 << len(table)) <= len(rows):
        half = 1 << (len(table) - 1)
        table.append(np.maximum(table[-1][:-half], table[-1][half:]))
    here = np.arange(len(rows))

    def best(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), -1, np.int64)
        size = stop - start
        level = np.frexp(np.maximum(size, 1).astype(float))[1] - 1
        for k in np.unique(level[size > 0]):
            i = np.flatnonzero((level == k) & (size > 0))
            out[i] = np.maximum(table[k][start[i]], table[k][stop[i] - (1 << k)])
        return out

    other = np.maximum(best(low, np.minimum(here, high)), best(np.maximum(here + 1, low), high))
    return (other >= ABOVE * n) | (at < 0)


def _scan(entries: DataFrame) -> DataFrame:
    """The entries of lists with a possible partner, each with the first entry of its size class and the one before.

    A stream over sorted lists: memory is a block of rows. A list too long for a block goes in parts that hand on
    their first and last entry, and keeps all of its entries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = last = None

        def chunks() -> Iterator[tuple[np.ndarray, bool]]:
            """Rows of whole lists, or a part of a list that goes on (True)."""
            parts, n = [], 0
            for batch in batches:
                parts.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1))
                n += batch.num_rows
                if n >= _ROWS:
                    x = np.concatenate(parts)
                    cut = int(np.searchsorted(x[:, 0], x[-1, 0], "left"))
                    if cut:
                        yield x[:cut], False
                        x = x[cut:]
                    if len(x) >= 4 * _ROWS:
                        yield x, True
                        x = x[:0]
                    parts, n = [x], len(x)
            yield np.concatenate(parts) if parts else np.zeros((0, 4), np.int64), False

        kinds = [f.split() for f in _NEAR.split(", ")]
        for x, goes_on in chunks():
            if not len(x):
                continue
            x = x[np.append(True, (x[1:, :2] != x[:-1, :2]).any(1))]  # one entry of a set in a list
            going = last is not None and last[0] == x[0, 0]
            part = (going & (x[:, 0] == x[0, 0])) | (goes_on & (x[:, 0] == x[-1, 0]))
            x = x[part | feasible(x)]
            if not len(x):
                last = None
                continue
            before = np.concatenate([last[None] if going else x[:1], x[:-1]])
            same = x[:, 0] == before[:, 0]
            same[0] = going and x[0, 0] == last[0]
            size, size_before = (np.floor(np.log(np.maximum(v[:, 2], 1)) / math.log(1.3)).astype(np.int64) for v in (x, before))
            begins = ~same | ((size != size_before) & (x[:, 3] >= 0))
            first = np.maximum.accumulate(np.where(begins, np.arange(len(x)), -1))
            leads = np.where(first[:, None] >= 0, x[first], lead if lead is not None else x[:1])
            after = np.append(same[1:], goes_on)
            keep = same | after
            out = np.concatenate([x, leads[:, 1:], np.where(same[:, None], before[:, 1:], x[:, 1:])], 1)[keep]
            lead, last = leads[-1], x[-1] if goes_on else None
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[:, k].astype(np.int64 if kind == "long" else np.int32)) for k, (_, kind) in enumerate(kinds)], names=[f for f, _ in kinds]
            )

    dealt = entries.repartition(width(entries.sparkSession), "key").sortWithinPartitions("key", "n", "node")
    return map_batches(dealt, run, _NEAR)


def _possible(a: str, a_n: str, a_at: str, b: str, b_n: str, b_at: str, boundary: int) -> Column:
    """Whether two entries of a list can link, were the key the first shingle that they share."""
    small, large = F.least(a_n, b_n), F.greatest(a_n, b_n)
    rest = F.least(F.col(a_n) - F.col(a_at), F.col(b_n) - F.col(b_at))
    return (F.col(a) != F.col(b)) & (large > boundary) & (BELOW * small >= ABOVE * large) & (rest >= _required(F.col(a_n), F.col(b_n)))


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def _remainder(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(REMAINDERS)).cast("int")


def _close(pairs: DataFrame, owners: DataFrame) -> DataFrame:
    """The pairs whose parity bitmaps allow a link: an exact filter that moves a fortieth of the sets' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (a, b, x, y) in enumerate(zip(*column_arrays(batch, "u_n", "v_n", "u_bits", "v_bits"), strict=True)):
                p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                size = min(len(p), len(q))
                apart = int(np.bitwise_count(fold(p, size) ^ fold(q, size)).sum())
                if apart <= a + b - 2 * required(a, b):
                    keep.append(k)
            yield batch.select(["u", "v"]).take(pa.array(keep, pa.int64()))

    side = lambda c: owners.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("bits").alias(f"{c}_bits"))
    return map_batches(pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "u_n", "v_n", "u_bits", "v_bits"), run, "u long, v long")


def _verify(pairs: DataFrame, docs: DataFrame, owners: DataFrame) -> DataFrame:
    """The rows (u, v) of ``pairs`` whose sets link. Sets are made again for the nodes in question only; a filter of
    fixed size keeps other texts out of the exchange."""
    nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    wanted = materialize(nodes.join(owners, "node").select("doc_id", "node"), "wanted", share=8)
    asked = wanted.select(_remainder(F.col("doc_id")).alias("__at")).distinct()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, nodes = column_arrays(batch, "text", "node")
            found = [(k, s.tobytes()) for k, t in zip(nodes, texts, strict=True) if node_of(s := shingles(t)) == k]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], names=["node", "set"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(*column_arrays(batch, "x", "y"), strict=True)):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(np.intersect1d(a, b, assume_unique=True)) >= required(len(a), len(b)):
                    keep.append(k)
            yield batch.select(["u", "v"]).take(pa.array(keep, pa.int64()))

    rows = docs.filter("doc_id is not null").withColumn("__at", _remainder(F.col("doc_id"))).join(F.broadcast(asked), "__at", "left_semi").drop("__at")
    sets = materialize(map_batches(rows.join(wanted, "doc_id").select("text", "node"), make, "node long, set binary").dropDuplicates(["node"]), "sets")
    joined = pairs.join(sets.select(F.col("node").alias("v"), F.col("set").alias("y")), "v")
    joined = joined.join(sets.select(F.col("node").alias("u"), F.col("set").alias("x")), "u").select("u", "v", "x", "y")
    return map_batches(joined, meet, "u long, v long")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, node, top) of every document: its set's size, the smallest id that it is linked
    with, its set, and the set that names its component (unlike ids, which may repeat, no two components share it)."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(text).alias("text"))
    found = materialize(_sets(rows), "sets-of-documents")
    levels = _levels(found)
    known = found.filter("block is null").select("doc_id", "n", "node", "few", "bits", *SHORT)
    nodes = known.filter("node is not null and doc_id is not null")
    owners = materialize(nodes.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("few").alias("few"), F.first("bits").alias("bits"), *[F.first(c).alias(c) for c in SHORT]), "owners")

    small = owners.filter("few is not null")
    sizes = {r["n"]: r["count"] for r in small.groupBy("n").count().collect()}  # LIGHTEST rows at most
    lists = small.select(F.explode("few").alias("h")).groupBy("h").count()
    length = lists.agg(F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()[0]
    boundary = choose_boundary(sizes, float(length or 1.0))

    own = rows.filter("doc_id is not null")
    near = materialize(_scan(_entries(own, levels, boundary)), "lists")

    stars = near.filter("at < 0 and node <> lead").filter(_required(F.col("n"), F.col("lead_n")) <= -F.col("at"))
    stars = stars.select(*_pair("node", "lead"))
    listed = near.filter("at >= 0")
    close = [
        listed.filter(_possible("node", "n", "at", w, f"{w}_n", f"{w}_at", boundary)).select(*_pair("node", w)) for w in ("lead", "last")
    ]
    tried = materialize(close[0].unionByName(close[1]).distinct(), "tried", share=4)
    held = made()
    likely = materialize(_close(tried, owners), "close")
    links = materialize(_verify(likely, rows, owners).unionByName(stars).distinct(), "links", share=8)
    release(links, [p for p in made() if p not in held])  # what was read for the last time goes
    roots = materialize(connected(links), "roots", share=8)

    entries = listed.select("key", "node", "n", "at").join(roots, "node", "left")
    entries = materialize(entries.select("key", "node", "n", "at", F.coalesce("root", "node").alias("root")), "entries")
    discard(near)
    mixed = entries.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    # a pair meets in every list that it shares; it is made in the first of them, as far as entries carry earlier keys
    shared = materialize(entries.join(mixed, "key"), "mixed")
    discard(entries)
    entries = shared
    own_keys = F.slice(F.array_sort(F.collect_list(F.struct("at", "key"))), 1, EARLIER)
    first = entries.groupBy("node").agg(own_keys.alias("first"))
    entries = entries.join(first, "node").join(owners.select("node", *SHORT), "node")
    earlier = F.transform(F.filter("first", lambda k: k["at"] < F.col("at")), lambda k: k["key"])
    entries = entries.select("key", "node", "n", "at", "root", earlier.alias("earlier"), *SHORT)
    a, b = (entries.toDF("key", *[f"{c}_{x}" for x in ("node", "n", "at", "root", "earlier", *SHORT)]) for c in "ab")
    apart = sum((F.bit_count(F.col(f"a_{p}").bitwiseXOR(F.col(f"b_{p}"))) for p in SHORT), F.lit(0))
    near_enough = apart <= F.col("a_n") + F.col("b_n") - 2 * _required(F.col("a_n"), F.col("b_n"))
    across = a.join(b, "key").filter(F.col("a_root") < F.col("b_root")).filter(_possible("a_node", "a_n", "a_at", "b_node", "b_n", "b_at", boundary))
    across = across.filter(near_enough).filter(~F.arrays_overlap("a_earlier", "b_earlier"))
    across = across.select(*_pair("a_node", "b_node")).distinct().join(tried, ["u", "v"], "left_anti")
    across = materialize(across, "across", share=4)
    discard(shared, tried)
    # the words of one size tell nothing of large sets, whose pairs by chance grow with the square of the documents
    more = _verify(materialize(_close(across, owners), "close-across"), rows, owners)
    # links between components: the roots of the first round stand for their nodes
    at = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    lifted = more.join(at("u"), "u", "left").join(at("v"), "v", "left")
    lifted = lifted.select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v"))
    above = connected(lifted).select(F.col("node").alias("root"), F.col("root").alias("top"))

    # one row of each set: those with a link by their component, the others by themselves
    tops = skew_join(roots.unionByName(above.select(F.col("root").alias("node"), "root").join(roots.select("node"), "node", "left_anti")), above, "root", "left")
    tops = tops.select("node", F.coalesce("top", "root").alias("top"))
    placed = materialize(owners.select("node", "doc_id").join(tops, "node", "left"), "placed", share=4)
    least = materialize(placed.filter("top is not null").groupBy("top").agg(F.min("doc_id").alias("component_id")), "least", share=8)
    alone = placed.filter("top is null").select("node", F.col("node").alias("top"), F.col("doc_id").alias("component_id"))
    among = skew_join(placed.filter("top is not null").select("node", "top"), least, "top").select("node", "top", "component_id")
    named = materialize(among.unionByName(alone), "named", share=4)
    linked = skew_join(known.select("doc_id", "n", "node"), named, "node", "left")
    return linked.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        "node",
        "top",
    )


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one document of each component, that of the smallest id.

    Rows leave by an anti-join on the ids to drop. Only rows whose id occurs more than once are told apart by their
    sets too; of those that stand for one component, the one with the smallest set hash stays. Components of one smallest
    id, whose rows have different texts, keep one row each. Documents without words and without ids all stay.
    """
    found = materialize(components(docs, doc_id, text), "components").filter("doc_id is not null")
    first = F.col("doc_id") == F.col("component_id")
    ids = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.bool_or(first).alias("stays"))
    ids = materialize(ids.filter("rows > 1 or not stays"), "leaving", share=8)
    names = docs.columns
    free = lambda name: name if name not in names else free(f"{name}_")
    id_, node, keep = free("__id"), free("__node"), free("__keep")
    key = F.col(f"`{doc_id}`").cast("long")
    gone = ids.select(F.col("doc_id").alias(id_))
    single = docs.join(gone, key == F.col(id_), "left_anti")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (texts,) = column_arrays(batch, text)
            nodes = [node_of(s) if len(s := shingles(t or "")) else None for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64())], names=[*names, node])

    repeated = ids.filter("rows > 1").select(F.col("doc_id").alias(id_))
    twice = map_batches(docs.join(repeated, key == F.col(id_), "left_semi"), label, schema_with(docs, **{node: T.LongType()}))
    chosen = found.filter(first & F.col("node").isNotNull()).groupBy(F.col("doc_id").alias(id_), "top").agg(F.min("node").alias(keep)).drop("top")
    kept = twice.filter(F.col(node).isNotNull()).join(chosen, (key == F.col(id_)) & (F.col(node) == F.col(keep))).dropDuplicates([doc_id, node])
    columns = [F.col(f"`{c}`") for c in names]
    return single.select(columns).unionByName(twice.filter(F.col(node).isNull()).select(columns)).unionByName(kept.select(columns))
