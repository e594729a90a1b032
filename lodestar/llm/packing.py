"""Packing token pieces into windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows and a rest. Full windows stand alone; rests are gathered in batches of
``BATCH`` pieces, and each batch is divided into near-equal windows: every piece starts as a partial partition
(itself and empty windows), and the two partitions with the largest spread are merged with opposing imbalances, the
fullest window of one with the emptiest of the other, until one is left. If a window exceeds the capacity, the
batch is divided again into more windows.

Batches are made inside a task from the rows it reads, so nothing is shuffled, memory is bounded by a batch and one
document, and a repeated task gives the same windows with the same ids (partition and counter).

Defined cases: null and empty text is a document of the end id alone; very long texts are encoded whole and cut; rows with
one ``doc_id`` are packed each, equal ones too, and pieces of one size are divided in the order read; an empty table gives
an empty result; only the two columns named are read, so others may have any name. A special token's string in a text
is that token, as under ``tokenizers``.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import column_arrays, map_batches, text_of
from lodestar.llm.tokens import VOCABULARY, encode

CAPACITY, DOCUMENT_END = 2048, 1
#: Pieces of a batch at least, and the share of a window that a batch may leave empty before it takes more pieces.
BATCH, SLACK = 1024, 0.05
#: A rest is cut into pieces of at most a quarter of a window: differencing needs several pieces to a window to balance.
PARTS = 4
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [x.split()[0] for x in PIECE_SCHEMA.split(", ")]


def difference(sizes: list[int], ways: int) -> np.ndarray:
    """The window (0 to ``ways`` - 1) of every piece by multiway differencing."""
    n = len(sizes)
    where = np.zeros(n, np.int64)
    if ways <= 1 or n == 0:
        return where
    sums: list[np.ndarray | None] = []
    made: list[tuple] = []
    heap: list[tuple[int, int]] = []
    for k, size in enumerate(sizes):
        s = np.zeros(ways, np.int64)
        s[0] = size  # sums are kept in falling order
        sums.append(s)
        made.append((k,))
        heap.append((-size, k))
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        joined = sums[a] + sums[b][::-1]
        order = np.argsort(-joined, kind="stable").astype(np.int32)
        s = joined[order]
        s -= s[-1]  # only differences matter
        sums[a] = sums[b] = None
        sums.append(s)
        made.append((a, b, order))
        heapq.heappush(heap, (-int(s[0]), len(made) - 1))
    todo = [(heap[0][1], np.arange(ways, dtype=np.int32))]
    while todo:  # from the last merge down: which final window each window of a part became
        k, place = todo.pop()
        if len(made[k]) == 1:
            where[made[k][0]] = place[0]
            continue
        a, b, order = made[k]
        of = np.empty(ways, np.int32)
        of[order] = place
        todo += [(a, of), (b, of[::-1])]
    return where


def divide(sizes: list[int], capacity: int = CAPACITY) -> np.ndarray:
    """Windows of pieces, none fuller than ``capacity``; their number rises until all fit."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        where = difference(sizes, ways)
        if not len(sizes) or np.bincount(where, weights=sizes).max() <= capacity:
            return where
        ways += 1


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end: int = DOCUMENT_END) -> DataFrame:
    """One row per piece: where it lies in its document and in its window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, counter = TaskContext.get().partitionId() << 40, 0
        full: list[tuple] = []
        rests: list[tuple] = []
        held = 0

        def flush() -> None:
            nonlocal counter, rests, held
            where = divide([r[2] for r in rests], capacity)
            filled: dict[int, int] = {}
            names: dict[int, int] = {}
            for w, r in zip(where.tolist(), rests, strict=True):
                if w not in names:
                    names[w], filled[w] = base + counter, 0
                    counter += 1
                full.append((*r, names[w], filled[w]))
                filled[w] += r[2]
            rests, held = [], 0

        def rows() -> pa.RecordBatch:
            columns = list(zip(*full, strict=True)) or [[] for _ in _NAMES]
            full.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_NAMES)

        for batch in batches:
            for i, t in zip(*column_arrays(batch, "doc_id", "text"), strict=True):
                ids = np.append(encode(t, vocabulary, special=True), end).astype("<u4")
                whole = len(ids) - len(ids) % capacity
                for start in (*range(0, whole, capacity), *range(whole, len(ids), capacity // PARTS)):
                    piece = ids[start : start + (capacity if start < whole else capacity // PARTS)]
                    row = (i, start, len(piece), zlib.crc32(piece.tobytes()), len(ids))
                    if len(piece) == capacity:
                        full.append((*row, base + counter, 0))
                        counter += 1
                    else:
                        rests.append(row)
                        held += len(piece)
                        if len(rests) >= BATCH and (-held % capacity <= SLACK * capacity or len(rests) >= 2 * BATCH):
                            flush()
            yield rows()
        if rests:
            flush()
            yield rows()

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(text).alias("text"))
    return map_batches(rows, run, PIECE_SCHEMA)
