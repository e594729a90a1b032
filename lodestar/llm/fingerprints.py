"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A fingerprint is the sum of one wide vector per paragraph (the pieces between line feeds), lane by lane modulo a
power of two: 8 lanes modulo 2**64 from a keyless BLAKE2b of the paragraph, for equality, and 256 lanes modulo 2**32
that hold signed counts of the paragraph's 12-character grams, for likeness; a lane keeps its sign as long as the texts
added have fewer than 2**31 grams, which no string of Spark has. Sums commute, so the order of paragraphs does not
matter, and a paragraph is inserted or deleted by adding or subtracting its vector.

So texts with the same paragraphs in another order have equal fingerprints and likeness 1: that is what they are for.

Defined cases: null text is the empty text, which has one empty paragraph; very long texts are read whole; rows with one
``doc_id`` are ordered by the text's SHA-256 and each is a document of its own; null ids come first; a lone document follows
itself; an empty table gives an empty result; ``edit_likeness`` only reads the two columns named, so others may have any
name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import column_arrays, map_batches, quantile_bounds, schema_with, text_of, width

GRAM, LANES, EQUAL = 12, 256, 8
_CHUNK = 1 << 19
_B = 0xD1342543DE82EF95
_POW = {k: np.uint64(pow(_B, k, 1 << 64)) for k in (1, 2, 4, 8)}


@dataclass
class State:
    """The lanes of a fingerprint; ``+`` and ``-`` insert and delete paragraphs."""

    equal: np.ndarray
    grams: np.ndarray

    def __add__(self, other: State) -> State:
        return State(self.equal + other.equal, self.grams + other.grams)

    def __sub__(self, other: State) -> State:
        return State(self.equal - other.equal, self.grams - other.grams)

    def text(self) -> str:
        """Base64 of all lanes, little-endian."""
        return base64.b64encode(self.equal.astype("<u8").tobytes() + self.grams.astype("<u4").tobytes()).decode()


def empty() -> State:
    """The fingerprint of no paragraph at all."""
    return State(np.zeros(EQUAL, np.uint64), np.zeros(LANES, np.uint32))


def _gram_lanes(text: str) -> np.ndarray:
    """Signed counts of the grams inside paragraphs, by lane."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    total = np.zeros(2 * LANES, np.int64)
    for at in range(0, max(1, len(points) - GRAM + 1), _CHUNK):
        cp = points[at : at + _CHUNK + GRAM - 1].astype(np.uint64)
        if len(cp) < GRAM:
            continue
        h = cp[:-1] * _POW[1] + cp[1:]
        h = h[:-2] * _POW[2] + h[2:]
        four = h
        h = h[:-4] * _POW[4] + h[4:]
        n = len(cp) - GRAM + 1
        h = h[:n] * _POW[4] + four[8 : 8 + n]
        lane = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(55)
        breaks = np.zeros(len(cp) + 1, np.int32)
        np.cumsum(cp == 10, out=breaks[1:])
        if breaks[-1]:
            lane = lane[breaks[GRAM:] == breaks[:-GRAM]]
        total += np.bincount(lane.astype(np.int64), minlength=2 * LANES)
    return total[:LANES] - total[LANES:]


def of_paragraphs(text: str) -> State:
    """The fingerprint of the paragraphs of a text."""
    paragraphs = text.split("\n")
    raw = b"".join(hashlib.blake2b(p.encode("utf-8", "surrogatepass")).digest() for p in paragraphs)
    words = np.frombuffer(raw, "<u8").reshape(-1, EQUAL)
    grams = _gram_lanes(text)
    short = np.fromiter((len(p) < GRAM for p in paragraphs), bool, len(paragraphs))
    if short.any():  # a paragraph without grams counts as one
        lane = (words[short, 0] >> np.uint64(55)).astype(np.int64)
        counts = np.bincount(lane, minlength=2 * LANES)
        grams = grams + counts[:LANES] - counts[LANES:]
    return State(words.sum(axis=0, dtype=np.uint64), grams.astype(np.uint32))


def insert(state: State, paragraph: str) -> State:
    """With one paragraph more."""
    return state + of_paragraphs(paragraph)


def delete(state: State, paragraph: str) -> State:
    """With one paragraph less."""
    return state - of_paragraphs(paragraph)


def likeness(a: State, b: State) -> float:
    """1 for equal fingerprints, else the cosine of the gram lanes, from 0 to just under 1."""
    if np.array_equal(a.equal, b.equal):
        return 1.0
    x, y = a.grams.astype(np.int32).astype(float), b.grams.astype(np.int32).astype(float)
    size = float(np.sqrt((x @ x) * (y @ y)))
    return min(max(float(x @ y) / size, 0.0), 1.0 - 2.0**-20) if size else 0.0


class _Document:
    """A text, cut where its last quarter begins, with the fingerprints of its parts."""

    def __init__(self, doc_id, text: str):
        self.doc_id, self.text = doc_id, text
        self.quarter = len(text) // 4
        self.keep = len(text) - self.quarter
        self.at = text.rfind("\n", 0, self.keep)
        self.shared = of_paragraphs(text[: self.at]) if self.at >= 0 else empty()
        self.state = self.shared + of_paragraphs(text[self.at + 1 :])

    def row(self, after: _Document) -> tuple:
        head = after.text[: self.quarter]
        edited = self.shared + of_paragraphs(self.text[self.at + 1 : self.keep] + head)
        whole = (self.text[: self.keep] + head).encode("utf-8", "surrogatepass")
        return (
            self.doc_id, len(self.text), hashlib.sha256(whole).hexdigest(), self.state.text(), edited.text(),
            likeness(self.state, edited), likeness(self.state, after.state),
        )


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in OUT.split(", ")]


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column ``fingerprint``; a narrow map without a shuffle."""
    names = docs.columns
    if "fingerprint" in names:
        docs, names = docs.drop("fingerprint"), [n for n in names if n != "fingerprint"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (texts,) = column_arrays(batch, text)
            prints = pa.array([of_paragraphs(t or "").text() for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], names=[*names, "fingerprint"])

    return map_batches(docs, run, schema_with(docs, fingerprint=T.StringType()))


def edit_likeness(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (last quarter taken from the next document by id).

    The rows move once: each goes, compressed, to the range of its id; the first row of a range goes to the range
    before it as well, so that every row meets its successor without a global window.
    """
    spark = docs.sparkSession
    pieces = width(spark)
    ids = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(text).alias("text"))
    bounds, nulls = quantile_bounds(ids, "doc_id", pieces)
    if not bounds and not nulls:
        return spark.createDataFrame([], OUT)
    edges = np.array(bounds, np.int64)
    ranges = len(bounds) + 1  # range 0 holds the null ids
    last = len(bounds)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            rows = []
            for i, t in zip(*column_arrays(batch, "doc_id", "text"), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                body, tie = pack.compress(raw), hashlib.sha256(raw).digest()
                at = 0 if i is None else int(np.searchsorted(edges, i, "right"))
                rows.append((at, 0, i, tie, body))
                if i is None or (at > 0 and i == bounds[at - 1]):  # among the first of its range
                    if i is None or (at == 1 and not nulls):
                        rows.append((last, 1, i, tie, body))
                    elif at > 1 or nulls:
                        rows.append((at - 1, 1, i, tie, body))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int8(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
                names=["range", "peek", "doc_id", "tie", "body"],
            )

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        open_row, place = None, None
        for batch in batches:
            rows = []
            for at, peek, i, body in zip(*column_arrays(batch, "range", "peek", "doc_id", "body"), strict=True):
                if peek and open_row is None:
                    continue
                if open_row is not None and at != place:
                    raise ValueError("the ids changed while they were read")
                doc = _Document(i, unpack.decompress(body, max_output_size=1 << 31).decode("utf-8", "surrogatepass"))
                if open_row is not None:
                    rows.append(open_row.row(doc))
                open_row, place = (None, None) if peek else (doc, at)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))],
                names=_NAMES,
            )
        if open_row is not None:
            raise ValueError("the ids changed while they were read")

    dealt = map_batches(ids, deal, "range int, peek byte, doc_id long, tie binary, body binary")
    sorted_rows = dealt.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "peek", "doc_id", "tie")
    return map_batches(sorted_rows.drop("tie"), pair, OUT)
