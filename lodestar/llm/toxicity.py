"""Toxicity by compression distance.

Two Zstandard dictionaries are trained, one on toxic and one on ordinary labelled text; a text is cut into windows,
each window is compressed under both, and a window's distance is how many bytes the ordinary dictionary needs more.
The thresholds, the window distance from which a window counts and the weights of a document's distances, are
calibrated on labelled documents that the dictionaries have not seen.

Two choices make windows comparable. Letters are coded by the start of their word (two bytes of a hash of all its
letters so far), so a match is a word's beginning and literals do not compress: on plain bytes the entropy stage
drowns the distances (see README). And the dictionaries are filled greedily with the word beginnings that set their
class apart and cover the most texts not yet covered, with what the other class's segments share with this class's
usual words, so that a word that merely begins like a toxic one is no distance, and with a shared tail of common
words, so windows of neither kind have distance 0.

The fit sees at most ``MAX_DOCUMENTS`` labelled documents of each class, chosen by a hash of the id. Word beginnings
are counted on the executors; only the ``MAX_STARTS`` most telling, which texts have them, and histograms of
distances reach the driver.

Defined cases: null text is empty, and an empty one has distance 0 and a score; very long texts are measured whole; equal
texts, as in repeated rows, have equal scores; a document with several labels is toxic if any of them is 1; without
labelled documents of both classes every score is 0; an empty table gives an empty result; a null id counts as not held
out. The rows travel as one struct, ``row``, so columns of any name come through.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import column_arrays, map_batches, mix64, schema_with, text_of
from lodestar.llm.quality import _chance
from lodestar.llm.similarity import shingles
from lodestar.sources.workspace import materialize

MAX_DOCUMENTS, MAX_STARTS = 3000, 1000
#: Share of a class's texts from which on a beginning is usual in it.
USUAL = 0.001
#: Beginnings that a task holds before it passes their counts on.
COUNTED = 100_000
SHORTEST, LONGEST = 3, 12
SEGMENTS, COMMON = 160, 300
#: Letters of a window, and of the next one that it overlaps, so that no word beginning is cut.
WINDOW, OVERLAP = 64, 12
#: Lazy matching of six bytes (three letters) or more, with tables for a dictionary of a few kilobytes.
_SETTINGS = {"window_log": 14, "hash_log": 13, "chain_log": 13, "search_log": 2, "min_match": 6, "target_length": 32, "strategy": zstandard.STRATEGY_LAZY}
_B = 0x9E3779B97F4A7C15
_CHUNK = 1 << 18
_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """Letters of the basic plane; powers of the base and of its inverse."""
    if not _TABLES:
        _TABLES.append(np.array([chr(i).isalpha() for i in range(1 << 16)]))
        for base in (_B, pow(_B, -1, 1 << 64)):
            p = np.full(_CHUNK, base, np.uint64)
            p[0] = 1
            _TABLES.append(np.multiply.accumulate(p))
    return _TABLES


def code(text: str) -> Iterator[np.ndarray]:
    """The coded text in chunks: 16 bits per code point, a hash of its word so far, or of itself if no letter."""
    letters, up, down = _tables()
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    at = 0
    while at < len(points):
        part = points[at : at + _CHUNK]
        letter = letters[np.minimum(part, (1 << 16) - 1)]
        if at + len(part) < len(points) and letter[-1]:
            breaks = np.flatnonzero(~letter)
            if len(breaks):  # end before the word that the chunk would cut
                part, letter = part[: breaks[-1] + 1], letter[: breaks[-1] + 1]
        n = len(part)
        place = np.arange(n)
        start = np.maximum.accumulate(np.where(letter, 0, place + 1))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        first = np.where(letter, start, place)
        h = mix64((sums[1:] - sums[first]) * down[first])
        yield (h >> np.uint64(48)).astype("<u2")
        at += n


def coded(text: str) -> bytes:
    """The whole coded text."""
    return b"".join(c.tobytes() for c in code(text))


def starts(text: str) -> set[str]:
    """The beginnings of the words of a text, lower-cased."""
    found = set()
    for w in set("".join(c if c.isalpha() else " " for c in text.lower()).split()):
        for k in range(SHORTEST, min(len(w), LONGEST) + 1):
            found.add(w[:k])
    return found


def _evidence(own: Column, other: Column, part: float) -> Column:
    """Log likelihood ratio of the share of own texts among those that have a beginning, against chance."""
    both = own + other
    return own * F.log(own / both / part) + F.when(other > 0, other * F.log(other / both / (1 - part))).otherwise(0.0)


def segments(own: list[set[str]], ours: dict[str, int], theirs: dict[str, int], others: int, limit: int = SEGMENTS) -> list[str]:
    """Word beginnings that set a class apart, by greedy cover: the gain of one is its log odds times the texts of
    ``own`` that have it, each counting half as much for every segment that covers it already."""
    n = max(1, len(own))
    odds = {x: math.log((c / n) / ((theirs[x] + 0.5) / max(1, others))) for x, c in ours.items()}
    children, where = defaultdict(list), defaultdict(list)
    for x in ours:
        children[x[:-1]].append(x)
    for i, s in enumerate(own):
        for x in s:
            where[x].append(i)
    covered = np.zeros(n)
    gain = lambda x: float((0.5 ** covered[where[x]]).sum()) * odds[x]
    heap = [(-gain(x), x) for x in sorted(ours)]
    heapq.heapify(heap)
    chosen: list[str] = []
    while heap and len(chosen) < limit:
        _, x = heapq.heappop(heap)
        g = gain(x)
        if heap and g < -heap[0][0] - 1e-9:
            heapq.heappush(heap, (-g, x))
            continue
        if not any(x.startswith(c) for c in chosen):
            chosen.append(x)
            covered[where[x]] += 1
    return list(dict.fromkeys(_whole(x, ours, children) for x in chosen))


def _whole(x: str, counts: dict[str, int], children: dict[str, list[str]]) -> str:
    """A beginning, grown while nearly all texts that have it have one longer beginning."""
    while longer := children.get(x):
        best = max(longer, key=lambda c: (counts[c], c))
        if counts[best] < 0.8 * counts[x]:
            break
        x = best
    return x


def dictionary(chosen: list[str], common: list[str]) -> bytes:
    """Dictionary content, the most telling nearest to the shared tail."""
    return b"".join(coded(f"{x} ") for x in [*chosen[::-1], *common])


@dataclass
class Model:
    """Both dictionaries, the distance from which a window counts, and the weights of a document's distances."""

    toxic: bytes
    ordinary: bytes
    least: float
    weights: np.ndarray


class Meter:
    """Distances of the windows of texts."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.packs = []
        settings = zstandard.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **_SETTINGS)
        for content in (toxic, ordinary):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=settings)
            self.packs.append(zstandard.ZstdCompressor(compression_params=settings, dict_data=d))

    def windows(self, text: str) -> np.ndarray:
        toxic, ordinary = (p.compress for p in self.packs)
        out = []
        for chunk in code(text):
            raw = chunk.tobytes()
            for at in range(0, len(raw), 2 * WINDOW):
                w = raw[at : at + 2 * (WINDOW + OVERLAP)]
                out.append(len(ordinary(w)) - len(toxic(w)))
        return np.array(out or [0], float)


def summary(distances: np.ndarray, least: float) -> np.ndarray:
    """What a document's score is made of: how many of its windows count, whether two do, and their share."""
    count = float((distances >= least).sum())
    return np.array([1.0, math.log1p(count), float(count >= 2), math.sqrt(count / len(distances))])


def calibrate(distances: list[np.ndarray], toxic: np.ndarray, share: float) -> tuple[float, np.ndarray]:
    """The window threshold that parts the classes best, and logistic weights by Newton's method with a ridge.

    The sample holds more toxic documents than the corpus, so documents weigh as if a ``share`` of them were toxic.
    """
    best = (-1.0, 1.0)
    for least in range(1, 25):
        count = np.array([(d >= least).mean() for d in distances])
        clean, other = np.sort(count[toxic == 0]), count[toxic == 1]
        auc = float((np.searchsorted(clean, other, "left") + np.searchsorted(clean, other, "right")).mean() / 2 / len(clean))
        if auc > best[0] + 1e-6:
            best = (auc, float(least))
    x = np.array([summary(d, best[1]) for d in distances])
    w, ridge = np.zeros(x.shape[1]), 1e-2 * np.eye(x.shape[1])
    weight = np.where(toxic == 1, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(h, x.T @ (weight * (p - toxic)) + ridge @ w)
        w = w - np.clip(step, -2, 2)
    return best[1], w


def _sample(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str, text: str, label: str) -> DataFrame:
    """Labelled documents (toxic, chance, text), at most ``MAX_DOCUMENTS`` of each class; ``chance`` is uniform.

    Copies would pass off their words as telling, so of documents that share their least shingle one is kept.
    """
    known = labels.filter(learn).filter(F.col(f"`{doc_id}`").isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col(f"`{doc_id}`").alias("__id")).agg(F.max(label).alias("toxic"))
    known = known.select("__id", "toxic", _chance("__id", 5).alias("__order"), _chance("__id", 6).alias("chance"))
    sides = [known.filter(F.col("toxic") == k).orderBy("__order", "__id").limit(MAX_DOCUMENTS) for k in (0, 1)]
    ids = F.broadcast(sides[0].unionByName(sides[1]))  # at most 2 * MAX_DOCUMENTS ids
    rows = docs.select(F.col(f"`{doc_id}`").alias("__id"), text_of(text).alias("text")).join(ids, "__id").select("toxic", "chance", "text")

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (texts,) = column_arrays(batch, "text")
            keys = [int(s[0] >> np.uint64(1)) if len(s := shingles(t)) else -1 for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=[*batch.schema.names, "key"])

    rows = map_batches(rows, least, schema_with(rows, key=T.LongType()))
    one = F.min(F.struct("chance", "text")).alias("one")
    return materialize(rows.groupBy("toxic", "key").agg(one).select("toxic", "one.chance", "one.text"), "labelled")


def train(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """Fit on labelled documents for which ``learn`` (over the id) holds; None without both classes."""
    sample = _sample(docs, labels, learn, doc_id, text, label)

    learned = sample.filter("chance < 0.6")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            found = sorted(sums[0].keys() | sums[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(found), *[pa.array([s[x] for x in found], pa.int64()) for s in sums]], names=["start", "c0", "c1"])
            for s in sums:
                s.clear()
            return out

        for batch in batches:
            for t, toxic in zip(*column_arrays(batch, "text", "toxic"), strict=True):
                sums[toxic].update(starts(t) | {""})  # the empty beginning counts the texts
                if len(sums[0]) + len(sums[1]) > COUNTED:
                    yield flush()
        yield flush()

    counts = map_batches(learned.select("text", "toxic"), count, "start string, c0 long, c1 long")
    counts = materialize(counts.groupBy("start").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")), "starts")
    every = counts.filter("start = ''").first()
    if every is None or not every["c0"] or not every["c1"]:
        return None
    texts = {0: every["c0"], 1: every["c1"]}
    top = counts.filter("start <> '' and c0 >= 2").orderBy(F.desc(F.col("c0") * F.length("start")), "start").limit(COMMON).collect()
    common = [r["start"] for r in top][::-1]
    able = {}
    for own, other in ((1, 0), (0, 1)):
        c, d = F.col(f"c{own}"), F.col(f"c{other}")
        known = counts.filter((c >= 2) & (F.col("start") != ""))
        strict = math.log(max(1, known.count())) + 1  # as many beginnings are tried
        told = _evidence(c, d, texts[own] / (texts[own] + texts[other]))
        rows = known.filter((c / texts[own] > 6 * (d + 0.5) / texts[other]) & (told > strict))
        able[own] = {r["start"]: (r[f"c{own}"], r[f"c{other}"]) for r in rows.orderBy(F.desc(told), "start").limit(MAX_STARTS).collect()}

    def incidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, toxic, chance = column_arrays(batch, "text", "toxic", "chance")
            have = [sorted(starts(t) & able[k].keys()) for t, k in zip(texts, toxic, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(chance, pa.float64()), pa.array(have, pa.list_(pa.string()))], names=["toxic", "chance", "have"])

    rows = map_batches(learned, incidence, "toxic int, chance double, have array<string>").filter("size(have) > 0")
    rows = rows.orderBy("chance", "have").limit(2 * MAX_DOCUMENTS).collect()
    chosen = {}
    for own, other in ((1, 0), (0, 1)):
        sets = [set(r["have"]) for r in rows if r["toxic"] == own]
        sets += [set()] * (texts[own] - len(sets))
        ours, theirs = ({x: c[k] for x, c in able[own].items()} for k in (0, 1))
        chosen[own] = segments(sets, ours, theirs, texts[other])
    contents = []
    for own, other in ((1, 0), (0, 1)):
        # what the other class's segments have in common with this class's words is in both dictionaries
        parts = {x[:k] for x in chosen[other] for k in range(SHORTEST, len(x))}
        usual = counts.filter(F.col("start").isin(sorted(parts)) & (F.col(f"c{own}") > USUAL * texts[own])).select("start").collect() if parts else []
        usual = {r["start"] for r in usual}
        shared = [next((x[:k] for k in range(len(x) - 1, SHORTEST - 1, -1) if x[:k] in usual), x[: SHORTEST - 1]) for x in chosen[other]]
        contents.append(dictionary([*chosen[own], *dict.fromkeys(shared)], common))
    toxic, ordinary = contents

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(toxic, ordinary)
        for batch in batches:
            texts, label, chance = column_arrays(batch, "text", "toxic", "chance")
            found = [np.bincount(np.clip(meter.windows(t), -1, 63).astype(int) + 1, minlength=65).tolist() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(chance, pa.float64()), pa.array(found, pa.list_(pa.int64()))], names=["toxic", "chance", "counts"])

    rows = map_batches(sample.filter("chance >= 0.6"), measure, "toxic int, chance double, counts array<long>")
    rows = rows.orderBy("chance", "counts").limit(2 * MAX_DOCUMENTS).toPandas()
    y = rows["toxic"].to_numpy(float)
    if not (y == 1).any() or not (y == 0).any():
        return None
    distances = [np.repeat(np.arange(-1, 64), c).astype(float) for c in rows["counts"]]
    share = labels.filter(learn).agg(F.avg((F.col(label) == 1).cast("double"))).first()[0]
    return Model(toxic, ordinary, *calibrate(distances, y, float(np.clip(share, 0.001, 0.999))))


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """(row, score, predicted) of every document; ``row`` holds the columns of ``docs``. A narrow map."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_of(text).alias("text"))
    kind = rows.schema["row"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(model.toxic, model.ordinary) if model else None
        for batch in batches:
            (texts,) = column_arrays(batch, "text")
            if model is None:
                s = np.zeros(len(texts))
            else:
                z = np.array([summary(np.clip(meter.windows(t), -1, 63), model.least) @ model.weights for t in texts], float)
                s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["row", "score", "predicted"])

    return map_batches(rows, run, T.StructType([T.StructField("row", kind), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
