"""Phrase collocation mining: suffix arrays of word ids per shard, merged counts, and the lowest cut's association score.

Every task turns its texts into shards of some million word ids, one stream per language with a mark between pieces,
and sorts the suffixes of each stream by prefix doubling in numpy. Neighbouring suffixes that share their first ``d``
words form an interval of the LCP array; its length is the shard's count of that ``d``-gram. Only (language, length,
phrase, count) leaves a shard, and one aggregation by key makes the counts global.

A phrase is no more frequent than the phrases inside it, so longer ones are counted only where both phrases one word
shorter may be frequent: words and pairs are counted first, and the next pass asks a Bloom filter of the frequent shorter
phrases. The filter has no false negatives, is sized by the number of its entries up to :data:`FILTER_BITS`, and beyond
that lets more rows through to the aggregation; counts and results do not depend on it.

Defined cases: null and empty texts have no words; a null language is ``und``; texts of any length are read in blocks and
cut into shards that overlap by the words that a phrase can reach over; repeated rows count as often as they stand there;
further columns are not read; an empty table has no phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import map_batches, text_of
from lodestar.sources.workspace import materialize

#: Words of a shard, bytes of a block of text, and the largest filter: 8 MB.
SHARD_WORDS, BLOCK, FILTER_BITS = 1_500_000, 1 << 20, 1 << 26
#: A piece ends at these characters; tabs are spaces and A-Z are lower-cased. UTF-8 has no ASCII byte inside a character.
_TABLE = bytes(ord("\n") if chr(i) in ".,;:!?\n\x0b\x0c\r" else 32 if i == 9 else i + 32 if 65 <= i <= 90 else i for i in range(256))
_ROWS = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("count", pa.int64())])


class _Ids(dict):
    """Word ids from 1 in order of appearance; 0 is the mark between pieces."""

    def __init__(self) -> None:
        super().__init__({b"\n": 0, b"": -1})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) - 1
        return n


def _blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text and the marks between its pieces, block by block; empty strings are no words."""
    text = text.translate(_TABLE)
    at = 0
    while at < len(text):
        end = at + BLOCK
        if end < len(text):  # back to a space or mark, or on to the next one
            end = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end)) + 1 or min((p for p in (text.find(b" ", at), text.find(b"\n", at)) if p >= 0), default=len(text)) + 1
        yield text[at:end].replace(b"\n", b" \n ").split(b" ")
        at = end


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their next ``depth`` ids or more, by prefix doubling; what lies past the end comes first."""
    _, rank = np.unique(ids, return_inverse=True)
    rank, reach = rank.astype(np.int64) + 1, 1
    order = np.argsort(rank)
    while reach < depth:
        after = np.zeros(len(rank), np.int64)
        after[:-reach] = rank[reach:]
        key = rank * (int(rank.max()) + 1) + after
        order = np.argsort(key)
        key = key[order]
        rank[order] = np.cumsum(np.diff(key, prepend=key[0]) != 0) + 1
        reach *= 2
    return order


def intervals(ids: np.ndarray, size: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position and length of every LCP interval of depth ``size`` whose words hold no mark (id 0)."""
    order = order[order + size <= len(ids)]
    if not len(order):
        return order, order
    same, marked = np.ones(len(order) - 1, bool), np.zeros(len(order), bool)
    for k in range(size):
        word = ids[order + k]
        same &= word[1:] == word[:-1]
        marked |= word == 0
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    count = np.diff(np.append(first, len(order)))
    use = ~marked[first]
    return order[first[use]], count[use]


def _phrases(words: pa.Array, ids: np.ndarray, first: np.ndarray, size: int) -> pa.Array:
    parts = [words.take(pa.array(ids[first + k])) for k in range(size)]
    return pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())) if size > 1 else parts[0]


def _hashes(lang: str, phrases: pa.Array) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    parts = (phrases.slice(at, 50_000).to_pylist() for at in range(0, len(phrases), 50_000))
    return np.fromiter((xxhash.xxh64_intdigest(p, seed) for part in parts for p in part), np.uint64, len(phrases))


def _spots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a hash in a filter of ``bits`` bits, a power of two."""
    return h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)


def _shard(lang: str, words: pa.Array, ids: np.ndarray, counted: int, sizes: tuple[int, ...], known: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases that begin in the first ``counted`` positions; ``known``: the filter of phrases one word shorter."""
    every = suffix_array(ids, max(sizes))
    order = every[every < counted]
    for size in sizes:
        first, count = intervals(ids, size, order)
        if known is not None and len(first):
            shorter, _ = intervals(ids, size - 1, every)
            a, b = _spots(_hashes(lang, _phrases(words, ids, shorter, size - 1)), len(known) * 8)
            hit = (known[a >> np.uint64(3)] >> (a & np.uint64(7)).astype(np.uint8)) & (known[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & 1
            may = _spread(ids, size - 1, every, shorter, hit.astype(bool))
            use = may[first] & may[first + 1]
            first, count = first[use], count[use]
        for at in range(0, len(first), 100_000):
            part = first[at : at + 100_000]
            phrase = _phrases(words, ids, part, size).cast(pa.string())
            yield pa.record_batch([pa.array([lang] * len(part), pa.string()), pa.array(np.full(len(part), size, np.int32)), phrase, pa.array(count[at : at + 100_000].astype(np.int64))], schema=_ROWS)


def _spread(ids: np.ndarray, size: int, order: np.ndarray, first: np.ndarray, flag: np.ndarray) -> np.ndarray:
    """A flag of every position: that of the interval of depth ``size`` in which it lies; False across a mark."""
    order = order[order + size <= len(ids)]
    same = np.ones(len(order) - 1, bool)
    for k in range(size):
        word = ids[order + k]
        same &= word[1:] == word[:-1]
    number = np.cumsum(np.concatenate([[0], ~same]))  # of intervals, marked ones included
    own = np.zeros(int(number[-1]) + 1, bool)
    place = np.empty(len(ids), np.int64)
    place[order] = number
    own[place[first]] = flag
    out = np.zeros(len(ids), bool)
    out[order] = own[number]
    return out


def _counter(sizes: tuple[int, ...], known: np.ndarray | None, total: bool, shard_words: int):
    longest = max(sizes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams: dict[str, tuple[_Ids, list[np.ndarray]]] = {}
        held = 0

        def flush(rest: int = 0) -> Iterator[pa.RecordBatch]:
            """Give out the shard; ``rest``: words at the end of the one open stream that begin no phrase yet."""
            for lang, (known_ids, parts) in streams.items():
                ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
                counted = max(0, len(ids) - rest)
                if not counted:
                    continue
                if total and (n := int(np.count_nonzero(ids[:counted]))):
                    yield pa.record_batch([pa.array([lang]), pa.array([0], pa.int32()), pa.array([""]), pa.array([n])], schema=_ROWS)
                words = pa.array([b"\n", *(w for w, i in known_ids.items() if i > 0)], pa.binary())
                yield from _shard(lang, words, ids, counted, sizes, known)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                for block in _blocks(text):
                    if held >= shard_words:  # inside a text: its last words come again in the next shard
                        if lang in streams:
                            names, parts = streams.pop(lang)
                            yield from flush()
                            streams = {lang: (names, parts)}
                            yield from flush(longest - 1)
                            back = {i: w for w, i in names.items()}
                            tail = [back[i] for i in np.concatenate(parts)[-(longest - 1) :].tolist()] if longest > 1 else []
                            own = _Ids()
                            streams = {lang: (own, [np.fromiter(map(own.__getitem__, tail), np.int64, len(tail))])}
                        else:
                            yield from flush()
                            streams = {}
                        held = 0
                    own, parts = streams.setdefault(lang, (_Ids(), []))
                    ids = np.fromiter(map(own.__getitem__, block), np.int64, len(block))
                    parts.append(ids[ids >= 0])
                    held += len(parts[-1])
                if lang in streams:
                    streams[lang][1].append(np.zeros(1, np.int64))  # texts do not touch
        yield from flush()

    return count


def _counts(docs: DataFrame, sizes: tuple[int, ...], least: int, known: np.ndarray | None, total: bool, shard_words: int) -> DataFrame:
    rows = map_batches(docs, _counter(sizes, known, total, shard_words), "lang string, size int, phrase string, count long")
    merged = rows.groupBy("lang", "size", "phrase").agg(F.sum("count").alias("f"))
    return materialize(merged.filter((F.col("f") >= least) | (F.col("size") == 0)), "phrases")


def _filter(frequent: DataFrame, most_bits: int) -> np.ndarray:
    """A Bloom filter of (lang, phrase) as bytes, with some sixteen bits an entry up to ``most_bits``."""
    bits = min(most_bits, max(1 << 16, 1 << (16 * frequent.count()).bit_length()))

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, phrases = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).cast(pa.binary())
            for lang in set(langs):
                for spot in _spots(_hashes(lang, phrases.filter(pa.array(langs == lang))), bits):
                    yield pa.record_batch([pa.array((spot >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (spot & np.uint64(63))).view(np.int64))], names=["word", "bit"])

    words = map_batches(frequent.select("lang", "phrase"), spots, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)  # at most FILTER_BITS / 64 rows reach the driver
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def phrase_counts(docs: DataFrame, most_words: int = 3, least: int = 10, lang: str = "lang", text: str = "text", shard_words: int = SHARD_WORDS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, size, phrase, f) of all phrases of up to ``most_words`` words that occur ``least`` times in their language,
    and with size 0 the number of the language's words."""
    docs = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), text_of(text).alias("text")).filter("text <> ''")
    found = [_counts(docs, tuple(range(1, min(2, most_words) + 1)), least, None, True, shard_words)]
    for size in range(3, most_words + 1):
        known = _filter(found[-1].filter(F.col("size") == size - 1), filter_bits)
        found.append(_counts(docs, (size,), least, known, False, shard_words))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(19,0)")


def collocations(counts: DataFrame, top: int = 2000, share: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases of two words and more, from :func:`phrase_counts`.

    A phrase's score is that of its weakest cut. A phrase inside a longer one that has ``share`` per cent of its
    occurrences or more is left out. Decimals keep the arithmetic exact.
    """
    names = counts.filter("size > 0").select("lang", "phrase", "f")
    parts = F.split("phrase", " ")
    several = counts.filter("size > 1").select("lang", "phrase", F.col("f").alias("a"), "size")
    cuts = several.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"left": F.array_join(F.slice(parts, F.lit(1), F.col("k")), " "), "right": F.array_join(F.slice(parts, F.col("k") + 1, F.col("size") - F.col("k")), " ")})
    cuts = cuts.join(names.toDF("lang", "left", "l"), ["lang", "left"]).join(names.toDF("lang", "right", "r"), ["lang", "right"])
    whole = F.lit(1_000_000).cast("decimal(7,0)") * (_exact("a") * _exact("a"))
    cuts = cuts.withColumns({"top": whole, "bottom": _exact("l") * _exact("r")}).withColumn("score", F.expr("top div bottom"))
    scored = cuts.groupBy("lang", "phrase", "a", "size").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    inner = several.filter("size > 2").withColumn("n", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1)))
    inside = inner.groupBy("lang", F.array_join(F.slice(parts, F.col("at"), F.col("n")), " ").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").filter("longer is null or 100 * longer < %d * a" % share)
    order = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    words = counts.filter("size = 0").select("lang", F.col("f").alias("n"))
    out = best.join(words, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "c.l", "c.r", "n", F.col("c.score").cast("long").alias("score"))
