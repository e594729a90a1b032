"""Cross-tokenizer alignment: groups of tokens of two encodings of one text, links of overlapping tokens, and their counts.

:func:`align` is the relational form, for token tables of any tokenizers: positions exploded, ends as windowed cumulative
lengths, an equi-join on document and end, running counts of common ends as group ids. Every row of the full outer
join is a stretch of bytes between two neighbouring ends, so it lies in one token of either side: the rows are the links,
and no join within groups is needed, however long a group.

:func:`digests` gives the corpus query's rows by the same steps on arrays, since two rows for every token of a corpus
move and sort some twenty times its bytes. Both encodings always end a token where white space begins, provided that no
token of the vocabulary reaches over such a place (looked up in the vocabulary, not assumed). So a text is cut there,
and each distinct stretch of a *part* (a bounded run of a task's documents) is encoded and aligned once: cumulative
lengths, equal ends, groups, links. A document's groups and links are those of its stretches in order. What concerns
the whole corpus is relational: documents per linked id pair are summed over parts, joined back to the parts' pairs, and
the parts' documents take their sums. Only distinct pairs of parts are joined, never links.

Defined cases: null and empty texts, and texts whose bytes an encoding does not give back (U+2581 in a text, say), have no
tokens: zeros and an empty digest; special tokens' strings are plain text; texts without white space are one stretch;
repeated rows are documents each, null ids too; further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import column_arrays, map_batches, text_of
from lodestar.llm.tokens import VOCABULARY, encoder
from lodestar.sources.workspace import materialize, share_code

PIECES = "piece_bpe_32k.model"
#: Bounds of a part: stretches in order, distinct stretches, distinct pairs of ids.
PART_STRETCHES, PART_DISTINCT, PART_PAIRS = 4_000_000, 400_000, 500_000
_DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_ROWS = f"part long, kind int, {_DIGEST}, pairs array<int>, times array<int>, pair int, a int, b int, docs long"


class Pair:
    """The two encodings, their tokens' bytes, and where a text may be cut."""

    def __init__(self, ranks: str, model: str) -> None:
        import public_tokenizers
        import sentencepiece

        self.a = encoder(ranks)
        self.a_bytes = {i: b for b, i in self.a._mergeable_ranks.items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=model if "/" in model else public_tokenizers.path(model))
        self.b_bytes, pieces = [], []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.b_bytes.append(bytes([int(piece[3:-1], 16)]))
            else:
                self.b_bytes.append(piece.replace("▁", " ").encode())
                pieces.append(piece)
        self.a_lengths, self.b_lengths = np.array([len(self.a_bytes.get(i, b"")) for i in range(max(self.a_bytes) + 1)]), np.array([len(b) for b in self.b_bytes])
        names = lambda n, end: np.array([f"{i}{end}" for i in range(n)], object)
        (self.a_more, self.a_last), (self.b_more, self.b_last) = ((names(len(n), ","), names(len(n), e)) for n, e in ((self.a_lengths, "|"), (self.b_lengths, ";")))
        # a cut before a space or line end is safe if no piece holds one after another character
        marks = [c for c, s in ((" ", "▁"), ("\n", "\n")) if not any(re.search(f"[^{s}]{s}", p) for p in pieces)]
        self.lead = self.b.piece_to_id("▁")
        if any(p.startswith("▁\n") for p in pieces):
            marks = [c for c in marks if c != "\n"]
        self.cut = re.compile(rf"(?<=\S)(?=[{''.join(marks)}])") if marks else None

    def stretches(self, text: str) -> list[str]:
        """Space and text, cut where white space begins."""
        return self.cut.split(" " + text) if self.cut else [" " + text]

    def encode(self, stretches: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All stretches' ids of both encodings and their numbers, and which stretches both give back; the others get none."""
        x = [self.a.encode_ordinary(s) for s in stretches]
        y = self.b.encode([s[1:] if s[0] == " " else s for s in stretches], num_threads=1)
        for k, s in enumerate(stretches):
            if s[0] != " ":  # the space that the encoding adds before any text
                y[k] = y[k][1:] if y[k] and y[k][0] == self.lead else []
            elif s == " ":
                y[k] = [self.lead]
        raw = [s.encode() for s in stretches]
        whole, sizes, fine = b"".join(raw), np.fromiter(map(len, raw), np.int64, len(raw)), np.ones(len(raw), bool)
        for ids, tokens, lengths in ((x, self.a_bytes, self.a_lengths), (y, self.b_bytes, self.b_lengths)):
            flat, n = _flat(ids)
            given = np.bincount(np.repeat(np.arange(len(ids)), n), lengths[flat], len(ids))
            if (given != sizes).any() or b"".join(map(tokens.__getitem__, flat.tolist())) != whole:
                fine &= np.array([b"".join([tokens[i] for i in part]) == r for part, r in zip(ids, raw, strict=True)])
        for k in np.flatnonzero(~fine):
            x[k], y[k] = [], []
        return *_flat(x), *_flat(y), fine


def _flat(ids: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences as one array, and their lengths."""
    return np.array(list(chain.from_iterable(ids)), np.int64), np.fromiter(map(len, ids), np.int64, len(ids))


@functools.cache
def tokenizers(ranks: str = VOCABULARY, model: str = PIECES) -> Pair:
    return Pair(ranks, model)


def links(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two sequences of byte lengths that add up to the same: the tokens of each link on both sides, and the ends of the
    tokens. Between two neighbouring ends lie bytes of one token of either side, and each overlap holds one such stretch."""
    a, b = np.cumsum(x), np.cumsum(y)
    ends = np.union1d(a, b)
    return np.searchsorted(a, ends), np.searchsorted(b, ends), a, b


class _Part:
    """Distinct stretches of a run of documents: counts, group texts and linked pairs as one flat list."""

    def __init__(self, pair: Pair) -> None:
        self.pair, self.known, self.numbers = pair, {}, {}
        self.fine, self.counts = [np.zeros(0, bool)], [np.zeros((0, 4), np.int64)]
        self.groups: list[str] = []
        self.flat, self.sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        self.docs = np.zeros(0, np.int64)
        self.seen = 0

    def full(self) -> bool:
        return self.seen > PART_STRETCHES or len(self.known) > PART_DISTINCT or len(self.numbers) > PART_PAIRS

    def _add(self, new: list[str]) -> None:
        """Encode and align new stretches at once: their ends on the joined bytes are ends of both sides."""
        pair = self.pair
        x, nx, y, ny, fine = pair.encode(new)
        self.known.update(zip(new, range(len(self.groups), len(self.groups) + len(new)), strict=True))
        i, j, a, b = links(pair.a_lengths[x], pair.b_lengths[y])
        key, place = np.unique(x[i] << 32 | y[j], return_inverse=True)
        number = np.array([self.numbers.setdefault(k, len(self.numbers)) for k in key.tolist()], np.int32)
        tokens = np.cumsum(nx)
        owner = np.searchsorted(tokens, i, side="right")  # the stretch of each link
        size = np.bincount(owner, minlength=len(new))
        cut_a, cut_b = np.isin(a, b, assume_unique=True), np.isin(b, a, assume_unique=True)
        group_a, group_b = (np.cumsum(c) - c for c in (cut_a, cut_b))
        groups = np.bincount(np.searchsorted(tokens, np.flatnonzero(cut_a), side="right"), minlength=len(new))
        # the text of the groups in order: of each group the ids of one side, then of the other
        pieces = np.concatenate([np.where(cut_a, pair.a_last[x], pair.a_more[x]), np.where(cut_b, pair.b_last[y], pair.b_more[y])])
        order = np.lexsort((np.repeat([0, 1], [len(x), len(y)]), np.concatenate([group_a, group_b])))
        pieces = pieces[order].tolist()
        at = np.concatenate([[0], np.cumsum(nx + ny)]).tolist()
        self.groups += ["".join(pieces[at[k] : at[k + 1]])[:-1] for k in range(len(new))]
        self.fine.append(fine)
        self.counts.append(np.stack([nx, ny, groups, size], 1))
        self.flat.append(number[place])
        self.sizes.append(size)

    def _whole(self, name: str) -> np.ndarray:
        parts = getattr(self, name)
        if len(parts) > 1:
            setattr(self, name, parts := [np.concatenate(parts)])
        return parts[0]

    def documents(self, part: int, ids: list[int | None], texts: list[list[str]]) -> pa.RecordBatch:
        """Rows of documents, given as their stretches, with the numbers of their linked pairs and how often each is linked."""
        stretches = [s for t in texts for s in t]
        self.seen += len(stretches)
        known = self.known
        if new := [s for s in dict.fromkeys(stretches) if s not in known]:
            self._add(new)
        k = np.fromiter(map(known.__getitem__, stretches), np.int64, len(stretches))
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        bad = np.unique(row[~self._whole("fine")[k]])  # a stretch that is not given back spoils its text
        if len(bad):
            use = ~np.isin(row, bad)
            row, k = row[use], k[use]
        length = np.bincount(row, minlength=len(texts))
        until = np.cumsum(length)
        held, groups = k.tolist(), self.groups
        sha = [hashlib.sha256(";".join([groups[s] for s in held[e - n : e]]).encode()).hexdigest() if n else "" for e, n in zip(until.tolist(), length.tolist(), strict=True)]
        counts = self._whole("counts")
        sums = np.stack([np.bincount(row, counts[k, c], len(texts)).astype(np.int64) for c in range(4)], 1)
        # each document's distinct stretches with their frequencies, then their pairs
        key, times = np.unique(row << 32 | k, return_counts=True)
        row, k = key >> 32, key & 0xFFFFFFFF
        size = self._whole("sizes")
        starts = (np.cumsum(size) - size)[k]
        size = size[k]
        at = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
        linked = self._whole("flat")[at].astype(np.int64)
        key, place = np.unique(np.repeat(row, size) << 32 | linked, return_inverse=True)
        weight = np.bincount(place, np.repeat(times, size), len(key)).astype(np.int32)
        row, pairs = key >> 32, (key & 0xFFFFFFFF).astype(np.int32)
        held = np.bincount(pairs, minlength=len(self.numbers))
        held[: len(self.docs)] += self.docs
        self.docs = held
        n = len(texts)
        offsets = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
        none = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64())]
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (pairs, weight)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), pa.array(np.zeros(n, np.int32)), pa.array(ids, pa.int64()), *[pa.array(sums[:, c]) for c in range(4)], pa.array(sha, pa.string()), *lists, *none], names=_NAMES)

    def pairs(self, part: int) -> pa.RecordBatch:
        """Rows of the part's distinct pairs and how many of its documents hold each."""
        n = len(self.docs)
        keys = np.fromiter(self.numbers, np.int64, len(self.numbers))[:n]
        a, b = (keys >> 32).astype(np.int32), (keys & 0xFFFFFFFF).astype(np.int32)
        none = [*[pa.nulls(n, t) for t in (pa.int64(), *[pa.int64()] * 4, pa.string())], *[pa.nulls(n, pa.list_(pa.int32()))] * 2]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), pa.array(np.ones(n, np.int32)), *none, pa.array(np.arange(n, dtype=np.int32)), pa.array(a), pa.array(b), pa.array(self.docs.astype(np.int64))], names=_NAMES)


_NAMES = [x.strip().split(" ")[0] for x in _ROWS.split(",")]


def _encode(ranks: str, model: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pair = tokenizers(ranks, model)
        number, part, run = TaskContext.get().partitionId() << 24, _Part(pair), ([], [], 0)
        for batch in batches:
            for doc_id, text in zip(*column_arrays(batch, "doc_id", "text"), strict=True):
                ids, order, size = run
                ids.append(doc_id)
                order.append(pair.stretches(text) if text else [])
                run = (ids, order, size + len(order[-1]))
                if run[2] > 200_000 or len(ids) >= 20_000 or part.full():
                    yield part.documents(number, ids, order)
                    run = ([], [], 0)
                    if part.full():
                        yield part.pairs(number)
                        number, part = number + 1, _Part(pair)
        if run[0]:
            yield part.documents(number, *run[:2])
        if len(part.docs):
            yield part.pairs(number)

    return encode


def _sums(_: tuple, docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """The part's documents with the sums over their links of what their pairs carry."""
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    most = max(pairs.column("pair").to_numpy(), default=-1) + 1
    count, best = np.zeros(most, np.int64), np.zeros(most, np.int64)
    place = pairs.column("pair").to_numpy()
    count[place], best[place] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy()
    lists, weights = docs.column("pairs").combine_chunks(), docs.column("times").combine_chunks()
    held, times = lists.flatten().to_numpy(), weights.flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(docs.num_rows), np.diff(lists.offsets.to_numpy()))
    for name, value in (("n_best", best), ("count_sum", count)):
        total = np.zeros(docs.num_rows, np.int64)
        np.add.at(total, row, times * value[held])
        out = out.append_column(name, pa.array(total))
    return out


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks: str = VOCABULARY, model: str = PIECES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of every document; see the module's text.

    ``n_best``: links whose pair is held by as many documents as any pair of its first id; ``count_sum``: documents that hold
    a link's pair, summed over links.
    """
    share_code(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(text).alias("text"))
    made = materialize(map_batches(rows, _encode(ranks, model), _ROWS), "aligned")
    pairs = made.filter("kind = 1").select("part", "pair", "a", "b", "docs")
    counts = materialize(pairs.groupBy("a", "b").agg(F.sum("docs").alias("count")), "pairs")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))  # at most a row for each id of the first vocabulary
    judged = counts.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    back = pairs.join(judged, ["a", "b"]).select("part", "pair", "count", "best")
    back = back.toDF(*back.columns)  # a table of its own: both sides come from one
    held = made.filter("kind = 0").drop("kind", "pair", "a", "b", "docs")
    return held.groupBy("part").cogroup(back.groupBy("part")).applyInArrow(_sums, f"{_DIGEST}, n_best long, count_sum long")


def align(tokens_a: DataFrame, tokens_b: DataFrame, key: str = "doc_id", ids: str = "ids", lengths: str = "lengths") -> DataFrame:
    """(key, end, group, a, b, a_ends, b_ends): the links of two encodings of each key's bytes, in order of ``end``.

    Both sides hold one row per key with arrays of ids and of byte lengths (of one byte or more) that add up to the same.
    ``group`` counts from the last group, as one falling window gives both the covering tokens and the running cuts.
    """

    def ends(tokens: DataFrame, name: str) -> DataFrame:
        rows = tokens.select(key, F.posexplode(F.arrays_zip(ids, lengths)).alias("pos", "t"))
        end = F.sum(F.col("t")[lengths]).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
        return rows.select(key, end.alias("end"), F.col("t")[ids].alias(name))

    both = ends(tokens_a, "a").join(ends(tokens_b, "b"), [key, "end"], "full_outer")
    falling = Window.partitionBy(key).orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    covering = lambda c: F.last(c, ignorenulls=True).over(falling)
    cut: Column = F.col("a").isNotNull() & F.col("b").isNotNull()
    return both.select(
        key, "end", F.count_if(cut).over(falling).alias("group"), covering("a").alias("a"), covering("b").alias("b"),
        F.col("a").isNotNull().alias("a_ends"), F.col("b").isNotNull().alias("b_ends"),
    )
