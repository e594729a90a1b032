"""Token files and token counts.

Texts are encoded with a published byte-level vocabulary. The ranks file of that vocabulary is read with ``tiktoken``,
which gives the ids of the JSON file under ``tokenizers`` (tests compare them) in a third of the time.

A flat token file is nothing but little-endian ids, each document followed by the end-of-document id. The counting
operator finds the documents again with the ids alone: the blocks of a file are searched by separate tasks, and the
boundaries are stitched by a prefix scan over one row per block.

Defined cases: null and empty texts are documents of no ids and one separator; very long texts are encoded whole; repeated
rows are documents each and ties need no order; an empty table gives an empty result; only the two columns named are
read, so others may have any name. In a text for a token file the string of the end-of-document token is ordinary text,
since its id must only stand between documents; elsewhere (``special=True``) it is that token, as it is by default
under ``tokenizers``.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import column_arrays, map_batches, text_of
from lodestar.sources.workspace import materialize, new_path

VOCABULARY, END = "byte_bpe_50k.tiktoken", 50256
#: Bytes of one block of a token file, and of one file before the next begins.
BLOCK, FILE = 4 << 20, 64 << 20
#: The one special token of the vocabulary.
SPECIAL = {"<|endoftext|>": END}


@functools.cache
def encoder(vocabulary: str = VOCABULARY):
    """The encoding of a ranks file, given by path or by name."""
    import public_tokenizers
    import tiktoken

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def encode(text: str, vocabulary: str = VOCABULARY, special: bool = False) -> np.ndarray:
    """Ids of a text as unsigned 32-bit integers; with ``special``, special tokens in it are such."""
    allowed = "all" if special and "<|" in text else set()
    return np.asarray(encoder(vocabulary).encode_to_numpy(text, allowed_special=allowed, disallowed_special=()), dtype="<u4")


def write_token_files(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """Write the token files of ``docs`` under ``path``; rows (file, bytes, ordinal, doc_id) say what went where.

    A task writes its own files, each under a temporary name first, so a repeated task replaces whole files.
    """
    kind = "<u2" if end < 1 << 16 else "<u4"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        number, out, ids, size, temporary = 0, None, [], 0, ""

        def close() -> pa.RecordBatch:
            nonlocal number, out, ids, size
            out.close()
            name = f"{root}/part-{context.partitionId():06d}-{number:04d}.tok"
            store.move(temporary, name)
            got = pa.RecordBatch.from_arrays(
                [pa.array([name] * len(ids), pa.string()), pa.array([size] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int64()), pa.array(ids, pa.int64())],
                names=["file", "bytes", "ordinal", "doc_id"],
            )
            number, out, ids, size = number + 1, None, [], 0
            return got

        for batch in batches:
            for i, t in zip(*column_arrays(batch, "doc_id", "text"), strict=True):
                if out is None:
                    temporary = f"{root}/_{context.taskAttemptId()}-{number}"
                    out = store.open_output_stream(temporary)
                raw = np.append(encode(t, vocabulary), end).astype(kind).tobytes()
                out.write(raw)
                size += len(raw)
                ids.append(i)
                if size >= FILE:
                    yield close()
        if out is not None:
            yield close()

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(text).alias("text"))
    return map_batches(rows, write, "file string, bytes long, ordinal long, doc_id long")


def scan_token_files(files: DataFrame, root: str, end: int = END, block: int = BLOCK) -> DataFrame:
    """Documents of flat token files, given rows (file, bytes): (file, ordinal, start, n_tokens) without separators.

    A block's task returns its separators' positions and how many there are; the running sum of the counts gives
    each block its first ordinal, and the last separator before a block is where its first document began. What
    follows a file's last separator is an unfinished document and is not counted.
    """
    width = 2 if end < 1 << 16 else 4

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for name, at, length in zip(*column_arrays(batch, "file", "at", "length"), strict=True):
                with store.open_input_file(name) as f:
                    f.seek(at)
                    ids = np.frombuffer(f.read(length), f"<u{width}")
                ends = np.flatnonzero(ids == end) + at // width
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([at], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([int(ends[-1]) if len(ends) else None], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int64()))],
                    names=["file", "at", "n", "last", "ends"],
                )

    blocks = files.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(block).cast("long"))).alias("at"))
    blocks = blocks.select("file", "at", F.least(F.lit(block).cast("long"), F.col("bytes") - F.col("at")).alias("length"))
    spread = blocks.repartition(F.col("file"), F.col("at"))
    found = materialize(map_batches(spread, search, "file string, at long, n long, last long, ends array<long>"), "separators")
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    stitched = found.select(
        "file",
        "ends",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
        F.coalesce(F.max("last").over(before), F.lit(-1)).alias("carry"),
    )
    starts = F.transform(F.concat(F.array("carry"), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0)))), lambda e: e + 1)
    pairs = stitched.select("file", "first", F.posexplode(F.arrays_zip(starts.alias("s"), F.col("ends").alias("e"))).alias("k", "x")).filter("x.e is not null")
    return pairs.select("file", (F.col("first") + F.col("k")).alias("ordinal"), F.col("x.s").alias("start"), (F.col("x.e") - F.col("x.s")).alias("n_tokens"))


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens) by way of token files in the shared folder."""
    path = new_path(docs.sparkSession, "tokens")
    written = materialize(write_token_files(docs, path, doc_id, text), "token-ids")
    counts = scan_token_files(written.select("file", "bytes").distinct(), path)
    return written.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
