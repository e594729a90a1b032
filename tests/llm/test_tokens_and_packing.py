import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lodestar.llm import packing, tokens
from lodestar.sources.workspace import new_path
from tests.llm.helpers import ODD, empty, odd


SPECIAL = ["<|endoftext|>", "a<|endoftext|>b", " <|endoftext|> \n<|endoftext|><|endoftext|>x", "<|endoftext|", "<|other|>", "don't<|endoftext|>  two"]


def _published():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_those_of_the_json_vocabulary():
    texts = [r[1] or "" for r in ODD if len(r[1] or "") < 10_000] + ["  two  spaces\n\n tab\t", "日本語 текст ñandú 👍🏽", "don't we'll I'M"] + SPECIAL
    for text, e in zip(texts, _published().encode_batch(texts, add_special_tokens=False), strict=True):
        assert tokens.encode(text, special=True).tolist() == e.ids
    assert tokens.encode("a<|endoftext|>b", special=True).tolist() == [64, 50256, 65]
    ordinary = _published()
    ordinary.encode_special_tokens = True
    for text, e in zip(texts, ordinary.encode_batch(texts, add_special_tokens=False), strict=True):
        assert tokens.encode(text).tolist() == e.ids and tokens.END not in e.ids


def test_ids_of_all_documents(spark):
    rows = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for text, e in zip(rows, _published().encode_batch(rows, add_special_tokens=False), strict=True):
        assert tokens.encode(text, special=True).tolist() == e.ids


def test_special_strings_are_packed_as_the_published_ids_and_counted_as_text(spark):
    data = [(k, t, "s", "x") for k, t in enumerate(SPECIAL)]
    docs = spark.createDataFrame(data, "doc_id long, text string, length string, sequence_id string")
    got = {r["doc_id"]: r for r in packing.pack(docs).collect()}
    for k, e in enumerate(_published().encode_batch(SPECIAL, add_special_tokens=False)):
        raw = np.array([*e.ids, 1], "<u4").tobytes()
        assert (got[k]["length"], got[k]["ids_crc32"]) == (len(e.ids) + 1, zlib.crc32(raw))
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(docs.withColumn("file", docs.length)).collect()}
    assert counts == {k: len(tokens.encode(t)) for k, t in enumerate(SPECIAL)}


def test_differencing_balances():
    rng = random.Random(2)
    for _ in range(30):
        sizes = [rng.randint(1, 512) for _ in range(rng.randint(1, 120))]
        where = packing.divide(sizes, 2048)
        sums = np.bincount(where, weights=sizes)
        assert len(where) == len(sizes) and sums.max() <= 2048
        if len(sizes) > 40:
            assert sums.max() - sums.min() < 300
    assert sorted(np.bincount(packing.difference([8, 7, 6, 5, 4], 2), weights=[8, 7, 6, 5, 4])) == [14, 16]  # the known result
    assert sorted(packing.divide([2048, 2048, 1]).tolist()) == [0, 1, 2]
    assert packing.divide([]).tolist() == []


def _whole(rows, data):
    """Every id of every document in one piece, windows gapless and within capacity."""
    want = defaultdict(int)
    for i, t, *_ in data:
        want[i] += len(tokens.encode(t or "")) + 1
    got, windows = defaultdict(int), defaultdict(list)
    for r in rows:
        got[r["doc_id"]] += r["length"]
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    return windows


def test_packing(spark):
    rows = packing.pack(odd(spark)).collect()
    _whole(rows, ODD)
    for i, t, *_ in ODD:
        if i in (8, 9):
            ids = np.append(tokens.encode(t), 1).astype("<u4")
            for r in (r for r in rows if r["doc_id"] == i):
                assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids)
    assert packing.pack(empty(spark)).count() == 0


def test_little_padding(spark):
    rng = random.Random(4)
    data = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(1, 900))), "s", "x") for i in range(3000)]
    rows = packing.pack(spark.createDataFrame(data, "doc_id long, text string, source string, extra string").coalesce(1)).collect()
    windows = _whole(rows, data)
    used = sum(length for p in windows.values() for _, length in p)
    assert 1 - used / (2048 * len(windows)) < 0.03


@pytest.mark.parametrize("block", [2, 6, tokens.BLOCK])
def test_separators_across_blocks(spark, block):
    data = [r for r in ODD if r[1] is None or len(r[1]) < 60 or block == tokens.BLOCK]
    path = new_path(spark, "tok")
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, extra string").repartition(3)
    written = tokens.write_token_files(docs, path).cache()
    found = tokens.scan_token_files(written.select("file", "bytes").distinct(), path, block=block)
    rows = written.join(found, ["file", "ordinal"]).select("doc_id", "n_tokens").collect()
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in rows), key=repr) == sorted(((i, len(tokens.encode(t or ""))) for i, t, *_ in data), key=repr)


def test_token_counts(spark):
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in tokens.count_tokens(odd(spark)).collect()), key=repr)
    assert got == sorted(((i, len(tokens.encode(t or ""))) for i, t, *_ in ODD), key=repr)
    assert tokens.count_tokens(empty(spark)).count() == 0
