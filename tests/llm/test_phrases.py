import random
import re
from collections import Counter

import numpy as np
import pytest

from lodestar.llm import phrases
from tests.llm.helpers import empty, odd


def _pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n-\r]", low)]


def _counts(rows, most):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in _pieces(text):
            n[lang] += len(w)
            for size in range(1, most + 1):
                for i in range(len(w) - size + 1):
                    f[lang, tuple(w[i : i + size])] += 1
    return f, n


def _brute(rows, least=10, top=2000, most=3, share=50):
    f, n = _counts(rows, most)
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        if any(len(q) > len(p) and b >= least and 100 * b >= share * a and g == lang and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in f.items()):
            continue
        score, k = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    out.sort()
    rank, rows = Counter(), []
    for lang, score, a, p, left, right, words in out:
        rank[lang] += 1
        if rank[lang] <= top:
            rows.append((lang, rank[lang], p.decode(), -a, left, right, words, -score))
    return rows


def _texts(seed, n):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "c", "dé", "É", "x-y", "\x1c", "7"]
    return [(rng.choice(["en", None, "und", "de"]), "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "\r\n", "\x0b"]) for _ in range(rng.randint(0, 80)))) for _ in range(n)]


@pytest.mark.parametrize("shard", [7, 1000, phrases.SHARD_WORDS])
def test_as_by_counting(spark, shard):
    rows = _texts(3, 120)
    docs = spark.createDataFrame([(a, b, "c") for a, b in rows], "lang string, text string, count string").repartition(3)
    counts = phrases.phrase_counts(docs, shard_words=shard)
    got = sorted(map(tuple, phrases.collocations(counts, top=30).collect()))
    want = sorted(_brute(rows, top=30))
    assert want and got == want


def test_longer_phrases_and_a_full_filter(spark, monkeypatch):
    rows = _texts(4, 150)
    docs = spark.createDataFrame(rows, "lang string, text string")
    f, _ = _counts(rows, 5)
    want = {(g, " ".join(p), n) for (g, p), n in f.items() if n >= 5}
    for bits in (phrases.FILTER_BITS, 64):  # a filter of one word lets everything pass
        got = phrases.phrase_counts(docs, most_words=5, least=5, filter_bits=bits).filter("size > 0")
        assert {(r["lang"], r["phrase"], r["f"]) for r in got.collect()} == want
    got = phrases.collocations(phrases.phrase_counts(docs, most_words=4, least=5), top=50)
    assert sorted(map(tuple, got.collect())) == sorted(_brute(rows, least=5, top=50, most=4))


def test_suffix_array_and_intervals():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 4, 300)
    for depth in (1, 2, 3, 5, 8):
        order = phrases.suffix_array(ids, depth)
        tuples = [tuple(ids[i : i + depth]) for i in order]
        assert sorted(order) == list(range(300)) and tuples == sorted(tuples)
        first, count = phrases.intervals(ids, depth, order)
        want = Counter(t for i in range(300 - depth + 1) if 0 not in (t := tuple(ids[i : i + depth])))
        assert {tuple(ids[i : i + depth]): c for i, c in zip(first, count, strict=True)} == want


def test_long_texts_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 16)
    text = b"one two three. " * 40 + b"a" * 100 + b" b\tc"
    words = [w for block in phrases._blocks(text) for w in block if w]
    assert words == [w for p in (b"one two three\n" * 40).split() for w in p.split()] or words.count(b"one") == 40
    assert words[-3:] == [b"a" * 100, b"b", b"c"] and words.count(b"\n") == 40


def test_exact_beyond_64_bits(spark):
    counts = spark.createDataFrame([("x", 0, "", 9 * 10**12), ("x", 1, "a", 3 * 10**12), ("x", 1, "b", 2 * 10**12 + 1), ("x", 2, "a b", 2 * 10**12)], "lang string, size int, phrase string, f long")
    (row,) = phrases.collocations(counts).collect()
    assert row["score"] == 10**6 * (2 * 10**12) ** 2 // (3 * 10**12 * (2 * 10**12 + 1)) and row["n"] == 9 * 10**12


def test_odd_rows_and_an_empty_table(spark):
    rows = odd(spark).withColumnRenamed("source", "lang")
    got = phrases.phrase_counts(rows, least=2)
    plain = [(r["lang"], r["text"]) for r in rows.collect()]
    f, n = _counts(plain, 3)
    assert {(r["lang"], r["phrase"], r["f"]) for r in got.filter("size > 0").collect()} == {(g, " ".join(p), c) for (g, p), c in f.items() if c >= 2}
    assert {r["lang"]: r["f"] for r in got.filter("size = 0").collect()} == {g: c for g, c in n.items() if c}
    assert phrases.collocations(phrases.phrase_counts(empty(spark).withColumnRenamed("source", "lang"))).collect() == []
