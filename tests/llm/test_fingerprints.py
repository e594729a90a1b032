import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import fingerprints as P
from tests.llm.helpers import ODD, empty, odd


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40).map(lambda t: t.replace("\n", "")), min_size=1, max_size=6), st.randoms())
def test_order_does_not_matter_and_paragraphs_come_and_go(paragraphs, rng):
    whole = P.of_paragraphs("\n".join(paragraphs))
    other = list(paragraphs)
    rng.shuffle(other)
    assert P.of_paragraphs("\n".join(other)).text() == whole.text()
    built = P.empty()
    for p in paragraphs:
        built = P.insert(built, p)
    assert built.text() == whole.text()
    assert P.delete(P.insert(whole, "more"), "more").text() == whole.text()
    assert P.insert(whole, paragraphs[0]).text() != whole.text()


def test_long_texts_go_in_chunks():
    text = "".join(random.Random(1).choices("abcdefgh \n", k=P._CHUNK + 5000))
    whole = P.of_paragraphs(text)
    cut = text.index("\n", 1000)
    assert (P.of_paragraphs(text[:cut]) + P.of_paragraphs(text[cut + 1 :])).text() == whole.text()


def test_likeness():
    a = P.of_paragraphs("the quick brown fox jumps over the lazy dog\nand goes home")
    assert P.likeness(a, a) == 1.0
    assert P.likeness(a, P.of_paragraphs("the quick brown fox jumps over the lazy cat\nand goes home")) > 0.6
    assert P.likeness(a, P.of_paragraphs("entirely other words are written in this text here")) < 0.3


def test_likeness_of_long_repetitive_texts(spark):
    long, longer = "word " * 32_700, "word " * 32_900
    assert P.likeness(P.of_paragraphs(long), P.of_paragraphs(longer)) > 0.99
    docs = spark.createDataFrame([(1, "word " * 40_000), (2, "entirely other words are written in this text here " * 4000)], "doc_id long, text string")
    near = {r["doc_id"]: r["near_edited"] for r in P.edit_likeness(docs).collect()}
    assert near[1] > 0.8


def _check(rows, data):
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest()))
    want = []
    for k, (i, t, *_) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), P.of_paragraphs(t).text(), P.of_paragraphs(edited).text()))
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)


def test_every_row_meets_its_successor(spark):
    _check(P.edit_likeness(odd(spark)).collect(), ODD)
    some = [(i * 7 % 101, f"text {i} " * (i % 9), "s", "x") for i in range(101)]
    _check(P.edit_likeness(spark.createDataFrame(some, "doc_id long, text string, source string, extra string").repartition(5)).collect(), some)


def test_small_tables(spark):
    assert P.edit_likeness(empty(spark)).count() == 0
    _check(P.edit_likeness(odd(spark).filter("doc_id = 5")).collect(), [ODD[4]])
    nulls = odd(spark).filter("doc_id is null")
    _check(P.edit_likeness(nulls).collect(), [r for r in ODD if r[0] is None])


def test_plain_column(spark):
    rows = P.fingerprint(odd(spark).withColumnRenamed("extra", "fingerprint"))
    assert rows.columns == ["doc_id", "text", "source", "fingerprint"] and rows.count() == len(ODD)


def _plain(text):
    """Both groups of lanes written out: 8 sums of digests modulo 2**64, 256 signed gram counts."""
    equal, grams = [0] * 8, [0] * 512
    step, mask = 0xD1342543DE82EF95, (1 << 64) - 1

    def mixed(points):
        h = 0
        for c in points:
            h = (h * step + c) & mask
        return (((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & mask) >> 55

    for paragraph in text.split("\n"):
        raw = hashlib.blake2b(paragraph.encode()).digest()
        words = [int.from_bytes(raw[8 * k : 8 * k + 8], "little") for k in range(8)]
        equal = [(a + b) & mask for a, b in zip(equal, words, strict=True)]
        points = [ord(c) for c in paragraph]
        for at in [mixed(points[i : i + 12]) for i in range(len(points) - 11)] or [words[0] >> 55]:
            grams[at] += 1
    return equal, [a - b for a, b in zip(grams[:256], grams[256:], strict=True)]


@pytest.mark.parametrize("text", ["", "a", "short\n\nlines\n", "one longer paragraph of text, ☕ and 𝒳\nand another one of them", "word " * 500])
def test_lanes_are_brute_force(text):
    state = P.of_paragraphs(text)
    equal, grams = _plain(text)
    assert state.equal.tolist() == equal and state.grams.astype(np.int32).tolist() == grams


def test_likeness_is_the_cosine_of_the_lanes():
    a, b = "the stone by the river is grey and old\nand wet", "the stone by the river is grey and cold\nand dry"
    x, y = (np.array(_plain(t)[1], float) for t in (a, b))
    want = x @ y / np.sqrt((x @ x) * (y @ y))
    got = P.likeness(P.of_paragraphs(a), P.of_paragraphs(b))
    assert got == pytest.approx(max(want, 0.0)) and 0.3 < got < 1
    assert P.likeness(P.of_paragraphs("p one\np two"), P.of_paragraphs("p two\np one")) == 1.0
