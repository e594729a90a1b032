import random

import numpy as np
import pytest

from lodestar.llm import similarity as S
from lodestar.llm.common import word_hashes
from lodestar.llm.components import connected
from lodestar.sources.workspace import exists, made
from tests.llm.helpers import ODD, components, empty, odd, shingle_set, words


def test_words_are_told_apart():
    texts = ["a b  c", "A B C", "ab c", "", " \t", "x" * 3_000_000 + " y", "é É", ("word " * 300_000)]
    for t in texts:
        h, w = word_hashes(t), ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in words(t)]
        assert len(h) == len(w) and len(set(h.tolist())) == len(set(w))
    assert word_hashes("a b c").tolist() == word_hashes("A  B\nC").tolist()


def test_one_word_longer_than_a_block():
    long = "q" * (2 << 20)
    assert len(word_hashes(f"a {long} b")) == 3
    assert word_hashes(f"{long} b")[0] == word_hashes(f"a {long}")[1]


@pytest.mark.parametrize("n", range(1, 30))
def test_prefix_and_subsets_are_wide_enough(n):
    for b in range(1, 41):
        if S.smallest_partner(max(n, b)) > min(n, b):
            assert S.required(n, b) > min(n, b) or 100 * min(n, b) < 75 * max(n, b)
            continue
        need = S.required(n, b)
        assert 100 * need >= 75 * (n + b - need) and 100 * (need - 1) < 75 * (n + b - need + 1)
        assert n - need + 1 <= S.prefix(n)


def _corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    out = []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.45:
            w = list(rng.choice(out))
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
        elif kind < 0.6:
            w = [rng.choice(vocabulary) for _ in range(rng.randint(1, 30))] + passage
        elif kind < 0.8:
            w = [rng.choice(vocabulary[:3]) for _ in range(rng.randint(1, 14))]
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.randint(1, 200))]
        out.append(w)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize(("seed", "boundary"), [(1, 0), (2, 6), (3, 12), (4, None)])
def test_components_are_brute_force(spark, monkeypatch, seed, boundary):
    texts = _corpus(seed)
    want = components(texts)
    if boundary is not None:
        monkeypatch.setattr(S, "choose_boundary", lambda sizes, length: boundary)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, node string").repartition(4)
    got = S.components(docs).orderBy("doc_id").collect()
    assert [r["component_id"] for r in got] == want
    assert [r["n_shingles"] for r in got] == [len(shingle_set(t)) for t in texts]


def test_odd_rows(spark):
    got = S.components(odd(spark)).collect()
    assert sorted((r["n_shingles"] for r in got)) == sorted(len(shingle_set(t)) for _, t, *_ in ODD)
    by = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got}
    assert by[6, 1] == 5 and by[None, 2] is None and by[2, 0] == 2
    assert S.components(empty(spark)).count() == 0


def test_one_document_of_each_group(spark):
    texts = _corpus(7, 60)
    want = components(texts)
    rows = [(i, t, "s", "x") for i, t in enumerate(texts)] + [(0, texts[0], "s", "x"), (500, None, "s", "x"), (None, "some text", "s", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra string").repartition(3)
    left = S.representatives(docs)
    assert left.columns == docs.columns
    got = sorted((r["doc_id"] for r in left.collect()), key=lambda x: (x is None, x))
    assert got == [*sorted(set(want)), 500, None]
    assert S.representatives(empty(spark)).count() == 0


def test_one_id_on_unrelated_texts(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    # 5 stands on the roots of two components, on a lone text and on no words; 3 on one of its own and one of 7's
    rows = [(5, a), (5, b), (5, a), (5, a + " more"), (5, c), (5, ""), (6, a + " end"), (8, b + " end"), (9, b), (7, d), (3, d + " end"), (3, "quite another text of a few words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in S.representatives(docs).collect()]
    assert len(got) == 6 and {r for r in got if r[0] != 5} == {(3, d + " end"), (3, "quite another text of a few words")}
    of_five = [t for i, t in got if i == 5]
    assert sum(t.startswith(a) for t in of_five) == of_five.count(b) == of_five.count(c) == of_five.count("") == 1


def test_feasible_is_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 50))
        size = rng.integers(1, 40, n)
        x = np.stack([np.sort(rng.integers(0, 5, n)), np.arange(n), size, [rng.integers(0, S.prefix(int(v))) for v in size]], 1)
        x = x[np.lexsort((x[:, 1], x[:, 2], x[:, 0]))]
        can = lambda a, b: a[0] == b[0] and 100 * min(a[2], b[2]) >= 75 * max(a[2], b[2]) and min(a[2] - a[3], b[2] - b[3]) >= S.required(int(a[2]), int(b[2]))
        assert S.feasible(x).tolist() == [any(i != j and can(a, b) for j, b in enumerate(x)) for i, a in enumerate(x)]


def test_parity_bounds_the_difference():
    rng = np.random.default_rng(4)
    for n in (3, 150, 2000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 63, n // 3, dtype=np.uint64)]))
        p, q = S.parity(a), S.parity(b)
        size = min(len(p), len(q))
        assert np.bitwise_count(S.fold(p, size) ^ S.fold(q, size)).sum() <= len(np.setxor1d(a, b))


def test_connected(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_working_tables_go_when_they_were_read_last(spark):
    before = set(made())
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "another text of some words here")], "doc_id long, text string")
    found = S.components(docs)
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in made() if p not in before and exists(spark, p)}
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {1: 1, 2: 1, 3: 3}
    assert not left & {"lists", "entries", "mixed", "tried", "close"}


def test_whole_sets_meet_only_where_bitmaps_allow(spark, monkeypatch):
    """Long documents that share passages, of which none links to another: no pair is joined with whole sets in either round."""
    rng = random.Random(6)
    pieces = [[rng.choice([f"w{i}" for i in range(900)]) for _ in range(250)] for _ in range(16)]
    texts = [" ".join(w for k in rng.sample(range(16), 8) for w in pieces[k]) for _ in range(20)]
    assert components(texts) == list(range(20))
    tried, verify = [], S._verify
    monkeypatch.setattr(S, "_verify", lambda pairs, *a: tried.append(pairs.count()) or verify(pairs, *a))
    made_pairs, close = [], S._close
    monkeypatch.setattr(S, "_close", lambda pairs, *a: made_pairs.append(pairs.count()) or close(pairs, *a))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert [r["component_id"] for r in S.components(docs).orderBy("doc_id").collect()] == list(range(20))
    assert len(made_pairs) == 2 and made_pairs[1] > 20 and tried == [0, 0]
