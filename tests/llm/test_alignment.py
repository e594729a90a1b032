import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import alignment
from tests.llm.helpers import ODD, empty, odd

TEXTS = [
    "Hello world, it's\n fine.\n\nNext  word\t x", "a", "\n", "\nab", " ", "   ", "a ", "x▁y", "日本語のテキスト 漢字", "a\r\nb \r\n c", "<|endoftext|> <s> </s> <unk> <0x41>", "naïve café ☕ 𝒳   end",
    "don't   we'll I'M　x", "\x00\x1c \x1d\x85 b", "ﬁ é é", "aaaa" * 50, "def f(x):\n\treturn x\n\n\n    y = [1, 2]\n",
]


def _bytes_of_json_tokens():
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def _brute(texts):
    """The contract's columns from whole texts, token by token."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte = _bytes_of_json_tokens()
    rows = []
    for text in texts:
        links, groups, x, y = [], [], [], []
        if text:
            x = first.encode(" " + text, add_special_tokens=False).ids
            y = second.encode(text)
            p = [bytes(byte[c] for c in first.id_to_token(i)) for i in x]
            q = [bytes([int(second.id_to_piece(i)[3:-1], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in y]
            if b"".join(p) == b"".join(q) == (" " + text).encode():
                ends = [_running(p), _running(q)]
                cuts = sorted(set(ends[0]) & set(ends[1]))
                low = 0
                for cut in cuts:
                    own = [[i for i, e in zip(ids, e_, strict=True) if low < e <= cut] for ids, e_ in ((x, ends[0]), (y, ends[1]))]
                    groups.append(f"{','.join(map(str, own[0]))}|{','.join(map(str, own[1]))}")
                    low = cut
                starts = [[0, *e[:-1]] for e in ends]
                j = 0
                for i in range(len(x)):
                    while ends[1][j] <= starts[0][i]:
                        j += 1
                    k = j
                    while k < len(y) and starts[1][k] < ends[0][i]:
                        links.append((x[i], y[k]))
                        k += 1
            else:
                x, y = [], []
        rows.append((len(x), len(y), groups, links))
    held = Counter(pair for r in rows for pair in set(r[3]))
    most = Counter()
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    return [(a, b, len(g), len(k), sum(held[p] == most[p[0]] for p in k), sum(held[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for a, b, g, k in rows]


def _running(tokens):
    at, out = 0, []
    for t in tokens:
        at += len(t)
        out.append(at)
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_as_by_whole_texts(spark):
    docs = spark.createDataFrame([(k, t, "c") for k, t in enumerate(TEXTS)], "doc_id long, text string, part string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.digests(docs).collect()}
    for k, want in enumerate(_brute(TEXTS)):
        assert got[k] == want, TEXTS[k]
    assert got[TEXTS.index("x▁y")] == (0, 0, 0, 0, 0, 0, "")


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r for r in docs.select("doc_id", "text").collect() if len(r["text"] or "") < 5000]
    some = docs.join(spark.createDataFrame([(r["doc_id"],) for r in rows], "doc_id long"), "doc_id")
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.digests(some).collect()}
    assert got == dict(zip([r["doc_id"] for r in rows], _brute([r["text"] for r in rows]), strict=True))


def test_small_parts_give_the_same(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS * 2)], "doc_id long, text string").coalesce(1)
    want = sorted(map(tuple, alignment.digests(docs).collect()))
    again = sorted(map(tuple, alignment.digests(docs.repartition(16)).collect()))  # as many parts as tasks
    assert again == want


def test_relational_form_agrees(spark):
    pair = alignment.tokenizers()
    fine = [t for t in TEXTS if "▁" not in t]
    rows = []
    for k, t in enumerate(fine):
        x, y = pair.a.encode_ordinary(" " + t), pair.b.encode(t)
        rows.append((k, x, [len(pair.a_bytes[i]) for i in x], y, [len(pair.b_bytes[i]) for i in y]))
    tokens = spark.createDataFrame(rows, "doc_id long, xa array<int>, la array<int>, xb array<int>, lb array<int>")
    side = lambda i, n: tokens.select("doc_id", F.col(i).alias("ids"), F.col(n).alias("lengths"))
    links = alignment.align(side("xa", "la"), side("xb", "lb"))
    sums = links.groupBy("doc_id").agg(F.count_if("a_ends").alias("n_a"), F.count_if("b_ends").alias("n_b"), F.countDistinct("group").alias("n_groups"), F.count(F.lit(1)).alias("n_links"))
    got = {r["doc_id"]: tuple(r)[1:] for r in sums.collect()}
    assert got == {k: w[:4] for k, w in enumerate(_brute(fine))}
    pairs = {(r["doc_id"], r["a"], r["b"]): r["n"] for r in links.groupBy("doc_id", "a", "b").agg(F.count(F.lit(1)).alias("n")).collect()}
    want = Counter()
    for k, t in enumerate(fine):
        x, y = pair.a.encode_ordinary(" " + t), pair.b.encode(t)
        i, j, _, _ = alignment.links(*(np.array([len(n[i]) for i in ids]) for ids, n in ((x, pair.a_bytes), (y, pair.b_bytes))))
        want.update((k, x[p], y[q]) for p, q in zip(i, j, strict=True))
    assert pairs == want


def test_odd_rows_and_an_empty_table(spark):
    rows = alignment.digests(odd(spark)).collect()
    assert len(rows) == len(ODD) and sum(r["doc_id"] is None for r in rows) == 1
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_a"] == by[2]["n_links"] == 0 and by[1]["groups_sha256"] == by[2]["groups_sha256"] == "" and by[3]["n_a"] > 0
    twins = [tuple(r) for r in rows if r["doc_id"] == 10]
    assert len(twins) == 3 and len(set(twins)) == 2
    assert alignment.digests(empty(spark)).collect() == []
