"""Plain versions of the definitions that the operators must meet."""

from __future__ import annotations

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Texts that have broken text code before.
ODD = [
    (1, None, "a", None), (2, "", "a", "x"), (3, " \t\n", None, "x"), (4, "one", "b", "x"), (5, "A b C d E", "b", "x"), (6, "a B c D e", "b", "x"),
    (7, "x" * 70_000, "a", "x"), (8, "lorem ipsum dolor sit amet " * 4000, "a", "x"), (9, "naïve café ☕ 𝒳   end", "a", "x"), (10, "l\nl\n\nl\r\nm", "a", "x"),
    (10, "l\nl\n\nl\r\nm", "a", "x"), (10, "another text with the same id as the row above it", "c", None), (11, "#*$%&|<>" * 5, "c", "x"), (None, "no id here but some words", "c", "x"),
    (12, "one two three four five six seven eight " * 5, "c", "x"),
]
SCHEMA = "doc_id long, text string, source string, extra string"


def odd(spark):
    """The odd texts in several partitions."""
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def rule_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text)
    places = defaultdict(list)
    for i in range(len(w) - 7):
        places[tuple(w[i : i + 8])].append(i)
    covered = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def shingle_set(text):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(texts):
    """The smallest index that each text is linked with, by comparing all pairs."""
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]
