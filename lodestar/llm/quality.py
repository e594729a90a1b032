"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1; other labels only tell whether a document with several is trusted. A small
network is fitted to the non-negative unbiased risk,
``prior * R(positive, +) + max(0, R(unlabelled, -) - prior * R(positive, -))``, over positives, unlabelled web text and a class
prior estimated from the two: a first classifier tells positives from unlabelled text, and the prior is the smallest
ratio, over its thresholds, of the unlabelled share above to the positive share above, bounded upwards for few rows.

A text is seen through twelve shares and counts of its characters, words and lines. Hashed shares of words and of
three-character grams beside them were tried and lowered held-out accuracy (README).

The fit sees at most ``MAX_POSITIVE`` positives and ``MAX_UNLABELLED`` unlabelled documents, chosen by a hash of
the id; only their features (a row of numbers each) reach the driver. Scoring is a narrow map over all whole texts.

Defined cases: null text is empty, and an empty one has a score too; very long texts are read whole; equal texts, as in
repeated rows, have equal scores; a document with several labels is trusted if all of them are 1; without a positive or
an unlabelled document every score is 0.5; an empty table gives an empty result; a null id counts as not held out. The
rows travel as one struct, ``row``, so columns of any name come through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import column_arrays, map_batches, text_of

MAX_POSITIVE, MAX_UNLABELLED = 4000, 12000
HIDDEN, STEPS, BATCH, RATE, DECAY = 16, 1500, 512, 0.01, 1e-4

_LETTER, _UPPER, _DIGIT, _SYMBOL, _MARK, _SPACE = range(6)
_CLASS: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """The character class of each code point of the basic plane; later planes count as letters."""
    if not _CLASS:
        table = np.zeros(1 << 16, np.uint8)
        for i in range(1 << 16):
            c = chr(i)
            table[i] = _UPPER if c.isupper() else _SPACE if c.isspace() else _DIGIT if c.isdigit() else _LETTER if c.isalpha() else _MARK if c in ".,;:!?'\"-()" else _SYMBOL
        _CLASS.append(table)
    return _CLASS[0]


_EDGE = re.compile(r"^\W{2,}|\W{2,}$")
FEATURES = 12


def features(text: str) -> np.ndarray:
    """Twelve numbers about a whole text."""
    points = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), (1 << 16) - 1)
    of = np.bincount(_classes()[points], minlength=6).astype(float)
    chars, solid = max(1.0, float(len(points))), max(1.0, len(points) - of[_SPACE])
    letters = max(1.0, of[_LETTER] + of[_UPPER])
    words = text.split()
    n = max(1, len(words))
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x]
    ragged = sum(c for w, c in seen.items() if not (w[-1:].isalnum() or w[-2:-1].isalnum()) or not w[:1].isalnum() and not w[1:2].isalnum())
    return np.array([
        np.log1p(len(words)),
        of[_SYMBOL] / solid,
        of[_UPPER] / letters,
        of[_DIGIT] / solid,
        of[_MARK] / solid,
        of[_SPACE] / chars,
        min(40.0, solid / n),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        len(seen) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        max(seen.values(), default=0) / n,
        ragged / n,
    ])


class Network:
    """Features to the log odds of label 1, through one layer."""

    def __init__(self, x: np.ndarray, hidden: int, seed: int):
        draw = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        self.p = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), draw.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        self.m, self.v, self.t = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(z @ self.p[0] + self.p[1])
        return z, h, h @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x)[2], -30, 30)))

    def step(self, x: np.ndarray, slope: np.ndarray) -> None:
        """One Adam step down the risk whose slope by each row's log odds is ``slope``."""
        z, h, _ = self.forward(x)
        back = np.outer(slope, self.p[2]) * (1 - h * h)
        grads = [z.T @ back, back.sum(0), h.T @ slope, slope.sum(keepdims=True)]
        self.t += 1
        for k, g in enumerate(grads):
            g = g + DECAY * self.p[k]
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.p[k] = self.p[k] - RATE * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """The share of label 1 among unlabelled rows."""
    p_fit, p_held, u_fit, u_held = positive[::2], positive[1::2], unlabelled[::2], unlabelled[1::2]
    if not len(p_held) or not len(u_held):
        return 0.5
    both = np.concatenate([p_fit, u_fit])
    side = np.concatenate([np.ones(len(p_fit)), np.zeros(len(u_fit))])
    weight = np.where(side == 1, 0.5 / max(1, len(p_fit)), 0.5 / max(1, len(u_fit)))
    net = Network(both, HIDDEN, 7)
    for _ in range(400):
        net.step(both, weight * (net.score(both) - side))
    p, u = np.sort(net.score(p_held)), np.sort(net.score(u_held))
    cuts = np.unique(np.concatenate([p, u]))
    above_p = 1 - np.searchsorted(p, cuts) / len(p)
    above_u = 1 - np.searchsorted(u, cuts) / len(u)
    slack = np.sqrt(np.log(4 / delta) / 2 / len(u)) + np.sqrt(np.log(4 / delta) / 2 / len(p))
    ok = above_p > 0.05
    bound = (above_u[ok] + slack) / above_p[ok]
    at = int(np.argmin(bound))
    return float(np.clip(above_u[ok][at] / above_p[ok][at], 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 11) -> Network:
    """Minimise the non-negative risk with logistic loss by mini-batches; a batch whose negative part falls below
    zero climbs that part instead."""
    net = Network(np.concatenate([positive, unlabelled]), HIDDEN, seed)
    draw = np.random.default_rng(seed)
    for _ in range(STEPS):
        p = positive[draw.integers(0, len(positive), min(BATCH, len(positive)))]
        u = unlabelled[draw.integers(0, len(unlabelled), min(2 * BATCH, len(unlabelled)))]
        gp, gu = net.forward(p)[2], net.forward(u)[2]
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        down_p, down_u = -prior * _sigmoid(gp) / len(p), _sigmoid(gu) / len(u)
        if negative < 0:
            slope_p, slope_u = -down_p, -down_u
        else:
            slope_p, slope_u = down_p - prior * _sigmoid(-gp) / len(p), down_u
        net.step(np.concatenate([p, u]), np.concatenate([slope_p, slope_u]))
    return net


def crc_mod(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % parts


def _chance(doc_id: str, salt: int) -> Column:
    """A uniform number in [0, 1) by hash of the id."""
    return F.pmod(F.xxhash64(F.lit(salt), F.col(f"`{doc_id}`")), F.lit(1 << 30)) / float(1 << 30)


def train(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Network | None:
    """Fit on documents for which ``learn`` (over the id) holds; None if there is nothing to learn from."""
    trusted = labels.filter(learn).groupBy(F.col(f"`{doc_id}`").alias("__id")).agg(F.min(label).alias("low")).filter("low = 1 and __id is not null")
    trusted = trusted.select("__id", _chance("__id", 1).alias("__order")).orderBy("__order", "__id").limit(MAX_POSITIVE)
    base = docs.filter(learn)
    share = min(1.0, MAX_UNLABELLED / max(1, base.count()))
    rows = base.select(F.col(f"`{doc_id}`").alias("__id"), text_of(text).alias("text"), _chance(doc_id, 2).alias("__chance"))
    rows = rows.join(F.broadcast(trusted), "__id", "left")  # at most MAX_POSITIVE ids
    rows = rows.withColumn("free", F.col("__chance") < share).filter("free or __order is not null")
    rows = rows.select("text", F.col("__order").isNotNull().alias("trusted"), "free", "__chance")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (texts,) = column_arrays(batch, "text")
            yield pa.RecordBatch.from_arrays(
                [pa.array([features(t).tolist() for t in texts], pa.list_(pa.float64())), *batch.columns[1:]],
                names=["x", "trusted", "free", "__chance"],
            )

    got = map_batches(rows, measure, "x array<double>, trusted boolean, free boolean, __chance double")
    got = got.orderBy("__chance", "x").limit(2 * (MAX_POSITIVE + MAX_UNLABELLED)).toPandas()
    if not got["trusted"].any() or not got["free"].any():
        return None
    x = np.array(got["x"].tolist(), float)
    positive, unlabelled = x[got["trusted"].to_numpy(bool)], x[got["free"].to_numpy(bool)]
    return fit(positive, unlabelled, estimate_prior(positive, unlabelled))


def score(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """(row, score, predicted) of every document; ``row`` holds the columns of ``docs``."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_of(text).alias("text"))
    kind = rows.schema["row"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (texts,) = column_arrays(batch, "text")
            s = np.full(len(texts), 0.5) if net is None or not texts else net.score(np.array([features(t) for t in texts]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["row", "score", "predicted"])

    return map_batches(rows, run, T.StructType([T.StructField("row", kind), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
