"""Principal components, clusterings of small sets, and agreement of clusterings."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.vectors import dot, minus
from lodestar.sources.workspace import share_code

#: Most rows that are clustered in one task; agglomeration needs all distances.
MAX_CLUSTERED = 5000


def moments(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance of vectors. Each task adds up its outer products; a matrix per task is summed."""
    share_code(df.sparkSession)
    bare = df.filter(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                n, s, q = n + len(x), s + x.sum(0), q + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([q.ravel().tolist()])], names=["n", "s", "q"])

    parts = bare.mapInArrow(add, "n long, s array<double>, q array<double>")
    # element-wise sums of the partial matrices: width**2 numbers reach the driver, whatever the rows
    long = parts.select("n", F.posexplode(F.concat("s", "q")).alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    rows = long.orderBy("pos").collect()
    if not rows:
        return 0, np.zeros(0), np.zeros((0, 0))
    d = int((np.sqrt(1 + 4 * len(rows)) - 1) / 2)
    n, x = rows[0]["n"], np.array([r["x"] for r in rows])
    mean = x[:d] / n
    return n, mean, (x[d:].reshape(d, d) - n * np.outer(mean, mean)) / max(1, n - 1)


def components(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, eigenvalues in falling order, and components as rows, each with its largest loading positive."""
    _, mean, cov = moments(df, vector)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1].T
    signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])
    return mean, values, vectors * signs[:, None]


def spectrum(df: DataFrame, vector: str, k: int) -> DataFrame:
    """(component, eigenvalue, ratio, cumulative) of the first ``k`` components; ratios are over all."""
    _, values, _ = components(df, vector)
    ratio = values / values.sum()
    rows = [(i + 1, float(round(v, 9)), float(round(r, 9)), float(round(c, 9))) for i, (v, r, c) in enumerate(zip(values, ratio, ratio.cumsum(), strict=True))]
    return df.sparkSession.createDataFrame(rows[:k], "component int, eigenvalue double, ratio double, cumulative double")


def project(df: DataFrame, item: str, vector: str, k: int, centred: bool = True) -> DataFrame:
    """(item, component, score) on the first ``k`` components of ``df`` itself, JVM-side."""
    mean, _, parts = components(df, vector)
    literal = lambda a: F.array(*[F.lit(float(x)) for x in a])
    x = minus(F.col(vector), literal(mean)) if centred else F.col(vector)
    scored = df.select(item, F.array(*[F.round(dot(x, literal(p)), 6) for p in parts[:k]]).alias("s"))
    return scored.select(item, F.posexplode("s").alias("component", "score")).withColumn("component", F.col("component") + 1)


def _average_linkage(x: np.ndarray, ks: Iterable[int]) -> dict[int, np.ndarray]:
    """Labels for each number of clusters by agglomeration with average cosine distance."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - x @ x.T
    np.fill_diagonal(d, np.inf)
    sizes, member, out = np.ones(len(x)), np.arange(len(x)), {}
    alive = len(x)
    wanted = set(ks)
    while True:
        if alive in wanted:
            out[alive] = np.unique(member, return_inverse=True)[1]
        if alive <= 1 or alive <= min(wanted, default=1):
            return out
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        merged = (sizes[i] * d[i] + sizes[j] * d[j]) / (sizes[i] + sizes[j])
        d[i], d[:, i] = merged, merged
        d[j], d[:, j], d[i, i] = np.inf, np.inf, np.inf
        sizes[i] += sizes[j]
        member[member == j] = i
        alive -= 1


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette with cosine distances; a cluster of one scores 0."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - x @ x.T
    one = np.eye(labels.max() + 1)[labels]
    counts = one.sum(0)
    sums = d @ one
    own = sums[np.arange(len(x)), labels] / np.maximum(counts[labels] - 1, 1)
    other = np.where(one > 0, np.inf, sums / counts).min(1)
    s = np.where(counts[labels] > 1, (other - own) / np.maximum(np.maximum(own, other), 1e-300), 0.0)
    return float(s.mean())


def clusterings(df: DataFrame, item: str, vector: str, ks: Iterable[int]) -> DataFrame:
    """(k, item, cluster, silhouette, best) for a set of at most :data:`MAX_CLUSTERED` rows, in one task."""
    share_code(df.sparkSession)
    ks = list(ks)
    if df.limit(MAX_CLUSTERED + 1).count() > MAX_CLUSTERED:
        raise ValueError(f"agglomeration is for at most {MAX_CLUSTERED} rows")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(item)
        x = np.array(pdf["v"].tolist(), float)
        parts = []
        for k, labels in _average_linkage(x, [k for k in ks if k < len(x)]).items():
            first = {c: i for i, c in reversed(list(enumerate(labels)))}
            order = {c: n for n, c in enumerate(sorted(first, key=first.get))}
            parts.append(pd.DataFrame({"k": k, item: pdf[item].to_numpy(), "cluster": [order[c] for c in labels], "silhouette": round(silhouette(x, labels), 6)}))
        return pd.concat(parts) if parts else pd.DataFrame({"k": [], item: [], "cluster": [], "silhouette": []})

    kind = dict(df.dtypes)[item]
    rows = df.select(item, F.col(vector).cast("array<double>").alias("v"), F.lit(0).alias("g"))
    out = rows.groupBy("g").applyInPandas(lambda p: run(p.drop(columns="g")), f"k int, {item} {kind}, cluster int, silhouette double")
    w = Window.orderBy(F.desc("silhouette"), "k")
    best = out.select("k", "silhouette").distinct().withColumn("r", F.row_number().over(w)).select("k", (F.col("r") == 1).alias("best"))
    return out.join(best, "k")


def rand_index(df: DataFrame, a: str, b: str) -> DataFrame:
    """The adjusted Rand index of two labellings of the same rows, from their contingency table."""
    two = lambda c: F.sum(c * (c - 1) / 2)
    n = F.col("count")
    cells = df.groupBy(a, b).count().agg(two(n).alias("cells"), F.sum("count").alias("n"))
    rows = df.groupBy(a).count().agg(two(n).alias("rows"))
    columns = df.groupBy(b).count().agg(two(n).alias("columns"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    expected = F.try_divide(F.col("rows") * F.col("columns"), pairs)
    top = (F.col("rows") + F.col("columns")) / 2
    value = F.when(top == expected, 1.0).otherwise(F.try_divide(F.col("cells") - expected, top - expected))
    return cells.crossJoin(rows).crossJoin(columns).select(F.round(value, 6).alias("rand_index"))
