"""Connected components of a graph too large for one machine.

Defined cases: a link with a null end is none, links to oneself and repeated links change nothing, and an empty table
of links gives an empty result; only the columns u and v are read.

Large-star and small-star steps alternate until nothing changes; each is a grouped minimum and a join, and the edges
of a round are written to the shared folder, so lineage stays short and no link ever reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.sources.workspace import discard, materialize


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link, from rows (u, v); root is the smallest node of its component."""
    edges = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, "edges", share=8)
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small, "edges", share=8)
        now = _mark(after)
        discard(edges)
        edges = after
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
