"""Connected components by rounds of large and small stars.

Each round links every node's larger neighbours to its smallest (large star), then its smaller ones
and itself (small star); it ends when a round changes nothing, after some log^2 rounds. Minima are
added up in each task before they are shuffled, so a node with very many links is no hot spot. Edges
stay on shared storage; the driver sees a count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.durable import durable


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("u", "v"), 20))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for all nodes of ``edges`` (u, v).

    Edges may be repeated, in either direction, and from a node to itself; rows with a null are
    left out. No edges give no rows.
    """
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    larger, smaller = F.greatest("u", "v"), F.least("u", "v")
    edges = edges.dropna().select(larger.alias("u"), smaller.alias("v")).distinct()
    edges = durable(edges, "edges")
    before = _state(edges)
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node's own minimum keeps it linked
        large = durable(large.unionAll(edges.filter("u = v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        edges = durable(small.distinct(), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    nodes = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes
