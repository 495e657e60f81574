"""Connected components as joins: alternate large-star and small-star steps until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (large star) or smaller-or-equal (small star) neighbours to the smallest.

    ``edges``: u, v with u > v. The smallest neighbour is a map-side minimum; the join back has a plain
    exchange on either side, so a node with very many edges is split among tasks.
    """
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = stage(near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "star_least")
    linked = near.join(least, "u")
    if large:
        out = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """node, component (its smallest node) for each node of ``edges`` (u, v: long).

    Each round is written to the shared folder. Raises if ``rounds`` do not suffice (they grow with
    the logarithm of the longest path).
    """
    now = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        n, total = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if n == 0 or (n, total) == mark:
            break
        mark = n, total
        now = stage(_star(_star(now, True), False), "edges")
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    # settled: stars, every node but the smallest has one edge to it
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
