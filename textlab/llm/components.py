"""Distributed union-find: connected components of an edge table.

Alternating large-star and small-star steps turn every component into a star
around its smallest node in a logarithmic number of rounds. Each step is a
grouped minimum (combined before the shuffle) and a join, so a node with very
many edges is never gathered in one group, and AQE splits its join partition.
Each round is checkpointed to the shared folder; only a count and a checksum
reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.session import cut_lineage

MAX_ROUNDS = 60


def _state(e: DataFrame):
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("lo", "hi"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows ``(node, component)`` for every node that has an edge to another
    one; ``component`` is the smallest node reachable. Edges may repeat, point
    either way, be loops (ignored) or have a null end (ignored). No edges: an
    empty table."""
    x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
    e = edges.select(F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi")).where(
        x.isNotNull() & y.isNotNull() & (x != y)).distinct()
    e = cut_lineage(e)
    state = _state(e)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(
            e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where(
            "lo < hi").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(
            F.explode(F.array(F.struct(F.col("m").alias("lo"), F.col("hi").alias("hi")),
                              F.struct(F.col("m").alias("lo"), F.col("lo").alias("hi")))).alias("e")).select(
            "e.lo", "e.hi").where("lo < hi").distinct()
        e = cut_lineage(small)
        new = _state(e)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
