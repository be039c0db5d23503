"""Connected components by alternating large-star and small-star rounds over written tables.

Minima are aggregated map-side and joined back to the edges, so a hub with a third of all edges is
never gathered: its edges stay spread and the join that meets it is one that Spark splits. Each
round is written to the shared folder; only a count and a checksum come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(edges: DataFrame) -> DataFrame:
    """Large-star: every neighbour larger than u is tied to the least of u and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Small-star over edges (a < b): b's lower neighbours and b itself are tied to the least of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    tied = edges.join(least, "b")
    return tied.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(tied.select(F.col("m").alias("a"), "b")).where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(id, component): the least id reachable from each id that has an edge. Edges: (a, b), any order."""
    at = scratch.cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-0")
    mark, turn = None, 0
    while True:
        turn += 1
        large = scratch.cut(_star(at), f"{name}-{turn}-large")
        at = scratch.cut(_small(large), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}", f"{name}-{turn}-large")
        now = tuple(at.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.shiftright(F.xxhash64("a", "b"), 24))).first())
        if now == mark:
            break
        mark = now
    return at.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(at.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
