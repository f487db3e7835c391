"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node reachable.

    Each round replaces the edges by stars around ever smaller centres, so the rounds grow with the
    logarithm of the longest path.  Minima are combined on the map side and written before they are joined, so both
    sides of each join come straight from a scan and AQE splits a centre that holds a third of the edges.  Null ends,
    loops and repeated edges are dropped.
    """
    now = settle(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    )
    state = _state(now)
    while True:
        ends = now.select(F.col("b").alias("u"), F.col("a").alias("v")).union(now.select("a", "b"))
        low = settle(ends.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).where("m < u"))
        # the larger neighbours of b go to the least of b's neighbourhood; b itself where nothing is smaller
        large = now.join(low, now.b == low.u, "left").select("a", F.coalesce("m", "b").alias("b"))
        large = settle(large.distinct())
        least = settle(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = settle(small.union(least).distinct())
        before, state = state, _state(new)
        for done in (now, low, large, least):
            discard(done)
        now = new
        if state == before:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(
                now.select("b", F.col("b").alias("c")).distinct()
            )


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b"))).first())
