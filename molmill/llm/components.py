"""Connected components of an edge table, by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).head()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(u, v); component is the smallest node reachable.

    Each round links every node's larger neighbours to the smallest node near it, then
    every node and its smaller neighbours likewise, until only stars are left; the number
    of rounds grows with the logarithm of the longest path. Minima are pre-aggregated
    before the shuffle, and a node of very many edges is a skewed join key that adaptive
    execution splits; no node's neighbours are gathered. Self links and repeats are
    dropped; no edges give no rows.
    """
    at = scratch(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _state(at)
    while True:
        both = at.select("u", "v").union(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        at = scratch(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        before, state = state, _state(at)
        if state == before:
            return at.select(F.col("u").alias("node"), F.col("v").alias("component")).union(at.select("v", "v").distinct())
