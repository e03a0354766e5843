"""Connected components of a distributed edge list (alternating large-star and
small-star steps; the rounds grow with the logarithm of the longest path)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _lowest(edges: DataFrame, key: str, other: str) -> DataFrame:
    """Per ``key`` the smallest ``other``; ``neg`` carries the key inverted, so
    that a join on it deals both sides out anew and can split hot keys."""
    return edges.groupBy(key).agg(F.min(other).alias("low")).select(F.bitwise_not(F.col(key)).alias("neg"), "low")


def _with_lowest(edges: DataFrame, key: str, low: DataFrame) -> DataFrame:
    return edges.withColumn("neg", F.bitwise_not(F.col(key))).join(low, "neg").drop("neg")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of an edge: the smallest node reachable.
    Self-loops and rows with a NULL end are ignored; nodes are longs."""
    hi, lo = F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")
    e = stored(edges.filter(F.col(a) != F.col(b)).select(hi, lo).distinct(), "cc", narrow=True)
    state = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == tuple(now):
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
                e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
        state = tuple(now)
        both = e.unionByName(e.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        low = _lowest(both, "hi", "lo")
        # large star: neighbours above u move to the smallest of u's neighbourhood
        large = _with_lowest(e, "lo", low).select("hi", F.least("lo", "low").alias("lo")).distinct()
        # small star: neighbours below u, and u, move to the smallest of them
        low = _lowest(large, "hi", "lo")
        moved = _with_lowest(large, "hi", low)
        e = stored(moved.filter("lo <> low").select(F.col("lo").alias("hi"), F.col("low").alias("lo"))
                   .unionByName(moved.select("hi", F.col("low").alias("lo"))).distinct(), "cc", narrow=True)
