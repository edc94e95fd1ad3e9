"""Connected components over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from timeloom.plans.scratch import materialise


def _star_round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star pass over edges (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # the minima are written: a join straight above an aggregation can't be split where a hub has most edges
    lowest = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")
    large = both.join(lowest, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    large = materialise(large, "large")
    root = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "root")
    small = large.join(root, "u")
    return small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component`` for each node of an undirected edge table; the component is its smallest node.

    Alternating large-star and small-star passes: the number of rounds grows with the logarithm of the
    longest path, each round is a written table, and only a row count and a checksum reach the driver.
    Null ends and self loops are ignored; an empty table gives an empty result.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(F.col(src).isNotNull() & F.col(dst).isNotNull()).where("u <> v").distinct()
    e = materialise(e, "edges")
    mark = lambda df: df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    before = mark(e)
    while before["n"]:
        e = materialise(_star_round(e), "edges")
        now = mark(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
