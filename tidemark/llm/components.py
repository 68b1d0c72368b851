"""Connected components of a distributed graph, by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MOST_STEPS = 60


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node reachable.

    Each step is a grouped minimum and a join on the node. A node with very many links is summed before the
    shuffle, and the join's other side has one row a node, so that Spark can split its rows. Tables written
    after each step cut the lineage. Steps end when the set of links stops changing; links then form stars.
    """
    big, small = F.greatest("a", "b"), F.least("a", "b")
    now = scratch.keep(edges.where("a <> b").select(big.alias("u"), small.alias("v")).distinct(), f"{name}-0")
    print_before = None
    for step in range(1, MOST_STEPS):
        # Large star: every larger neighbour of u is linked to u's smallest neighbour.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: smaller neighbours of u, and u, are linked to the smallest of them.
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lowest, "u")
        star = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        now = scratch.keep(star.distinct(), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        print_now = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if print_now == print_before:
            break
        print_before = print_now
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
