"""Connected components by alternating stars, entirely as grouping and joins of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratecraft.session import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(u, v)``: root is the smallest node it can reach.

    Each round hangs a node's larger neighbours, then its smaller ones, under its smallest neighbour, until every node hangs
    directly under its root. Minima are taken before the shuffle, so a node with very many neighbours is no hot task; rounds
    grow with the logarithm of the longest path, and each is written to the shared folder. Loops, repeated edges and edges
    with a null end are dropped. No edges give no rows.
    """
    known = F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))
    now = stage(edges.where(known).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while (state := _state(now)) != before:
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        under = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(under, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stage(moved.union(under.select("u", F.col("m").alias("v"))).distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.hash("u", "v").cast("long")).alias("s")).first()
    return row["n"], row["x"], row["s"]
