"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newswake.llm.tables import stored


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of every node with an edge (a, b).

    Each round links the larger neighbours of a node to its smallest neighbour, then the smaller
    ones likewise, and stores the edges, so a lost executor costs one round at most; about the log
    of the longest path in rounds. Nothing but a count and a checksum reaches the driver. Loops and
    repeated edges are ignored; an empty table gives an empty result.
    """
    edges = stored(edges.filter("a <> b").select("a", "b").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()  # a > b throughout
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(
            F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                              F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        ).select("e.*").filter("a <> b").distinct()
        edges = stored(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
