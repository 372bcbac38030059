"""Connected components of a table of links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.session import Workspace


def components(links: DataFrame, room: Workspace) -> DataFrame:
    """node, root for every node of the links (a, b); root is the smallest node that can be reached.

    Large-star and small-star rounds: neighbourhoods are only ever reduced to their minimum, never gathered, and each round is written
    to the shared folder, so a lost executor costs one round at most. A hub of any degree is a join key of its own, which
    Spark splits.
    """
    edges = room.save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                      .where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .where("u <> v").distinct()
        large = room.save(large, "large")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(small.withColumnRenamed("u", "w"), F.col("u") == F.col("w"))
        edges = rest.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v") \
            .unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        edges = room.save(edges, "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0])
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")) \
        .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
