"""Positions in a total order without sorting everything in one task."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.session import Workspace


def positions(df: DataFrame, order, name: str = "position") -> DataFrame:
    """Adds 1, 2, 3 .. in the given order.

    Rows are dealt into ranges of the order and written, each range is numbered
    on its own, and the sizes of the ranges before it are added; that table has
    one row per range.
    """
    work = Workspace(df.sparkSession, "ranges")
    dealt = work.save(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (
        dealt.withColumn("_inside", inside).join(F.broadcast(offsets), "_range")
        .withColumn(name, F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_before")
    )


def ranks(df: DataFrame, score: str, name: str, by=()) -> DataFrame:
    """Adds the rank by descending score (ties share the smallest), per group."""
    placed = positions(df, [*[F.col(c) for c in by], F.desc(score)], "_at")
    tie = [*by, score]
    first = placed.groupBy(*tie).agg(F.min("_at").alias("_first"))
    if by:
        start = placed.groupBy(*by).agg((F.min("_at") - 1).alias("_start"))
        first = first.join(start, list(by)).withColumn("_first", F.col("_first") - F.col("_start")).drop("_start")
    return placed.join(first, tie).withColumn(name, F.col("_first")).drop("_at", "_first")
