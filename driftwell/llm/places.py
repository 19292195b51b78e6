"""Global positions of rows: the step that the manifest and the sharding share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.operators.graph import cut

#: A side of at most so many rows, counted, is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000
_IN_PARTITION = (1 << 33) - 1


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` allow it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def with_positions(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Adds the number of rows before each row in ``order`` (long, from 0).

    Rows are dealt to ranges of the order and sorted there; a row's place in its range comes from Spark's own row number
    of a partition, and the ranges' sizes (one row a partition) give the offsets. Nothing else moves. Rows equal in
    ``order`` are told apart by their place in ``df``, so that even a third of equal rows is spread over ranges; ``df``
    should be materialised, so that this place is the same whenever it is computed.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [*order, F.col("_tie")]
    dealt = cut(df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *by).sortWithinPartitions(*by).drop("_tie"))
    placed = dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.spark_partition_id())
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))  # one row a partition
    sizes = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = F.col("_at").bitwiseAND(F.lit(_IN_PARTITION)) + F.col("_before")
    return placed.join(F.broadcast(sizes), "_range").withColumn(name, at).drop("_at", "_range", "_before")
