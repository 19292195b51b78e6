"""Connected components and prefix sums: the two iterative or global helpers that other operators share."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local one only where the setting is absent (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="driftwell-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def release(spark: SparkSession) -> None:
    """Asks for the shuffle files and checkpoints that nothing refers to any more to be dropped now.

    Spark drops them once the driver has collected its garbage, which may be half an hour away; jobs of several large
    phases call this between phases so that these do not add up on disk.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame, fresh: bool = False, placed: bool = False) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage; ``fresh`` releases earlier phases first.

    ``placed`` keeps what Spark knows of how the rows are dealt (it does only without adaptive execution), so that a later
    join or aggregation on the same key moves the other side alone.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    if fresh:
        release(spark)
    if not placed:
        return df.checkpoint(eager=True)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def counted(df: DataFrame, condition) -> tuple[DataFrame, int]:
    """``df`` materialised as by ``cut``, and in how many of its rows ``condition`` holds, from the same job."""
    seen = Observation()
    done = cut(df.observe(seen, F.count_if(condition).alias("n")))
    return done, int(seen.get.get("n") or 0)


def unsized(done: DataFrame) -> DataFrame:
    """A result of ``cut`` without the size that Spark believes it to have, for loops that join what they have cut.

    A checkpoint keeps the size estimated for its plan, and a join's is the product of its sides', so in a loop the digits of
    that number multiply each round until planning does nothing but multiply it, whatever the size of the data.
    """
    spark = done.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(done._jdf.javaRDD(), done._jdf.schema()), spark)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node id reachable from node; only nodes with an edge appear.

    Every round points each node at its smallest neighbour, or itself if that is smaller, follows the pointers to their
    roots by doubling, and contracts the graph: edges inside a tree go, so later rounds see few. Every node that is no
    local minimum disappears in the round, so rounds and doublings grow with the logarithm of the nodes. Aggregations
    combine on the map side, so a node with very many edges costs one row a task. Joins sort and merge: the pointers grow
    with the nodes, and a broadcast would bring all of them to the driver. What a round hands on has no size (``unsized``).
    Raises if the bound on rounds is reached, never returns a partial result.
    Edges with a null end or equal ends are ignored; an empty input gives no rows.
    """
    def settled(df: DataFrame, condition) -> tuple[DataFrame, int]:
        done, n = counted(df, condition)
        return unsized(done), n

    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    e, left = settled(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), F.lit(True))
    labels = e.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0) if not left else None
    for _ in range(max_rounds):
        if not left:
            return labels
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = unsized(cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("low"))))
        moving = 1
        while moving:  # jump along the pointers, twice a job, until each names its root
            step = low.select(F.col("node").alias("low"), F.col("low").alias("to"))
            half = low.join(step.hint("merge"), "low").select("node", F.col("to").alias("low"))
            low, moving = settled(half.join(step.hint("merge"), "low").select("node", "to", (F.col("low") != F.col("to")).alias("moved")), F.col("moved"))
            low = low.select("node", F.col("to").alias("low"))
        to = low.select("node", F.col("low").alias("to"))
        if labels is None:
            labels = to.withColumnRenamed("to", "component")
        else:
            known = labels.join(to.withColumnRenamed("node", "component").hint("merge"), "component", "left")
            labels = unsized(cut(known.select("node", F.coalesce("to", "component").alias("component"))))
        ends = e.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")).hint("merge"), "a").join(to.select(F.col("node").alias("b"), F.col("to").alias("y")).hint("merge"), "b")
        e, left = settled(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), F.lit(True))
    raise RuntimeError(f"components not settled after {max_rounds} rounds")


def running_sums(df: DataFrame, order: list, sums: dict) -> DataFrame:
    """Adds, for each (name, column) of ``sums``, the sum over all rows before the row in the global ``order``.

    Rows are range-partitioned by ``order``; each partition sums its own rows, and the partitions' totals (one row a
    partition) give the offsets. No task sees more than one range. Rows equal in ``order`` must be told apart by it.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df
    for name, col in sums.items():
        dealt = dealt.withColumn(f"_{name}", col)
    dealt = cut(dealt.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_pid").agg(*[F.sum(f"_{k}").alias(f"_t{k}") for k in sums])
    totals = totals.select("_pid", *[F.coalesce(F.sum(f"_t{k}").over(w), F.lit(0)).alias(f"_o{k}") for k in sums])
    inner = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(totals, "_pid")
    for name in sums:
        out = out.withColumn(name, F.col(f"_o{name}") + F.coalesce(F.sum(f"_{name}").over(inner), F.lit(0)))
    return out.drop("_pid", *[f"_{k}" for k in sums], *[f"_o{k}" for k in sums])
