"""One document after the other, all at once: from its tables to its main results and how they compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions.keys import status_code
from driftwell.operators import cells, tables
from driftwell.operators.graph import cut

VARIANT = r"(?i)\bw/|\bw/o|\bwithout|\bablation|\bvariant"


def in_lanes(results: DataFrame) -> DataFrame:
    """Adds ``lane``, where results of one table can be compared: the column, or the row and model group of a turned table."""
    group = F.regexp_extract("model", r"^(.*) / [^/]*$", 1)
    turned = F.concat_ws(":", F.lit("r"), F.col("row").cast("string"), group)
    return results.withColumn("lane", F.when(F.col("orientation") == "transposed", turned).otherwise(F.concat_ws(":", F.lit("c"), F.col("col").cast("string")))).withColumn("block_id", F.coalesce("block_id", F.lit("")))


def main_results(results: DataFrame, id_col: str = "page_id", claimed: Column | None = None, most: int = 2) -> DataFrame:
    """At most ``most`` results of a document's own rows, one a benchmark, with their ``place``.

    Benchmarks that the document claims (an array of keys) come first, then values its text tells, then table order; of a
    turned table the average before the tasks; of one column a row that is no variant first. Results whose direction is
    unknown are left out.
    """
    mean = F.regexp_extract("metric", r"([^/]*)$", 1).rlike(tables.MEAN)
    first = F.lit(0) if claimed is None else F.coalesce(F.nullif(F.array_position(claimed, F.col("bench_key")), F.lit(0)), F.lit(1 << 30))
    order = [first.asc(), F.coalesce("told", F.lit(False)).desc(), F.col("table_id").asc(), ((F.col("orientation") == "transposed") & ~mean).asc(), F.col("col").asc(), F.col("model").rlike(VARIANT).asc(), F.col("row").asc()]
    own = results.where("own and direction is not null")
    w = Window.partitionBy(id_col, "bench_key").orderBy(*order)
    best = own.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    best = best.withColumn("place", F.row_number().over(Window.partitionBy(id_col).orderBy(*order)))
    return best.where(F.col("place") <= most).drop("_rn")


def best_own(results: DataFrame, mains: DataFrame, scope: list[str]) -> DataFrame:
    """Each main result, or the best other own result in its scope where that is better; told values stay."""
    signed = F.when(F.col("direction") == "lower", -F.col("value")).otherwise(F.col("value"))
    own = results.where("own and direction is not null").groupBy(*scope, "direction").agg(F.max_by(F.struct("locator", "row", "col", "model", "value", "text"), F.struct(signed, -F.col("row"), -F.col("col"))).alias("_best"))
    j = mains.join(own, [*scope, "direction"])
    better = ~F.coalesce("told", F.lit(False)) & F.when(F.col("direction") == "lower", F.col("_best.value") < F.col("value")).otherwise(F.col("_best.value") > F.col("value"))
    put = {c: F.when(better, F.col(f"_best.{c}")).otherwise(F.col(c)) for c in ("locator", "row", "col", "model", "value", "text")}
    return j.select(*[put.get(c, F.col(c)).alias(c) for c in mains.columns])


def analyse(papers: DataFrame, rows: DataFrame, results: DataFrame, id_col: str = "page_id") -> DataFrame:
    """One row a document and main result (one without): the first stage that failed, peers, and standing among documents.

    ``papers`` has the id, ``method``, ``benchmarks`` and ``has_html``; ``rows`` are its table rows. ``reason`` is null where
    there is a main result, else no_benchmark, no_html, no_tables, no_results, no_own_row or no_direction. ``best_peer`` is
    the best value of other methods in the same table, column (or row), benchmark, metric and block; ``standing`` compares
    with the main results of other documents on the same benchmark and metric.
    """
    results = cut(in_lanes(results))  # read once, used by every stage
    scope = [id_col, "table_id", "lane", "bench_key", "metric_key", "block_id"]
    mains = cut(best_own(results, main_results(results, id_col), scope))
    peers = cells.peers(results.withColumn("row_no", F.col("row")), mains.join(papers.select(id_col, "method"), id_col), scope, top=1 << 30)
    per = peers.groupBy(id_col, F.col("main").alias("locator")).agg(F.count("*").alias("n_peers"), F.min_by(F.struct("model", "value"), "place").alias("_peer"))
    stand = cells.compare_excluding_self(mains, id_col, ["bench_key", "metric_key"]).select(id_col, "bench_key", "metric_key", F.col("status").alias("standing"))
    found = mains.join(per, [id_col, "locator"], "left").join(stand, [id_col, "bench_key", "metric_key"], "left")
    found = found.select(id_col, "place", "locator", "benchmark", "metric", "model", "value", F.coalesce("n_peers", F.lit(0)).alias("n_peers"), F.col("_peer.model").alias("peer"), F.col("_peer.value").alias("best_peer"), "standing")
    seen = papers.join(rows.select(id_col).distinct().withColumn("_t", F.lit(True)), id_col, "left")
    counts = results.groupBy(id_col).agg(F.count("*").alias("_n"), F.count_if("own").alias("_own"))
    seen = seen.join(counts, id_col, "left").join(found, id_col, "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    reason = status_code([(F.coalesce(F.size("benchmarks"), F.lit(0)) <= 0, "no_benchmark"), (~F.col("has_html"), "no_html"), (F.col("_t").isNull(), "no_tables"), (no("_n"), "no_results"), (no("_own"), "no_own_row"), (F.col("place").isNull(), "no_direction")], "")
    return seen.withColumn("reason", F.nullif(reason, F.lit(""))).drop("_t", "_n", "_own", "has_html", "benchmarks", "method")
