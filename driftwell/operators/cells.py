"""Results extracted from tables and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions.keys import HIGHER_IS_BETTER, comparable, norm_title


def _signed(value: Column, way: Column) -> Column:
    return F.when(way == "lower", -value).otherwise(value)


def best_per_group(results: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    return results.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= n)


def compare_excluding_self(results: DataFrame, entity: str, keys: list[str]) -> DataFrame:
    """Each entity's best value against the best of the others in its group: first, above, equal or below.

    The best of the others is the group's best, or its second best for the entity that holds the best: the two largest
    per group come from one aggregate, so no pair of entities is formed.
    """
    mine = results.groupBy(*keys, entity).agg(F.max(_signed(F.col("value"), F.col("direction"))).alias("mine"))
    g1 = mine.groupBy(*keys).agg(F.max(F.struct("mine", entity)).alias("top"))
    j = mine.join(g1, keys)
    second = j.where(F.col(entity) != F.col(f"top.{entity}")).groupBy(*keys).agg(F.max("mine").alias("second"))
    j = j.join(second, keys, "left").withColumn("others", F.when(F.col(entity) == F.col(f"top.{entity}"), F.col("second")).otherwise(F.col("top.mine")))
    status = F.when(F.col("others").isNull(), "first").when(F.col("mine") > F.col("others"), "above").when(F.col("mine") == F.col("others"), "equal").otherwise("below")
    return j.select(*keys, entity, F.col("mine"), F.col("others"), status.alias("status"))


VARIANT = r"(?i)\bours\b|\bproposed\b|\bw/|\bwithout\b"


def peers(results: DataFrame, mains: DataFrame, scope: list[str], top: int = 3) -> DataFrame:
    """The ``top`` peers of each main result, best first: rows of other methods in its ``scope`` (document, table, column,
    benchmark, metric, block).

    ``mains`` has the scope, ``locator`` and ``method``. A model is no peer if it is the paper's own, is named as a variant,
    or its name starts with the method's (of two characters or more). Without a direction, table order (``row_no``) counts.
    """
    key = lambda c: F.regexp_replace(F.lower(c), "[^0-9a-z]", "")
    others = results.where(~F.col("own") & ~F.col("model").rlike(VARIANT)).select(*scope, "model", "value", "direction", "row_no")
    own = key(F.coalesce("method", F.lit("")))
    j = mains.select(*scope, F.col("locator").alias("main"), own.alias("_own")).join(others, scope).where((F.length("_own") < 2) | ~F.startswith(key(F.col("model")), F.col("_own")))
    order = [F.when(F.col("direction") == "lower", F.col("value")).when(F.col("direction") == "higher", -F.col("value")).asc_nulls_last(), "row_no", "model", "value"]
    w = Window.partitionBy(*scope, "main").orderBy(*order)
    return j.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).drop("_own")


def own_siblings(results: DataFrame, mains: DataFrame, scope: list[str]) -> DataFrame:
    """The paper's other own rows in the scope of each main result, and whether each is better than it."""
    m = mains.select(*scope, F.col("locator").alias("main"), F.col("value").alias("_v"))
    j = m.join(results.where("own"), scope).where(F.col("locator") != F.col("main"))
    better = F.when(F.col("direction") == "higher", F.col("value") > F.col("_v")).when(F.col("direction") == "lower", F.col("value") < F.col("_v"))
    return j.withColumn("better", F.coalesce(better, F.lit(False))).drop("_v")


def on_one_scale(a: Column, b: Column, metric: Column) -> Column:
    return comparable(a, b, metric.rlike(HIGHER_IS_BETTER))


def verify_cell(claims: DataFrame, cells: DataFrame, id_col: str, tolerance: float = 0.0051) -> DataFrame:
    """Claims (doc, model, value) against table rows: verified, value_differs, ambiguous_row or row_missing."""
    key = lambda c: F.regexp_replace(norm_title(c), " ", "")
    rows = cells.groupBy(id_col, "table_id", "row").agg(F.max(F.when(F.col("col") == 0, F.col("text"))).alias("name"), F.collect_set("value").alias("row_values"))
    rows = rows.where("name is not null and size(row_values) > 0").select(id_col, key(F.col("name")).alias("row_key"), "row_values")
    uniq = rows.groupBy(id_col, "row_key").agg(F.count("*").alias("n_rows"), F.flatten(F.collect_list("row_values")).alias("found"))
    j = claims.withColumn("row_key", key(F.col("model"))).join(uniq, [id_col, "row_key"], "left")
    hit = F.exists("found", lambda x: (F.abs(x - F.col("value")) <= tolerance) | (F.abs(x - F.col("value") * 100) <= tolerance) | (F.abs(x * 100 - F.col("value")) <= tolerance))
    return j.withColumn("status", F.when(F.col("n_rows").isNull(), "row_missing").when(F.col("n_rows") > 1, "ambiguous_row").when(hit, "verified").otherwise("value_differs")).drop("found", "n_rows", "row_key")


def most_cited(results: DataFrame, citations: DataFrame, keys: list[str], order: tuple[str, ...] = ("row_no",)) -> DataFrame:
    """The peer with the most known citations, ties by table order (the columns of ``order``, ascending), and how many peers
    were known."""
    j = results.join(citations, "model", "left")
    known = F.col("citations").isNotNull()
    return j.groupBy(*keys).agg(F.min_by("model", F.when(known, F.struct(-F.col("citations"), *order))).alias("model"), F.count("citations").alias("checked"))


def difference(a: Column, b: Column, decimals: Column, way: Column) -> Column:
    """struct(diff, verdict): the signed difference at the shown precision; better or worse by direction."""
    d = a - b
    d = F.when(decimals == 0, F.round(d, 0)).when(decimals == 1, F.round(d, 1)).when(decimals == 2, F.round(d, 2)).otherwise(F.round(d, 3))
    good = F.when(d == 0, "equal").when(way.isNull(), None).when((d > 0) == (way == "higher"), "better").otherwise("worse")
    return F.struct(d.alias("diff"), good.alias("verdict"))


def code_ladder(runs: DataFrame, key: str = "paper_key") -> DataFrame:
    """The best repository of each paper: success first, then the nearer tier, then the deeper stage."""
    tier = F.element_at(F.create_map(*[x for k, v in (("official", 0), ("author", 1), ("third_party", 2), ("analogous", 3)) for x in (F.lit(k), F.lit(v))]), F.col("tier"))
    return runs.groupBy(key).agg(F.max_by(F.struct("repo_url", "tier", "stage", "success"), F.struct(F.coalesce("success", F.lit(False)), -F.coalesce(tier, F.lit(9)), F.col("stage_no"), F.col("repo_url"))).alias("b")).select(key, "b.*")
