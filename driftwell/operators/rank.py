"""The deterministic rank contract: tier, date band, concept breadth, day, domain hits, key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions.keys import concept_breadth, weight_band

BAND_DAYS = 3
MIN_SUPPORT = 3


def tiers(keywords: DataFrame) -> DataFrame:
    """(profile_id, band, tier): the distinct weight bands of a profile's core keywords, heaviest 0."""
    bands = keywords.where("kind = 'core'").select("profile_id", weight_band(F.col("weight")).alias("band")).distinct()
    return bands.withColumn("tier", F.row_number().over(Window.partitionBy("profile_id").orderBy(F.desc("band"))) - 1)


def band_anchor(scored: DataFrame, day_col: str = "day") -> DataFrame:
    """(profile_id, anchor): the newest day within two of the newest that MIN_SUPPORT eligible rows reach, else the newest.

    The MIN_SUPPORT-th newest row decides, so days are counted first and only days are sorted.
    """
    days = scored.where(F.col(day_col).isNotNull()).groupBy("profile_id", day_col).agg(F.count("*").alias("n"))
    w = Window.partitionBy("profile_id").orderBy(F.desc(day_col))
    run = days.withColumn("upto", F.sum("n").over(w)).withColumn("newest", F.max(day_col).over(Window.partitionBy("profile_id")))
    ok = (F.col("upto") >= MIN_SUPPORT) & (F.datediff("newest", day_col) <= BAND_DAYS - 1)
    return run.groupBy("profile_id").agg(F.coalesce(F.max(F.when(ok, F.col(day_col))), F.max("newest")).alias("anchor"))


def rank_columns(key: str = "doc_id") -> list[Column]:
    """Sort columns of the contract over rows with tier, band, breadth, day, domain_n."""
    return [F.asc("tier"), F.asc("band"), F.desc("breadth"), F.desc_nulls_last("day"), F.desc("domain_n"), F.asc(key)]


def ranked(judged: DataFrame, keywords: DataFrame, key: str = "doc_id") -> DataFrame:
    """Eligible rows of ``judged`` (with ``day``) in rank order: rank_pos from 1 within each profile."""
    rows = judged.where("eligible").withColumn("best_band", weight_band(F.col("weight_max")))
    t = tiers(keywords).withColumnRenamed("band", "best_band")
    rows = rows.join(t, ["profile_id", "best_band"], "left")
    rows = rows.join(band_anchor(rows), "profile_id", "left")
    band = F.when(F.col("day").isNull(), 10**6).otherwise(F.floor(F.greatest(F.datediff("anchor", "day"), F.lit(0)) / BAND_DAYS))
    rows = rows.withColumn("band", band.cast("long")).withColumn("breadth", concept_breadth(F.col("core_hits")))
    rows = rows.withColumn("domain_n", F.least(F.size("domain_hits"), F.lit(2))).withColumn("tier", F.coalesce("tier", F.lit(10**6)))
    return rows.withColumn("rank_pos", F.row_number().over(Window.partitionBy("profile_id").orderBy(*rank_columns(key))))


def split_by_rank(rank: Column, content: int, reserve: int) -> Column:
    return F.when(rank <= content, "content").when(rank <= content + reserve, "reserve").otherwise("title_only")


def simple_rank(papers: DataFrame, limit: int, key: str = "paper_key") -> DataFrame:
    """Citations, then year, both descending with unknown as 0."""
    return papers.orderBy(F.desc(F.coalesce("citation_count", F.lit(0))), F.desc(F.coalesce("year", F.lit(0))), key).limit(limit)


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def fair_round_robin(df: DataFrame, group: str, order: list, cap: int) -> DataFrame:
    """The first of every group, then the second of every group, and so on up to the cap."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).orderBy("turn", group).limit(cap)
