"""Reader reactions: event states, tallies and keyword weights learned from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.operators.asof import latest_per_key

BURST_S, PREFETCH_S, BUTTONS = 30, 120, 3
HALF_LIFE_DAYS, PRIOR, STEP, DEAD_ZONE, LOW, HIGH = 90, 4, 0.1, 0.005, 0.35, 2.0


def reaction_states(events: DataFrame, tokens: DataFrame, undo: str = "undo") -> DataFrame:
    """Events with their final status: expired, unknown, undo, prefetch, burst, cancelled, duplicate or valid.

    Rows that repeat a token and time count once, the others are duplicates. Pressing all buttons of a token within BURST_S
    seconds marks all of those presses; an undo cancels the token's earlier valid presses.
    """
    w = Window.partitionBy("tid", "action", "received_at").orderBy("event_id")
    e = events.withColumn("_dup", F.row_number().over(w) > 1).join(tokens.select("tid", "delivered_at", "expires_at"), "tid", "left")
    secs = F.col("received_at").cast("double") - F.col("delivered_at").cast("double")
    first = (
        F.when(F.col("_dup"), "duplicate").when(F.col("received_at") > F.col("expires_at"), "expired").when(F.col("expires_at").isNull(), "unknown")
        .when(F.col("action") == undo, "undo").when((secs >= 0) & (secs < PREFETCH_S), "prefetch").otherwise("valid")
    )
    e = e.withColumn("_first", first)
    near = Window.partitionBy("tid").orderBy(F.unix_micros("received_at"))
    press = F.when(F.col("_first").isin("valid", "prefetch"), F.col("action"))
    own = F.when(F.col("_first") == "valid", F.size(F.collect_set(press).over(near.rangeBetween(-BURST_S * 1_000_000, 0))) >= BUTTONS)
    e = e.withColumn("_closes", F.coalesce(own, F.lit(False)))
    burst = F.max("_closes").over(near.rangeBetween(0, BURST_S * 1_000_000))
    later_undo = F.max(F.when(F.col("_first") == "undo", F.col("received_at"))).over(Window.partitionBy("tid"))
    e = e.withColumn("_burst", burst).withColumn("_undo", later_undo)
    status = F.when(F.col("_first").isin("valid", "prefetch") & F.col("_burst"), "burst").when((F.col("_first") == "valid") & (F.col("_undo") >= F.col("received_at")), "cancelled").otherwise(F.col("_first"))
    return e.withColumn("status", status).select(*events.columns, "status")


def latest_reactions(events: DataFrame, keys: list[str]) -> DataFrame:
    """The last valid reaction of each reader on each item; ties by action."""
    return latest_per_key(events.where("status = 'valid'"), keys, ["received_at", "action"])


def tallies(latest: DataFrame, by: str, actions: list[str]) -> DataFrame:
    return latest.groupBy(by).agg(*[F.count_if(F.col("action") == a).alias(f"n_{a}") for a in actions], F.count("*").alias("n"))


def weight_update(reactions: DataFrame, weights: DataFrame, as_of: Column, entity: str = "paper_key") -> DataFrame:
    """New weights from (entity, action sign +1 or -1, at, hits array): keyword, pos, neg, papers, target, weight_after.

    A reaction is shared among its hits and halves every HALF_LIFE_DAYS; a keyword needs two different entities; the step is
    clamped, and changes under DEAD_ZONE do not count.
    """
    age = F.datediff(as_of, F.to_date("at"))
    share = F.pow(F.lit(0.5), F.greatest(age, F.lit(0)) / HALF_LIFE_DAYS) / F.size("hits")
    e = reactions.where(F.size("hits") > 0).select(entity, "sign", share.alias("s"), F.explode("hits").alias("keyword"))
    g = e.groupBy("keyword").agg(F.sum(F.when(F.col("sign") > 0, F.col("s")).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("sign") < 0, F.col("s")).otherwise(0.0)).alias("neg"), F.countDistinct(entity).alias("papers"))
    signal = (F.col("pos") - F.col("neg")) / (F.col("pos") + F.col("neg") + PRIOR)
    j = weights.join(g, "keyword")
    target = F.least(F.greatest(F.col("base_weight") * (1 + signal), F.lit(LOW)), F.lit(HIGH))
    step = F.least(F.greatest(target - F.col("weight"), F.lit(-STEP)), F.lit(STEP))
    after = F.when((F.col("papers") >= 2) & (F.abs(step) >= DEAD_ZONE), F.col("weight") + step).otherwise(F.col("weight"))
    return j.withColumn("target", target).withColumn("weight_after", after)


def keyword_table(hits: DataFrame, reactions: DataFrame, history: DataFrame, since: Column, entity: str = "paper_key") -> DataFrame:
    """Distinct hits since a time, reactions and the weights over time of every keyword."""
    recent = hits.where(F.col("at") >= since).groupBy("keyword").agg(F.countDistinct(entity).alias("recent_hits"))
    react = reactions.select(F.explode("hits").alias("keyword"), "sign").groupBy("keyword").agg(F.count_if(F.col("sign") > 0).alias("n_pos"), F.count_if(F.col("sign") < 0).alias("n_neg"))
    past = history.groupBy("keyword").agg(F.array_sort(F.collect_list(F.struct("revision", "weight"))).alias("weights"))
    return past.join(recent, "keyword", "left").join(react, "keyword", "left")


def reaction_log(reactions: DataFrame, items: DataFrame, titles: DataFrame) -> DataFrame:
    """Reactions with the title of the issue's item, else the delivered title, else the key."""
    j = reactions.join(items.select("issue_id", "paper_key", F.col("title").alias("_a")), ["issue_id", "paper_key"], "left").join(titles.select("paper_key", F.col("title").alias("_b")), "paper_key", "left")
    return j.withColumn("title", F.coalesce("_a", "_b", F.col("paper_key").cast("string"))).drop("_a", "_b")
