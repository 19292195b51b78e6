"""Observation analytics. Entities are rolled up before anything is counted, and unknown is never counted as zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rollup_entities(obs: DataFrame, key: str, seeds: str, sources: str, eligible: str = "eligible", content: str = "content") -> DataFrame:
    """One row an entity: the sets of its seeds and sources, and whether it was ever eligible or content."""
    return obs.groupBy(key).agg(F.collect_set(seeds).alias("seeds"), F.collect_set(sources).alias("sources"), F.bool_or(eligible).alias("eligible"), F.bool_or(content).alias("content"))


def seed_yield(entities: DataFrame, other_source: str) -> DataFrame:
    """Per seed: entities returned, those only this seed found and ``other_source`` did not, eligible ones, content ones."""
    e = entities.withColumn("alone", (F.size("seeds") == 1) & ~F.array_contains("sources", other_source))
    return e.select(F.explode("seeds").alias("seed"), "alone", "eligible", "content").groupBy("seed").agg(
        F.count("*").alias("returned"), F.count_if("alone").alias("only_here"), F.count_if("eligible").alias("n_eligible"), F.count_if("content").alias("n_content")
    )


def source_contribution(entities: DataFrame) -> DataFrame:
    return entities.select(F.explode("sources").alias("source"), (F.size("sources") == 1).alias("alone"), "eligible").groupBy("source").agg(
        F.count("*").alias("papers"), F.count_if("alone").alias("only_here"), F.count_if("eligible").alias("n_eligible")
    )


def seed_attempts(runs: DataFrame, json_col: str = "seed_attempts") -> DataFrame:
    """Attempts per seed and status from JSON; unreadable JSON counts as no attempt."""
    kind = "array<struct<keyword:string,status:string,returned:int>>"
    a = runs.select(F.explode(F.from_json(json_col, kind)).alias("a")).select("a.*")
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("done", "partial", "failed", "not_attempted")]
    return a.groupBy("keyword").agg(*counts, F.sum("returned").alias("returned"))


def scan_health(scans: DataFrame, deferred: str = "deferred:") -> DataFrame:
    """Per profile: scans, those whose observations were kept, failed, left incomplete, and put off to a later attempt.

    A scan that was put off holds an error that starts with ``deferred``; it is no failure. An empty error is none.
    """
    error = F.coalesce(F.col("observation_error"), F.lit(""))
    return scans.groupBy("profile_id").agg(
        F.count("*").alias("scans"), F.count("observations").alias("observed"), F.count_if((error != "") & ~error.startswith(deferred)).alias("failed"),
        F.count_if(F.col("observations").isNull() & (error == "")).alias("incomplete"), F.count_if(error.startswith(deferred)).alias("deferred"),
    )


def nearest_rank(values: Column, n: Column, share: float) -> Column:
    """values[int(n * share)] of sorted values, counted from 0 and at most the last."""
    return F.element_at(values, F.least(n, F.floor(n * share) + 1).cast("int"))


def latency(rows: DataFrame, group: str, delay: str) -> DataFrame:
    """n, median, nearest-rank p90, min and max of known delays per group and for all; unknown delays are counted apart.

    Delays are counted per value first, so quantiles come from running counts over distinct delays and no group is
    collected.
    """
    every = rows.select(F.explode(F.array(F.col(group).cast("string"), F.lit("all"))).alias("grp"), F.col(delay).alias("d"))
    h = every.where("d is not null").groupBy("grp", "d").agg(F.count("*").alias("m"))
    w = Window.partitionBy("grp")
    h = h.withColumn("hi", F.sum("m").over(w.orderBy("d"))).withColumn("n", F.sum("m").over(w)).withColumn("lo", F.col("hi") - F.col("m"))
    at = lambda k: F.max(F.when((F.col("lo") <= k) & (k < F.col("hi")), F.col("d")))
    mid_lo, mid_hi, p = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2), F.least(F.col("n") - 1, F.floor(F.col("n") * 0.9))
    q = h.groupBy("grp").agg(F.max("n").alias("n"), ((at(mid_lo) + at(mid_hi)) / 2).alias("median"), at(p).alias("p90"), F.min("d").alias("least"), F.max("d").alias("most"))
    unknown = every.groupBy("grp").agg(F.count_if(F.col("d").isNull()).alias("unknown"))
    return unknown.join(q, "grp", "left").select("grp", F.coalesce("n", F.lit(0)).alias("n"), "median", "p90", "least", "most", "unknown")


def hit_ratios(judged: DataFrame, group: str) -> DataFrame:
    hit = F.size("core_hits") > 0
    return judged.groupBy(group).agg(F.count("*").alias("n"), F.avg(hit.cast("int")).alias("hit_ratio"), F.avg(F.col("eligible").cast("int")).alias("eligible_ratio"), F.avg((F.size("exclude_hits") > 0).cast("int")).alias("excluded_ratio"))


def precision_at_k(ranked: DataFrame, labels: DataFrame, k: int, key: str = "doc_id", by: str = "profile_id", label: str = "relevant") -> DataFrame:
    """Precision@k, recall, noise and judged share; what nobody judged is in no denominator."""
    y = labels.select(key, F.col(label).alias("_y"))
    good, judged = F.col("_y") == 1, F.col("_y").isNotNull()
    # only the first k of each group are ranked; recall's denominator needs no rank
    top = ranked.where(F.col("rank_pos") <= k).select(key, by).join(y, key, "left")
    top = top.groupBy(by).agg(F.count_if(good).alias("_good"), F.count_if(F.col("_y") == 0).alias("_bad"), F.count_if(judged).alias("_judged"), F.count("*").alias("_n"))
    all_good = ranked.select(key, by).join(y.where(good), key, "left").groupBy(by).agg(F.count("_y").alias("_all"))
    return top.join(all_good, by).select(
        by, F.try_divide("_good", "_judged").alias("precision_at_k"), F.try_divide("_good", "_all").alias("recall"), F.try_divide("_bad", "_judged").alias("noise"), F.try_divide("_judged", "_n").alias("judged"),
    )


def named_counts(df: DataFrame, cols: list[str], empty: str = "unknown") -> DataFrame:
    """Counts by one or more columns, null under a name of its own."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(empty)).alias(c) for c in cols]
    return df.groupBy(*named).agg(F.count("*").alias("n"))


def prolific(df: DataFrame, array_col: str, key: str, least: int = 2, top: int = 10) -> DataFrame:
    """Array members (authors) in at least ``least`` entities, the ``top`` of them."""
    e = df.select(key, F.explode(F.array_distinct(array_col)).alias("name"))
    return e.groupBy("name").agg(F.countDistinct(key).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "name").limit(top)


def source_mix(df: DataFrame, key_col: str) -> DataFrame:
    kind = F.when(F.col(key_col).startswith("doi:"), "doi").when(F.col(key_col).startswith("title:"), "title").otherwise("id")
    return df.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def partial_coverage(df: DataFrame, ratio: str = "coverage_ratio", least: float = 0.999) -> DataFrame:
    """Measured ratios under the bound, lowest first; unmeasured rows are not listed."""
    return df.where(F.col(ratio).isNotNull() & (F.col(ratio) < least)).orderBy(ratio)


def window_movement(events: DataFrame, key: str, entity: str, ts: str, start: str, days: int = 7) -> DataFrame:
    """Distinct entities per key in the window and the one before, ``comparable`` only if both windows hold rows.

    Without rows in the window before, ``delta`` is null: no growth is reported.
    """
    s = F.lit(start).cast("timestamp")
    e = events.where((F.col(ts) >= s - F.make_dt_interval(days=F.lit(days))) & (F.col(ts) < s + F.make_dt_interval(days=F.lit(days))))
    now = F.col(ts) >= s
    per = e.groupBy(key).agg(F.countDistinct(F.when(now, F.col(entity))).alias("n_now"), F.countDistinct(F.when(~now, F.col(entity))).alias("n_before"))
    cover = e.agg(F.countDistinct(F.when(now, F.to_date(ts))).alias("days_now"), F.countDistinct(F.when(~now, F.to_date(ts))).alias("days_before"))
    out = per.crossJoin(F.broadcast(cover))  # one row
    ok = (F.col("days_now") > 0) & (F.col("days_before") > 0)
    return out.withColumn("comparable", ok).withColumn("delta", F.when(ok, F.col("n_now") - F.col("n_before")))


def metering(calls: DataFrame, *cols: str) -> DataFrame:
    """Counts for every combination of the columns and all their totals; ``level`` tells totals from nulls."""
    return calls.cube(*cols).agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def calendar_rollup(df: DataFrame, day: Column) -> DataFrame:
    """Counts by day, by month, and in all."""
    d = df.select(F.date_format(day, "yyyy-MM").alias("month"), day.cast("date").alias("day"))
    return d.rollup("month", "day").agg(F.count("*").alias("n"))


def capture_funnel(items: DataFrame) -> DataFrame:
    return items.agg(*[F.count_if(F.col(c)).alias(c) for c in ("evaluable", "retrieved", "core_hit", "delivered")])


def ledger_counters(issues: DataFrame) -> DataFrame:
    return issues.groupBy("profile_id").agg(
        F.count_if(F.col("status") == "sent").alias("sent"), F.sum(F.when(F.col("status") == "sent", F.col("n_items"))).alias("papers"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.max("sent_at").alias("last_at"), F.max_by("status", "sent_at").alias("last_status"),
    )


def watchlist(evidence: DataFrame, axis: str, week: str, this_week: str) -> DataFrame:
    """First and last week of an axis, its total and new entities, and active, quiet or new."""
    w = evidence.groupBy(axis).agg(F.min(week).alias("first_week"), F.max(week).alias("last_week"), F.countDistinct("paper_key").alias("total"), F.countDistinct(F.when(F.col(week) == this_week, F.col("paper_key"))).alias("this_week"))
    return w.withColumn("status", F.when(F.col("first_week") == this_week, "new").when(F.col("this_week") > 0, "active").otherwise("quiet"))


def hit_alone(obs: DataFrame, key: str, hits: str, least: int = 3) -> DataFrame:
    """Keywords that were an entity's only hit at least ``least`` times, with their first entities as samples."""
    one = obs.where(F.size(hits) == 1).select(key, F.element_at(hits, 1).alias("keyword")).distinct()
    r = one.withColumn("_k", F.row_number().over(Window.partitionBy("keyword").orderBy(key)))
    return r.groupBy("keyword").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_k") <= 3, F.col(key)))).alias("samples")).where(F.col("n") >= least)


def next_cursor(runs: DataFrame, now: Column, lateness_days: int = 5, signatures: DataFrame | None = None, lookback_days: int = 7) -> DataFrame:
    """Where the next scan of each profile and source begins: the end of a finished run, the start of another, never
    later than ``lateness_days`` ago.

    With ``signatures`` (profile_id, signature) a profile whose topics have changed since its last run, or that never ran
    (source null), starts ``lookback_days`` ago; a run or a profile without a signature says nothing of a change.
    """
    back = lambda days: now - F.make_dt_interval(days=F.lit(days))
    last = runs.groupBy("profile_id", "source").agg(F.max_by(F.struct("status", "window_from", "window_to", "topic_signature"), "started_at").alias("r"))
    since = F.least(F.when(F.col("r.status") == "done", F.col("r.window_to")).otherwise(F.col("r.window_from")), back(lateness_days))
    if signatures is not None:
        last = last.join(signatures, "profile_id", "full_outer")
        changed = (F.col("signature") != "") & (F.col("r.topic_signature") != "") & (F.col("signature") != F.col("r.topic_signature"))
        since = F.when(F.coalesce(changed, F.lit(False)) | F.col("r").isNull(), back(lookback_days)).otherwise(since)
    return last.select("profile_id", "source", since.alias("since"), F.col("r.topic_signature").alias("topic_signature"))


def seed_states(wanted: DataFrame, attempts: DataFrame, found: DataFrame, seed: str = "seed") -> DataFrame:
    """Per wanted seed: done, partial, failed or not_attempted over its attempts (status), and the rows it returned.

    One attempt that is not done among others makes a seed partial; only failures make it failed.
    """
    done, failed = F.count_if(F.col("status") == "done"), F.count_if(F.col("status") == "failed")
    a = attempts.groupBy(seed).agg(F.when(done == F.count("*"), "done").when(failed == F.count("*"), "failed").otherwise("partial").alias("status"))
    n = found.groupBy(seed).agg(F.count("*").alias("returned"))
    j = wanted.select(seed).distinct().join(a, seed, "left").join(n, seed, "left")
    return j.select(seed, F.coalesce("status", F.lit("not_attempted")).alias("status"), F.coalesce("returned", F.lit(0)).alias("returned"))


def topic_signature(keywords: Column) -> Column:
    return F.substring(F.sha2(F.array_join(F.array_sort(F.array_distinct(F.transform(keywords, lambda k: F.lower(F.trim(k))))), "\0"), 256), 1, 16)


def window_scan(df: DataFrame, ts: str, since: str, until: str) -> DataFrame:
    """Rows of a closed time window; rows without a readable time stay."""
    return df.where(F.col(ts).isNull() | F.col(ts).between(F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp")))
