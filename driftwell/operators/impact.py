"""Counterfactuals: what a changed profile would have done, profile health, arms and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions.keys import norm_title
from driftwell.operators.graph import counted, cut


def compare_runs(before: DataFrame, after: DataFrame, key: str, k: int) -> DataFrame:
    """(key, change, rank_before, rank_after, entered, left) of two judged and ranked versions of the same documents."""
    a = before.select(key, F.col("eligible").alias("_e1"), F.col("rank_pos").alias("rank_before"))
    b = after.select(key, F.col("eligible").alias("_e2"), F.col("rank_pos").alias("rank_after"), F.col("filter_reason").alias("reason_after"))
    j = a.join(b, key, "full_outer").na.fill(False, ["_e1", "_e2"])
    top = lambda c: F.coalesce(F.col(c) <= k, F.lit(False))
    change = F.when(F.col("_e2") & ~F.col("_e1"), "gained").when(F.col("_e1") & ~F.col("_e2"), "lost").otherwise("same")
    return j.select(key, change.alias("change"), "rank_before", "rank_after", "reason_after", (top("rank_after") & ~top("rank_before")).alias("entered"), (top("rank_before") & ~top("rank_after")).alias("left"), (F.col("_e1") | F.col("_e2")).alias("seen"))


def impact_summary(diff: DataFrame) -> DataFrame:
    return diff.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("gained", "lost")], F.count_if("entered").alias("entered"), F.count_if("left").alias("left_top"), F.count_if(F.col("rank_before") != F.col("rank_after")).alias("moved"))


def arm_difference(a: DataFrame, b: DataFrame, key: str, k: int) -> DataFrame:
    """Sizes of the differences of two result sets and their top-k overlap over the baseline's actual size, null if empty."""
    j = a.select(key, F.col("rank_pos").alias("ra")).join(b.select(key, F.col("rank_pos").alias("rb")), key, "full_outer")
    return j.agg(
        F.count_if(F.col("rb").isNull()).alias("only_a"), F.count_if(F.col("ra").isNull()).alias("only_b"), F.count_if(F.col("ra").isNotNull() & F.col("rb").isNotNull()).alias("both"),
        F.try_divide(F.count_if((F.col("ra") <= k) & (F.col("rb") <= k)), F.count_if(F.col("ra") <= k)).alias("top_overlap"),
    )


def measure_arm(judged: DataFrame, arm: str) -> DataFrame:
    return judged.groupBy(arm).agg(F.count("*").alias("returned"), F.count_if("eligible").alias("n_eligible"), F.count_if(F.col("filter_reason") == "excluded").alias("n_excluded"), F.count_if(F.col("filter_reason") == "no_core_hit").alias("n_no_core"))


def scan_metrics(judged: DataFrame, scan: str, anchors: Column, top: Column) -> DataFrame:
    """Shares of a scan's rows: anchored hits, exclusion collisions, top tier, eligible; null where there is nothing to share."""
    e = F.col("eligible")
    return judged.groupBy(scan).agg(
        F.count("*").alias("rows"), F.try_divide(F.count_if(e & F.arrays_overlap("core_hits", anchors)), F.count_if(e)).alias("anchor_share"),
        F.try_divide(F.count_if((F.size("core_hits") > 0) & (F.size("exclude_hits") > 0)), F.count_if(F.size("core_hits") > 0)).alias("exclude_collision"),
        F.try_divide(F.count_if(e & top), F.count_if(e)).alias("top_share"), F.try_divide(F.count_if(e), F.count("*")).alias("eligible_share"),
    )


def seed_noise(judged: DataFrame, seeds: str = "seeds") -> DataFrame:
    """Per seed of an arm: rows returned, eligible, and noise (excluded or without a core hit)."""
    e = judged.select(F.explode(F.array_distinct(seeds)).alias("seed"), "eligible", "filter_reason")
    return e.groupBy("seed").agg(F.count("*").alias("returned"), F.count_if("eligible").alias("n_eligible"), F.count_if(F.col("filter_reason").isin("excluded", "no_core_hit")).alias("noise"))


def scan_measures(rows: DataFrame, scan: str, anchors: Column, k: int, before: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """What a scan's rows (core_hits, exclude_hits, eligible, rank_pos, tier, day, scan_day) say of its profile's health.

    Core hits outside ``anchors`` were added by the machine. A share of nothing is null. ``retention`` is the share of the
    first k that ``before`` (scan, key, rank_pos under the profile before) ranks among its first k, null without it.
    """
    e, top = F.col("eligible"), F.coalesce(F.col("rank_pos") <= k, F.lit(False))
    anchored, auto = F.arrays_overlap("core_hits", anchors), F.size(F.array_except("core_hits", anchors)) > 0
    newest = rows.where(e).groupBy(scan).agg(F.max("day").alias("_newest"))
    j = rows.join(newest, scan, "left")
    kept = F.lit(None).cast("boolean")
    if before is not None:
        j = j.join(before.where(F.col("rank_pos") <= k).select(scan, key).distinct().withColumn("_kept", F.lit(True)), [scan, key], "left")
        kept = F.coalesce("_kept", F.lit(False))
    share = lambda what, of: F.try_divide(F.count_if(what & of), F.count_if(of))
    delay = F.datediff("scan_day", "day")
    return j.groupBy(scan).agg(
        F.count("*").alias("rows"), F.count_if(e).alias("n_eligible"), F.count_if(top).alias("n_top"), share(anchored, top).alias("anchor_share_top"), share(anchored, e).alias("anchor_share_eligible"),
        share(F.size("exclude_hits") > 0, auto).alias("exclude_collision_auto"), share(F.col("tier") == 0, top).alias("top_tier_share"), F.count_if(e & auto & ~anchored).alias("new_from_auto"),
        share(F.coalesce(F.col("day") == F.col("_newest"), F.lit(False)), top & F.col("_newest").isNotNull()).alias("freshness"), F.avg(F.when(top, delay)).alias("mean_delay_days"),
        (share(kept, top) if before is not None else F.lit(None).cast("double")).alias("retention"),
    )


def keyword_hits(rows: DataFrame, scan: str, keywords: DataFrame) -> DataFrame:
    """Rows of each scan that a core keyword hits, zeros included: keywords whose zeros go on may be dropped."""
    n = rows.select(scan, F.explode(F.array_distinct("core_hits")).alias("keyword")).groupBy(scan, "keyword").agg(F.count("*").alias("n"))
    every = rows.select(scan).distinct().crossJoin(F.broadcast(keywords.select("keyword").distinct()))  # a profile's stated keywords
    return every.join(n, [scan, "keyword"], "left").na.fill(0, ["n"])


def health_verdict(series: DataFrame, period: str, metric: str, least: int = 3, drop: float = 0.1) -> DataFrame:
    """Median of a metric per period against the period before: insufficient, worse, better or steady."""
    m = series.groupBy(period).agg(F.median(metric).alias("value"), F.count(metric).alias("n"))
    w = Window.orderBy(period)  # one row a period
    m = m.withColumn("before", F.lag("value").over(w)).withColumn("n_before", F.lag("n").over(w))
    few = (F.col("n") < least) | F.coalesce(F.col("n_before") < least, F.lit(True))
    d = F.col("value") - F.col("before")
    return m.withColumn("verdict", F.when(few, "insufficient").when(d <= -drop, "worse").when(d >= drop, "better").otherwise("steady"))


def gate(metrics: DataFrame, rules: dict[str, tuple[Column, str]]) -> DataFrame:
    """Decision and all reasons: a rule is (condition to hold, status if it does not); an unmeasured condition never passes.

    The status is the worst of the broken rules in the order invalid, needs_search, insufficient, held; eligible if none is.
    """
    order = ["invalid", "needs_search", "insufficient", "held"]
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"{st}:{name}")) for name, (ok, st) in rules.items()]))
    out = metrics.withColumn("reasons", reasons)
    status = None
    for st in order:
        cond = F.exists("reasons", _starts(st))
        status = F.when(cond, st) if status is None else status.when(cond, st)
    return out.withColumn("decision", status.otherwise("eligible"))


def _starts(status: str):
    return lambda r: r.startswith(f"{status}:")


def gap_stage(items: DataFrame, scans: DataFrame, obs: DataFrame, delivered: DataFrame, runs: DataFrame) -> DataFrame:
    """Adds ``gap_stage``: how far an item that was found elsewhere had come here by the time of its discovery.

    ``items`` has item_id, profile_id, discovered_at, published (text, of any precision), title and ``keys``, all keys that
    the item may bear. ``scans`` (profile_id, started_at), ``obs`` (profile_id, paper_key, title, outcome, filter_reason,
    observed_at), ``delivered`` (profile_id, paper_key, sent_at) and ``runs`` (profile_id, started_at, window_from) are read
    up to that time only. Without a scan, or published after the last one, an item is not_yet_evaluable. Delivered ones
    are captured. The last observation decides, by key, else by an equal normalised title: not_delivered, ranked_out,
    excluded, no_core_hit. Without one, what is older than the earliest window is before_monitoring, what has no exact day
    not_yet_evaluable, the rest not_retrieved.
    """
    at = F.col("discovered_at")
    i = items.select("item_id", "profile_id", "discovered_at", "published", "title", "keys")
    scan = i.join(scans.select("profile_id", F.col("started_at").alias("_s")), "profile_id").where(F.col("_s") <= at).groupBy("item_id").agg(F.max("_s").alias("_scan"))
    start = i.join(runs.select("profile_id", F.col("started_at").alias("_r"), "window_from"), "profile_id").where(F.col("_r") <= at).groupBy("item_id").agg(F.min("window_from").alias("_from"))
    keyed = i.select("item_id", "profile_id", "discovered_at", F.explode(F.array_distinct("keys")).alias("paper_key"))
    sent = keyed.join(delivered.select("profile_id", "paper_key", "sent_at"), ["profile_id", "paper_key"]).where(F.col("sent_at") <= at).select("item_id").distinct().withColumn("_sent", F.lit(True))
    last = lambda d: d.where(F.col("observed_at") <= at).groupBy("item_id").agg(F.max_by(F.struct("outcome", "filter_reason"), F.struct("observed_at", "outcome", "filter_reason")).alias("o"))
    by_key = last(keyed.join(obs.select("profile_id", "paper_key", "outcome", "filter_reason", "observed_at"), ["profile_id", "paper_key"])).withColumnRenamed("o", "_key")
    named = i.select("item_id", "profile_id", "discovered_at", norm_title(F.col("title")).alias("_t")).where(F.col("_t").rlike("[a-z0-9]{5}"))
    by_title = last(named.join(obs.select("profile_id", norm_title(F.col("title")).alias("_t"), "outcome", "filter_reason", "observed_at"), ["profile_id", "_t"])).withColumnRenamed("o", "_title")
    j = items
    for side in (scan, start, sent, by_key, by_title):
        j = j.join(side, "item_id", "left")
    pub, o = F.substring(F.coalesce("published", F.lit("")), 1, 10), F.coalesce("_key", "_title")
    day, month = F.length(pub) == 10, F.length(pub) == 7
    iso = lambda c, f: F.date_format(c, f)
    stage = (
        F.when(F.col("_scan").isNull() | (day & (pub > iso("_scan", "yyyy-MM-dd"))), "not_yet_evaluable").when(F.col("_sent"), "captured")
        .when(o.isNull() & ((day & (pub < iso("_from", "yyyy-MM-dd"))) | (month & (pub < iso("_from", "yyyy-MM")))), "before_monitoring").when(o.isNull() & (F.col("_from").isNull() | ~day), "not_yet_evaluable").when(o.isNull(), "not_retrieved")
        .when(o["outcome"].isin("content", "title_only") | ((o["outcome"] == "filtered") & (o["filter_reason"] == "already_shown")), "not_delivered")
        .when((o["outcome"] == "reserve") | ((o["outcome"] == "dropped") & o["filter_reason"].isNull()), "ranked_out").when(o["filter_reason"] == "exclude_hit", "excluded").otherwise("no_core_hit")
    )
    return j.withColumn("gap_stage", stage).drop("_scan", "_from", "_sent", "_key", "_title")


def profile_impact(before: DataFrame, after: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """Everything that moves between two score runs of the same documents, one row a fact: (part, name, value, n).

    Runs have the key, source, precision (of the publication day), core_hits, exclude_hits, eligible, rank_pos, tier and
    top_weight. Parts: ``count`` (eligible before and after, gained, entered, left), ``lost`` by reason, ``rank_move`` and
    ``weight_move`` of documents, ``exclude_risk`` (newly hit documents that an exclusion takes; null where none is newly
    hit), ``added_term`` (documents that a new core term hits, none hidden in the total), ``admitted_by`` (gained documents
    by the term that let them in: the heaviest of their hits, first in order on ties) and ``source_precision`` (entered, left
    and stayed of the first k by source and precision). ``value`` is null for plain counts.
    """
    cols = ["source", "precision", "core_hits", "exclude_hits", "eligible", "rank_pos", "tier", "top_weight"]
    side = lambda d, n: d.select(key, *[F.col(c).alias(f"{c}_{n}") for c in cols])
    j = side(before, "a").join(side(after, "b"), key, "full_outer").na.fill(False, ["eligible_a", "eligible_b"])
    top = lambda n: F.coalesce(F.col(f"eligible_{n}") & (F.col(f"rank_pos_{n}") <= k), F.lit(False))
    hit = lambda n: F.coalesce(F.size(f"core_hits_{n}") > 0, F.lit(False))
    j = cut(j.withColumn("_in_a", top("a")).withColumn("_in_b", top("b")).withColumn("_new", hit("b") & ~hit("a")).withColumn("_gained", F.col("eligible_b") & ~F.col("eligible_a")))
    no = F.lit(None).cast("double")
    fact = lambda d, part, name, value, n: d.select(F.lit(part).alias("part"), name.cast("string").alias("name"), value.cast("double").alias("value"), n.cast("long").alias("n"))
    named = {"eligible_before": F.col("eligible_a"), "eligible_after": F.col("eligible_b"), "gained": F.col("_gained"), "entered": F.col("_in_b") & ~F.col("_in_a"), "left": F.col("_in_a") & ~F.col("_in_b"), "newly_hit": F.col("_new")}
    total = j.agg(*[F.count_if(c).alias(n) for n, c in named.items()], F.count_if(F.col("_new") & F.coalesce(F.size("exclude_hits_b") > 0, F.lit(False))).alias("_risky"))
    stacked = total.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in named])).alias("x")).select("x.name", "x.n")
    lost = j.where("eligible_a and not eligible_b").groupBy(F.when(F.coalesce(F.size("exclude_hits_b") > 0, F.lit(False)), "exclude_hit").otherwise("no_core_hit").alias("name")).agg(F.count("*").alias("n"))
    moved = j.where("(_in_a or _in_b) and not rank_pos_a <=> rank_pos_b")
    weighed = j.where("eligible_a and eligible_b and (top_weight_a <> top_weight_b or tier_a <> tier_b)")
    terms = lambda d, n: d.select(key, F.explode(F.array_distinct(f"core_hits_{n}")).alias("name"))
    known = terms(j, "a").select("name").distinct()
    added = terms(j, "b").join(known, "name", "left_anti").groupBy("name").agg(F.count("*").alias("n"))
    admitted = j.where("_gained").groupBy(F.col("core_hits_b")[0].alias("name")).agg(F.count("*").alias("n"))
    cell = F.concat_ws("|", F.coalesce("source_b", "source_a"), F.coalesce("precision_b", "precision_a"), F.when(F.col("_in_a") & F.col("_in_b"), "stayed").when(F.col("_in_b"), "entered").otherwise("left"))
    cross = j.where("_in_a or _in_b").groupBy(cell.alias("name")).agg(F.count("*").alias("n"))
    parts = [
        fact(stacked, "count", F.col("name"), no, F.col("n")), fact(lost, "lost", F.col("name"), no, F.col("n")), fact(moved, "rank_move", F.col(key), F.col("rank_pos_b") - F.col("rank_pos_a"), F.col("rank_pos_b")),
        fact(weighed, "weight_move", F.col(key), F.col("top_weight_b") - F.col("top_weight_a"), F.col("tier_b")), fact(total, "exclude_risk", F.lit("rate"), F.try_divide(F.col("_risky"), F.col("newly_hit")), F.col("_risky")),
        fact(added, "added_term", F.col("name"), no, F.col("n")), fact(admitted, "admitted_by", F.col("name"), no, F.col("n")), fact(cross, "source_precision", F.col("name"), no, F.col("n")),
    ]
    out = parts[0]
    for p_ in parts[1:]:
        out = out.unionByName(p_)
    return out


def bind_experiment(analysis: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Analyses bound to an arm run only where every key agrees; else the names of the keys that differ."""
    r = runs.select("run_id", *[F.col(k).alias(f"_{k}") for k in keys])
    j = analysis.join(r, "run_id", "left")
    bad = F.array_compact(F.array(*[F.when(~F.col(k).eqNullSafe(F.col(f"_{k}")), F.lit(k)) for k in keys]))
    return j.withColumn("mismatch", bad).withColumn("bound", F.size("mismatch") == 0).drop(*[f"_{k}" for k in keys])


def shared_references(refs: DataFrame, paper: str = "paper_id", ref: str = "ref_id", least: int = 2, top: int = 20) -> DataFrame:
    """The references that most papers share; papers dealt out by their id are made distinct where they lie."""
    each = refs.select(paper, ref).distinct()
    return each.groupBy(ref).agg(F.count(paper).alias("shared")).where(F.col("shared") >= least).orderBy(F.desc("shared"), ref).limit(top)


#: Largest set of references that travels with each of its rarest ones.
WIDE = 64


def reference_similarity(refs: DataFrame, paper: str, ref: str, least: float = 0.15) -> DataFrame:
    """Pairs of papers whose reference sets' Jaccard is at least ``least``.

    A pair shares ``least`` of either set at least, so it shares one of the rarest n - ceil(least n) + 1 references of both:
    only these meet, and frequent references pair nobody unless a set holds little else. Pairs of fitting sizes are then
    compared on their whole sets. Sets of up to WIDE references travel with their rarest ones, so a pair is compared where
    it meets and counts at the rarest reference that it shares; only pairs with a larger set move to be compared.
    """
    r = refs.select(paper, ref).where(F.col(paper).isNotNull() & F.col(ref).isNotNull()).distinct()
    rare = r.groupBy(ref).agg(F.count("*").alias("_df"))
    sets = r.join(rare, ref).groupBy(paper).agg(F.array_sort(F.collect_list(F.struct("_df", ref))).alias("_s"))
    sets, wide = counted(sets.select(paper, F.transform("_s", lambda x: x[ref]).alias("_s"), F.size("_s").alias("_n")), F.size("_s") > WIDE)
    most = F.col("_n") - F.ceil(F.col("_n") * least - 1e-9) + 1
    p = sets.select(paper, "_n", F.when(F.col("_n") <= WIDE, F.col("_s")).alias("_s"), F.explode(F.slice("_s", F.lit(1), most.cast("int"))).alias("_r"))
    side = lambda df, c: df.select(F.col(paper).alias(c), F.col("_n").alias(f"_n{c}"), F.col("_s").alias(f"_s{c}"), "_r")
    fits = (F.col("a") < F.col("b")) & (F.least("_na", "_nb") >= F.greatest("_na", "_nb") * least - 1e-9)
    shared = F.array_intersect("_sa", "_sb")
    similarity = F.col("_both") / (F.col("_na") + F.col("_nb") - F.col("_both"))
    narrow = p.where(F.col("_n") <= WIDE)
    met = side(narrow, "a").join(side(narrow, "b"), "_r").where(fits).withColumn("_shared", shared).where(F.get("_shared", F.lit(0)) == F.col("_r"))
    out = met.select("a", "b", "_na", "_nb", F.size("_shared").alias("_both"))
    if wide:
        met = side(p, "a").join(side(p, "b"), "_r").where(fits & (F.greatest("_na", "_nb") > WIDE)).select("a", "b", "_na", "_nb").distinct()
        met = met.join(sets.select(F.col(paper).alias("a"), F.col("_s").alias("_sa")), "a").join(sets.select(F.col(paper).alias("b"), F.col("_s").alias("_sb")), "b")
        out = out.unionByName(met.select("a", "b", "_na", "_nb", F.size(shared).alias("_both")))
    return out.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= least)


def frontier(cites: DataFrame, seeds: DataFrame, since_year: int, top: int = 10) -> DataFrame:
    """Recent papers by how many of the seeds they cite."""
    return cites.join(seeds, "ref_id").where(F.col("year") >= since_year).groupBy("paper_id").agg(F.countDistinct("ref_id").alias("n")).orderBy(F.desc("n"), "paper_id").limit(top)


def thread_chains(nodes: DataFrame, components: DataFrame, least_days: int = 3) -> DataFrame:
    j = nodes.join(components.withColumnRenamed("node", "thread_id"), "thread_id")
    return j.groupBy("component").agg(F.countDistinct("day").alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day")).where(F.col("days") >= least_days)
