"""Evidence: what may be said of an item, which of its records counts, and what was sent about it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions.keys import local_day, norm_title
from driftwell.operators.text import ungrounded_numbers


def accept_items(items: DataFrame, excerpts: DataFrame, max_chars: int = 600, assertive: str | None = None, generic: str | None = None) -> DataFrame:
    """Adds ``reason`` to (item_id, owner, text, evidence): null if the item is accepted, else the first rule it breaks.

    An item needs evidence, every cited id must be one of its owner's ``excerpts`` (owner, evidence_id, excerpt), the text
    must not be too long, assertive or generic, and each of its numbers must stand in the excerpts that it cites itself.
    """
    cited = items.select("item_id", "owner", F.explode(F.array_distinct("evidence")).alias("evidence_id")).join(excerpts, ["owner", "evidence_id"], "left")
    cited = cited.groupBy("item_id").agg(F.count_if(F.col("excerpt").isNull()).alias("_foreign"), F.array_join(F.array_sort(F.collect_list("excerpt")), "\n").alias("_cited"))
    says = lambda pattern: F.col("text").rlike(pattern) if pattern else F.lit(False)
    reason = (
        F.when(F.coalesce(F.size("evidence"), F.lit(0)) <= 0, "no_evidence").when(F.col("_foreign") > 0, "foreign_evidence").when(F.length("text") > max_chars, "too_long")
        .when(says(assertive), "assertive").when(says(generic), "generic").when(F.size(ungrounded_numbers(F.col("text"), F.col("_cited"))) > 0, "ungrounded_number")
    )
    return items.join(cited, "item_id", "left").withColumn("reason", reason).drop("_foreign", "_cited")


def result_excerpts(summaries: DataFrame, least_coverage: float = 0.8, limit_chars: int = 600) -> DataFrame:
    """(paper_key, excerpt) of the summaries whose numbers all match and whose measured coverage suffices; ``results``: array of lines."""
    good = summaries.where("numbers_total = numbers_matched and coverage_kind = 'measured'").where(F.col("coverage_ratio") >= least_coverage)
    said = F.array_join(F.filter(F.transform("results", F.trim), lambda x: x != ""), " ")
    return good.select("paper_key", F.substring(said, 1, limit_chars).alias("excerpt")).where("excerpt <> ''")


def performance_evidence(sents: DataFrame, benches: DataFrame, metric: str, value: str, own: str, caption: str, id_col: str = "doc_id", longest: int = 600) -> DataFrame:
    """(doc, bench, sid, sentence): for each benchmark its best sentence that names it, a metric and a value.

    Whole sentences come before captions, those about the paper's own results before others, then the first; broken table
    lines (seven values or more, or a backslash) are no evidence.
    """
    named = F.concat(F.lit(r"(?i)(?:^|[^\w-])"), F.regexp_replace("bench", r"([^A-Za-z0-9\s])", r"\\$1"), F.lit(r"(?:[^\w-]|$)"))
    s = F.col("sentence")
    fit = sents.where((F.length(s) <= longest) & s.rlike(metric) & s.rlike(value) & (F.regexp_count(s, F.lit(value)) < 7) & ~s.contains("\\"))
    found = fit.join(benches, id_col).where(F.regexp_like(s, named))
    order = F.struct(s.rlike(caption).alias("caption"), (~s.rlike(own)).alias("other"), F.col("sid"))
    return found.groupBy(id_col, "bench").agg(F.min_by(F.struct("sid", "sentence"), order).alias("best")).select(id_col, "bench", "best.*")


def newest_of_aliases(items: DataFrame, key: str, at: str, aliases: str = "aliases") -> DataFrame:
    """Items that no newer item shares an alias with: the newest of each of their aliases. Ties in time go to the larger key.

    A newer rejection so hides an older acceptance; filter by verdict afterwards. Items without an alias stay.
    """
    each = items.select(key, at, F.explode_outer(F.array_distinct(aliases)).alias("_alias"))
    newest = each.where("_alias is not null").groupBy("_alias").agg(F.max_by(key, F.struct(at, key)).alias("_newest"))
    stay = each.join(newest, "_alias", "left").groupBy(key).agg(F.bool_and(F.col("_alias").isNull() | (F.col("_newest") == F.col(key))).alias("_stays")).where("_stays")
    return items.join(stay.select(key), key, "left_semi")


def by_id_or_title(items: DataFrame, table: DataFrame, item: str, key: str, title: str, order: str, least: int = 5) -> DataFrame:
    """Adds ``matched`` (a key of ``table``) and ``how``: by equal key, else by equal normalised title with a word of ``least``
    characters or more; of several rows of a title the last in ``order`` counts."""
    word = F.array_max(F.transform(F.split("_t", " "), lambda x: F.length(x))) >= least
    ids = table.select(F.col(key), F.col(key).alias("_id")).where(F.col(key).isNotNull()).distinct()
    titles = table.select(norm_title(F.col(title)).alias("_t"), key, order).groupBy("_t").agg(F.max_by(key, order).alias("_by_title"))
    j = items.withColumn("_t", norm_title(F.col(title))).join(ids, key, "left").join(titles.where(word), "_t", "left")
    how = F.when(F.col("_id").isNotNull(), "id").when(F.col("_by_title").isNotNull(), "title")
    return j.select(item, F.coalesce("_id", "_by_title").alias("matched"), how.alias("how"))


def axis_groups(items: DataFrame, days: int = 183, least: int = 2, missed: tuple = ("not_retrieved", "no_core_hit", "excluded", "ranked_out")) -> DataFrame:
    """(term, papers, missed) from items (item_id, text, axes, aliases, published, observed, gap_stage).

    A term counts an item if it stands in its text and the item was published within ``days`` before it was observed; of
    items that share an alias the first counts.
    """
    fresh = items.where(F.col("published").between(F.date_sub("observed", days), F.col("observed")))
    each = fresh.select("*", F.explode(F.array_distinct("axes")).alias("term"))
    quoted = F.concat(F.lit(r"(?i)(?:^|[^\p{L}\p{N}])\Q"), F.col("term"), F.lit(r"\E(?:[^\p{L}\p{N}]|$)"))
    each = each.where(F.regexp_like("text", quoted))
    first = each.select("term", "item_id", F.explode("aliases").alias("_alias")).groupBy("term", "_alias").agg(F.min("item_id").alias("_first"))
    own = each.select("term", "item_id", "gap_stage", F.explode("aliases").alias("_alias")).join(first, ["term", "_alias"])
    kept = own.groupBy("term", "item_id").agg(F.bool_and(F.col("_first") == F.col("item_id")).alias("ok"), F.first("gap_stage").alias("gap_stage")).where("ok")
    return kept.groupBy("term").agg(F.count("*").alias("papers"), F.count_if(F.col("gap_stage").isin(*missed)).alias("missed")).where(F.col("papers") >= least)


def emerging_axes(groups: DataFrame, hits: DataFrame, candidates: DataFrame, now: Column, days: int = 28, key: str = "doc_id", seen: str = "first_seen") -> DataFrame:
    """The groups with how many candidates that hold the term were first seen in the last ``days`` and in those before, and the totals."""
    age = F.datediff(now, F.col(seen))
    window = candidates.select(key, F.when(age.between(0, days), "recent").when(age.between(days + 1, 2 * days), "previous").alias("_w")).where("_w is not null")
    n = hits.select("term", key).distinct().join(window, key).groupBy("term").agg(F.count_if(F.col("_w") == "recent").alias("recent"), F.count_if(F.col("_w") == "previous").alias("previous"))
    total = lambda w: window.where(F.col("_w") == w).agg(F.count("*")).scalar()
    out = groups.join(n, "term", "left").withColumn("recent", F.coalesce("recent", F.lit(0))).withColumn("previous", F.coalesce("previous", F.lit(0)))
    return out.withColumn("recent_total", total("recent")).withColumn("previous_total", total("previous"))


def attach_verdicts(items: DataFrame, verdicts: DataFrame, key: str, umbrella: list[str]) -> DataFrame:
    """Items with their verdict, ``missing`` where there is none; candidate terms stay if the text holds them and they are no umbrella terms."""
    j = items.join(verdicts.select(key, "verdict"), key, "left").withColumn("verdict", F.coalesce("verdict", F.lit("missing")))
    text = F.lower("text")
    keep = lambda t: text.contains(F.lower(t)) & ~F.lower(t).isin(*umbrella)
    return j.withColumn("candidate_terms", F.filter("candidate_terms", keep))


def reuse_lookup(wanted: DataFrame, checks: DataFrame, keys: list[str], at: str, since: Column) -> DataFrame:
    """The latest finished check of the same keys since a time, null where there is none."""
    done = checks.where(F.col("finished") & (F.col(at) >= since)).groupBy(*keys).agg(F.max_by("check_id", F.struct(at, "check_id")).alias("reused"))
    return wanted.join(done, keys, "left")


def within_daily_cap(checks: DataFrame, at: str, cap: int) -> DataFrame:
    """The first ``cap`` checks of each day."""
    day = F.to_date(at)
    return checks.withColumn("_n", F.row_number().over(Window.partitionBy(day).orderBy(at, "check_id"))).where(F.col("_n") <= cap).drop("_n")


def thread_catalogue(threads: DataFrame, at: str, key: str, last: int) -> DataFrame:
    """The ``last`` threads, newest first, with ids T1, T2 and so on."""
    few = threads.orderBy(F.desc(at), key).limit(last)
    return few.withColumn("thread_no", F.format_string("T%d", F.row_number().over(Window.orderBy(F.desc(at), key))))  # over ``last`` rows


def change_summary(changes: DataFrame, since: Column) -> DataFrame:
    """(keyword, kind, net, actors) of the changes since a time: +1 an addition, -1 a removal; moves that cancel out stay with 0."""
    net = F.sum(F.when(F.col("action") == "added", 1).when(F.col("action") == "removed", -1).otherwise(0))
    return changes.where(F.col("at") >= since).groupBy("keyword", "kind").agg(net.alias("net"), F.array_sort(F.collect_set("actor")).alias("actors"))


def applied_since(reports: DataFrame, since: Column, schema: str = "array<struct<keyword:string,op:string>>") -> DataFrame:
    """One row for each change that a report since a time says it applied (JSON in ``applied``; unreadable JSON has none)."""
    return reports.where(F.col("at") >= since).select("report_id", "at", F.explode(F.from_json("applied", schema)).alias("c")).select("report_id", "at", "c.*")


def pending_reports(reports: DataFrame, now: Column, ttl_days: int) -> DataFrame:
    return reports.where((F.col("status") == "pending") & (F.datediff(now, "at") <= ttl_days))


def catalogue_filter(papers: DataFrame, source: str | None = None, summarized: bool | None = None, days: int | None = None, today: Column | None = None, text: str | None = None) -> DataFrame:
    """The papers of a source, with or without a summary, fetched in the last ``days``, with a text in their title; null asks nothing."""
    out = papers if source is None else papers.where(F.col("source") == source)
    if summarized is not None:
        out = out.where(F.coalesce("summarized", F.lit(False)) == F.lit(summarized))
    if days:
        out = out.where(F.col("fetched") >= F.date_sub(today if today is not None else F.current_date(), days - 1))
    return out if text is None else out.where(F.lower("title").contains(text.lower()))


def new_keyword_results(hits: DataFrame, added: DataFrame, since: Column, id_col: str = "doc_id") -> DataFrame:
    """Documents that today's results have for each keyword added since a time, 0 included."""
    new = added.where(F.col("added_at") >= since).select("profile_id", "keyword").distinct()
    n = hits.groupBy("profile_id", "keyword").agg(F.countDistinct(id_col).alias("n_docs"))
    return new.join(n, ["profile_id", "keyword"], "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))


def assemble_arm(seed_results: DataFrame, query_results: DataFrame, key: str) -> DataFrame:
    """Results of seeds and queries as one set: a key once, with where it came from (sorted)."""
    both = seed_results.select(key, F.lit("seed").alias("via")).unionByName(query_results.select(key, F.lit("query").alias("via")))
    return both.groupBy(key).agg(F.array_sort(F.collect_set("via")).alias("via"))


def reactions_since(exported: DataFrame, cursor: Column) -> DataFrame:
    """Rows (received_at, token) after the cursor, each token once at its first time; the next cursor is the largest received_at."""
    return exported.where(F.col("received_at") > cursor).groupBy("token").agg(F.min("received_at").alias("received_at"))


def evidence_bundle(parts: dict[str, DataFrame], orders: dict[str, list], per_part: int) -> DataFrame:
    """(evidence_id, part, body): the first rows of each part as JSON with an id of their own, M1, M2 and so on by the part's letter."""
    out = None
    for letter, df in parts.items():
        few = df.orderBy(*orders[letter]).limit(per_part)
        n = F.row_number().over(Window.orderBy(*orders[letter]))  # over ``per_part`` rows
        rows = few.select(F.format_string(f"{letter}%d", n).alias("evidence_id"), F.lit(letter).alias("part"), F.to_json(F.struct(*df.columns)).alias("body"))
        out = rows if out is None else out.unionByName(rows)
    return out


def issue_status(total: Column, sent: Column) -> Column:
    return F.when(sent <= 0, "failed").when(sent < total, "partial").otherwise("sent")


def record_issues(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """The ledger with issues of the same id replaced; status comes from the counts of recipients."""
    fresh = new.withColumn("status", issue_status(F.col("recipients_total"), F.col("recipients_sent")))
    return ledger.join(fresh.select("issue_id"), "issue_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def legacy_issues(shown: DataFrame, first_issue: DataFrame, zone: str = "Asia/Seoul") -> DataFrame:
    """Issues rebuilt from what was shown before a profile's first recorded issue: one a profile and local day."""
    before = shown.join(first_issue, "profile_id", "left").where("first_sent is null or shown_at < first_sent")
    day = before.withColumn("day", local_day(F.col("shown_at"), zone))
    out = day.groupBy("profile_id", "day").agg(F.count("*").alias("paper_count"), F.min("shown_at").alias("sent_at"))
    return out.select(F.concat_ws(":", F.lit("legacy"), "profile_id", F.col("day").cast("string")).alias("issue_id"), "profile_id", "day", "paper_count", "sent_at", F.lit("sent").alias("status"))


def replay(obs: DataFrame, scans: DataFrame, cutoff: Column, score: Callable[[DataFrame, DataFrame], DataFrame], policy: str, k: int) -> DataFrame:
    """What the inputs of a past time would rank today, with that time's profile: paper_key, rank_pos, snapshot_policy,
    scored_with, policy_match.

    Inputs are each paper's latest observation before the cutoff, the profile is that of the last scan before it, and the
    order is today's: ``score`` (papers, one scan row) gives rank_pos. Without a scan or observation before the cutoff there
    are no rows. Pass the current profile as the only scan for a rescore.
    """
    from driftwell.operators.asof import latest_per_key

    scan = scans.where(F.col("started_at") < cutoff).orderBy(F.desc("started_at"), F.desc("scan_id")).limit(1)
    papers = latest_per_key(obs.where(F.col("observed_at") < cutoff), ["paper_key"], ["observed_at", "scan_id"])
    ranked = score(papers, scan).where(F.col("rank_pos") <= k)
    snapshot = scan.select("policy").scalar()
    return ranked.select("paper_key", "rank_pos", snapshot.alias("snapshot_policy"), F.lit(policy).alias("scored_with"), (snapshot == policy).alias("policy_match")).where("snapshot_policy is not null")


def evidence_summary(items: DataFrame, since: Column, until: Column, by: str = "profile_id", top: int = 5) -> DataFrame:
    """What a period's external items say, a row a profile: items, missed ones, the capture funnel and the axes most often met.

    ``items`` are those that ``newest_of_aliases`` leaves, with discovered_at, ``gap_stage`` and ``axes``. An item counts as
    evaluable unless its stage is not_yet_evaluable or before_monitoring, as retrieved unless it is not_retrieved either,
    as hit unless excluded or without a core hit, and as delivered if captured; a missed one is evaluable and not captured.
    ``top_axes`` has the ``top`` axes by their number of items, ties by name.
    """
    i = items.where((F.col("discovered_at") >= since) & (F.col("discovered_at") < until))
    stage = F.col("gap_stage")
    evaluable = ~stage.isin("not_yet_evaluable", "before_monitoring")
    retrieved = evaluable & (stage != "not_retrieved")
    hit = retrieved & ~stage.isin("excluded", "no_core_hit")
    n = i.groupBy(by).agg(F.count("*").alias("items"), F.count_if(evaluable).alias("evaluable"), F.count_if(retrieved).alias("retrieved"), F.count_if(hit).alias("core_hit"), F.count_if(stage == "captured").alias("delivered"), F.count_if(evaluable & (stage != "captured")).alias("missed"))
    a = i.select(by, F.explode(F.array_distinct("axes")).alias("axis")).groupBy(by, "axis").agg(F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), "axis")
    a = a.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= top).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "axis"))), lambda x: x["axis"]).alias("top_axes"))
    return n.join(a, by, "left")
