r"""Matching documents against weighted keyword profiles.

A keyword matches as a whole phrase, whatever its case; only blanks, hyphens, underscores, slashes and brackets may stand
between its words, and its last word may be plural. Boundaries are written as character classes, so other engines agree.

The join is not a regex against every pair: a document's words are met with the first words of the keywords inside its
row, and the regex decides only on those pairs, so no text moves. Keyword lists beyond ``MAX_HEADS`` first words meet
documents by an equi-join on the word instead.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP = r"[\s\-\x{2010}-\x{2015}_/()]+"
SPLIT = re.compile(r"[\s\-‐-―_/()]+")
MAX_HEADS = 20_000
EDGE_BEFORE, EDGE_AFTER = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)"


def keyword_pattern(keyword: str) -> str:
    """The regular expression of a keyword, the same text for Java and RE2."""
    words = [w for w in SPLIT.split(keyword.lower()) if w]
    quoted = [re.sub(r"([^\w])", r"\\\1", w) for w in words]
    if not quoted:
        return r"[^\s\S]"
    if re.fullmatch(r".*[bcdfghjklmnpqrstvwxz]y", words[-1]):
        quoted[-1] = quoted[-1][:-1] + "(?:y|ies)"
    else:
        quoted[-1] += "(?:es|s)?"
    return f"(?i){EDGE_BEFORE}{GAP.join(quoted)}{EDGE_AFTER}"


def _contained(keyword: str, other: str) -> bool:
    """Whether the one keyword matches inside the other's words."""
    pattern = keyword_pattern(keyword).replace(r"[^\p{L}\p{N}_]", r"\W").replace(r"\x{2010}-\x{2015}", "‐-―")
    return re.search(pattern, other) is not None


def keyword_table(spark, rows: list[tuple]) -> DataFrame:
    """(profile_id, keyword, kind, weight, guard) rows with their position, pattern, first word and ``within``.

    ``first`` is the stem of the first word that every match begins with, so that plural one-word keywords meet too;
    ``within`` are the keywords of the profile and kind that this one is part of.
    """
    out = []
    for k, (profile, keyword, kind, weight, guard) in enumerate(rows):
        words = [w for w in SPLIT.split(keyword.lower()) if w]
        within = sorted({o for p, o, other, *_ in rows if p == profile and other == kind and o != keyword and words and words[0] in o.lower() and _contained(keyword, o)})
        out.append((profile, keyword, kind, weight, k, keyword_pattern(keyword), guard, len(words), words[0] if words else "", within))
    return spark.createDataFrame(out, "profile_id string, keyword string, kind string, weight double, position int, pattern string, guard string, n_words int, first string, within array<string>")


def paper_text(title: Column, abstract: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit("")))


def _forms(word: Column) -> Column:
    """The words that a one-word keyword may be written as: itself and its plurals."""
    ies = F.when(word.endswith("y"), F.concat(F.substr(word, F.lit(1), F.length(word) - 1), F.lit("ies")))
    return F.array_compact(F.array(word, F.concat(word, F.lit("s")), F.concat(word, F.lit("es")), ies))


def match_keywords(docs: DataFrame, keywords: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc id, profile_id, keyword, kind, weight, position, within) for every keyword found in a document."""
    heads = keywords.withColumn("head", F.element_at(F.filter(F.split(F.lower("first"), r"[^\p{L}\p{N}]+"), lambda x: x != ""), 1)).where("head is not null")
    if "within" not in keywords.columns:
        heads = heads.withColumn("within", F.array().cast("array<string>"))
    heads = heads.withColumn("_word", F.explode(F.array_distinct(_forms(F.col("head")))))
    words = F.array_distinct(F.split(F.lower(text_col), r"[^\p{L}\p{N}]+"))
    rows = docs.select(id_col, text_col)
    if heads.limit(MAX_HEADS + 1).count() <= MAX_HEADS:  # of rows, which are what is broadcast
        every = heads.agg(F.collect_set("_word")).scalar()
        met = rows.select(id_col, text_col, F.explode(F.array_intersect(words, every)).alias("_word"))
        met = met.join(F.broadcast(heads), "_word")
    else:
        met = rows.select(id_col, F.explode(words).alias("_word")).join(heads, "_word").join(rows, id_col)
    found = met.where(F.expr(f"regexp_like({text_col}, pattern)")).where(F.expr(f"guard is null or regexp_like({text_col}, guard)"))
    return found.select(id_col, "profile_id", "keyword", "kind", "weight", "position", "within").distinct()


def keyword_counts(hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents a keyword is found in."""
    return hits.groupBy("profile_id", "keyword").agg(F.countDistinct(id_col).alias("n_docs"))


def drop_subsumed(hits: Column) -> Column:
    """Hits that no longer hit contains as a run of words."""
    norm = lambda c: F.concat(F.lit(" "), F.regexp_replace(F.lower(c), r"[\s\-_/()]+", " "), F.lit(" "))
    return F.filter(hits, lambda a: ~F.exists(hits, lambda b: (norm(b) != norm(a)) & norm(b).contains(norm(a))))


NON_RESEARCH = r"(?i)^\s*(?:erratum|corrigendum|correction to|retraction|editorial|table of contents|front matter|author index|call for papers)\b"


def judge(docs: DataFrame, hits: DataFrame, id_col: str = "doc_id", title_col: str | None = None, profiles: DataFrame | None = None) -> DataFrame:
    """One row for each profile and document: core, domain and exclude hits, weights, eligible, filter_reason, primary keyword.

    Core hits that a longer core hit of the document contains are left out.

    An exclusion beats everything; documents that hit nothing appear only if ``profiles`` (profile_id) is given.
    """
    within = F.col("within") if "within" in hits.columns else F.array().cast("array<string>")
    one = F.struct("position", "keyword", F.coalesce("weight", F.lit(1.0)).alias("weight"), within.alias("within"))
    pick = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, one)))
    names = lambda c: F.transform(c, lambda x: x["keyword"])
    rows = hits.groupBy("profile_id", id_col).agg(pick("core").alias("_core"), names(pick("target")).alias("domain_hits"), names(pick("exclude")).alias("exclude_hits"))
    # a core hit inside a longer one is the same phrase once more: it counts for no weight, breadth or rank
    rows = rows.withColumn("_core", F.filter("_core", lambda x: ~F.arrays_overlap(x["within"], names(F.col("_core")))))
    heaviest = F.array_max(F.transform("_core", lambda x: F.struct(x["weight"].alias("weight"), (-x["position"]).alias("place"), x["keyword"].alias("keyword"))))
    has = F.size("_core") > 0
    rows = rows.select(
        "profile_id", id_col, names(F.col("_core")).alias("core_hits"), "domain_hits", "exclude_hits", F.when(has, F.aggregate("_core", F.lit(0.0), lambda acc, x: acc + x["weight"])).alias("weight_sum"),
        heaviest["weight"].alias("weight_max"), heaviest["keyword"].alias("primary_keyword"),
    )
    if profiles is not None:
        every = docs.select(id_col).crossJoin(F.broadcast(profiles.select("profile_id").distinct()))  # profiles: the stated few
        rows = every.join(rows, ["profile_id", id_col], "left")
    none = F.array().cast("array<string>")
    for c in ("core_hits", "domain_hits", "exclude_hits"):
        rows = rows.withColumn(c, F.coalesce(c, none))
    reason = F.when(F.size("exclude_hits") > 0, "excluded")
    if title_col:
        rows = rows.join(docs.select(id_col, F.col(title_col).alias("_title")), id_col)
        reason = reason.when(F.col("_title").rlike(NON_RESEARCH), "non_research")
    reason = reason.when(F.size("core_hits") == 0, "no_core_hit")
    return rows.withColumn("filter_reason", reason).withColumn("eligible", F.col("filter_reason").isNull()).drop("_title")


def funnel(judged: DataFrame) -> DataFrame:
    return judged.groupBy("profile_id").agg(
        F.count("*").alias("n_input"), F.count_if(F.col("filter_reason") == "excluded").alias("n_excluded"),
        F.count_if(F.col("filter_reason") == "no_core_hit").alias("n_unmatched"), F.count_if("eligible").alias("n_scored"),
    )


def filter_distribution(judged: DataFrame, key: str, order: list, examples: int = 2) -> DataFrame:
    """Reasons over the first reasoned row of each entity, with the first ``examples`` keys."""
    reasoned = judged.where("filter_reason is not null")
    first = reasoned.groupBy("profile_id", key).agg(F.min_by("filter_reason", F.struct(*order)).alias("filter_reason"))
    n = first.groupBy("profile_id", "filter_reason").agg(F.count("*").alias("n"))
    # Spark keeps only the first rows of each reason in every task before it brings them together
    few = first.withColumn("_k", F.row_number().over(Window.partitionBy("profile_id", "filter_reason").orderBy(key))).where(F.col("_k") <= examples)
    few = few.groupBy("profile_id", "filter_reason").agg(F.array_sort(F.collect_list(key)).alias("examples"))
    return n.join(few, ["profile_id", "filter_reason"])


def title_mentions(texts: DataFrame, papers: DataFrame, shown: DataFrame) -> DataFrame:
    """(text_id, paper_key) where the paper's title, its head before a colon or its acronym occurs in the text, shown pairs aside."""
    head = F.trim(F.split("title", ":")[0])
    keys = F.array_compact(F.array(F.col("title"), F.when((F.length(head) >= 12) & (F.size(F.split(head, " ")) >= 2), head), F.nullif(F.regexp_extract("title", r"\b([A-Z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*)\b", 1), F.lit(""))))
    k = papers.select("paper_key", F.explode(F.array_distinct(keys)).alias("key")).where("key <> ''").withColumn("head", F.split(F.lower("key"), r"[^\p{L}\p{N}]+")[0])
    w = texts.select("text_id", "text", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("head")).where("head <> ''")
    quoted = F.concat(F.lit(r"(?:^|[^A-Za-z0-9])\Q"), F.col("key"), F.lit(r"\E(?:[^A-Za-z0-9]|$)"))
    hit = F.when(F.length("key") > 24, F.lower("text").contains(F.lower("key"))).otherwise(F.regexp_like("text", quoted))
    return w.join(k, "head").where(hit).select("text_id", "paper_key").distinct().join(shown, ["text_id", "paper_key"], "left_anti")
