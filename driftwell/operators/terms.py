"""Emerging terms: hygienic two- and three-word terms, their document frequencies over windows, discovery lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.operators.graph import cut

# Words and phrases that decide which terms are rejected.
HARD_NOISE = "https http www github com org net arxiv doi io gitlab huggingface".split()
BOILERPLATE_WORDS = """
available publicly release released open source repository paper article study experiments experiment evaluation results result
propose proposed proposes present presents introduce introduces show shows shown demonstrate demonstrates achieve achieves achieved
art sota baseline baselines outperform outperforms compared comparison extensive comprehensive significantly substantially
first second third recent recently novel approach approaches method methods framework frameworks technique techniques
address addresses addressing findings finding suggest suggests suggesting limitation limitations challenge challenges challenging remains remain
validated validate validates scenario scenarios
""".split()
EDGE_STOP = """
a an the of for and or with in on to from by via using use uses used based
toward towards we our this that these those is are be was were can it its as
at into over under between within without more most less than however such
also each other both same many while when where which who what have has had
do does did been being not only but if then there their them they you your
his her will would could should may might must per across new various several
different multiple code analysis here thus hence therefore
yet
train trains trained training evaluate evaluates evaluated apply applies applied
leverage leverages leveraged employ employs employed utilize utilizes utilized
develop develops developed design designs designed build builds built enable
enables enabled allow allows allowed require requires required obtain obtains
previous prior further future often consistently increasingly jointly typically
usually commonly widely largely highly through about how among all two three
four five out aim aims examine examines collect collected carry carried
rely relies explore explores conclude concludes improve improves optimize
optimizes fall falls despite against strong promising consistent superior
competitive remarkable impressive significant substantial notable performance
gain gains improvement improvements year years aged
""".split() + BOILERPLATE_WORDS
BOILERPLATE_PHRASES = ("state of the art", "previous work", "prior work", "related work", "future work", "this work", "our work", "further research", "future research", "systematic review", "percentage point", "project page", "project website", "order of magnitude", "paving the way", "pave the way")
GENERIC_WORDS = """
large language model models llm llms machine learning deep artificial intelligence
neural network networks multimodal generative pretrained pre trained transformer transformers mllm mllms
""".split()
SAME_PLURAL = ("series", "species", "lens", "news")


def _in(c: Column, words) -> Column:
    return c.isin(*words)


def singular(w: Column) -> Column:
    n = F.length(w)
    cut = lambda k: F.substr(w, F.lit(1), n - k)
    keep = _in(w, SAME_PLURAL) | w.rlike("(?:sis|ics|us|ss)$")
    return F.when(keep, w).when(w.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y"))).when(w.rlike("[sxz]es$") & (n > 4), cut(2)).when(w.endswith("s") & (n > 3), cut(1)).otherwise(w)


def norm_tokens(words: Column) -> Column:
    """Lower case, hyphens and slashes as word boundaries, singular."""
    return F.transform(F.filter(F.split(F.lower(F.array_join(words, " ")), r"[\s/-]+"), lambda x: x != ""), singular)


def norm_term(term: Column) -> Column:
    return F.array_join(norm_tokens(F.split(term, " ")), " ")


def reject_reason(words: Column) -> Column:
    """Why a term is none: hard_noise, edge_stop, boilerplate_phrase, boilerplate_word, umbrella_generic; null if it passes."""
    norm = norm_tokens(words)
    key = F.concat(F.lit(" "), F.array_join(F.filter(norm, lambda x: F.length(x) > 2), " "), F.lit(" "))
    phrases = [" " + " ".join(w for w in p.split() if len(w) > 2) + " " for p in BOILERPLATE_PHRASES]
    has_phrase = F.exists(F.array(*map(F.lit, phrases)), lambda p: key.contains(p))
    broken = F.exists(words, lambda w: w.startswith("-") | w.endswith("-"))
    return (
        F.when(broken | F.exists(norm, lambda t: _in(t, HARD_NOISE)), "hard_noise")
        .when(_in(F.element_at(words, 1), EDGE_STOP) | _in(F.element_at(words, -1), EDGE_STOP), "edge_stop")
        .when(has_phrase, "boilerplate_phrase").when(F.exists(norm, lambda t: _in(t, BOILERPLATE_WORDS)), "boilerplate_word")
        .when(F.forall(norm, lambda t: _in(t, GENERIC_WORDS)), "umbrella_generic")
    )


def _grams(text: Column, sizes, edges: bool = True) -> Column:
    """All word runs of a text within one sentence, as one array of terms; words of three letters or more, before hygiene.

    Without ``edges`` runs whose first or last word alone rejects them (a stop word, or one that ends with a hyphen) are
    never written out; ``reject_reason`` would drop every one of them.
    """
    closed = lambda x: _in(x, EDGE_STOP) | x.endswith("-")
    said = F.filter(F.split(F.lower(text), r"[.;:!?\n]+"), lambda s: F.length(s) > 0)
    words = F.transform(said, lambda s: F.filter(F.regexp_extract_all(s, F.lit(r"[a-z][a-z0-9\-]+"), F.lit(0)), lambda x: F.length(x) > 2))

    def runs(w: Column, n: int) -> Column:
        at = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        if not edges:
            at = F.filter(at, lambda i: ~closed(F.get(w, i - 1)) & ~closed(F.get(w, i + n - 2)))
        return F.transform(at, lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))

    return F.flatten(F.transform(words, lambda w: F.concat(*[runs(w, n) for n in sizes])))


def ngrams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes=(2, 3)) -> DataFrame:
    """(doc, words, term): word runs within one sentence, words of three letters or more, before hygiene."""
    grams = docs.select(id_col, F.explode(_grams(F.col(text_col), sizes)).alias("term"))
    return grams.select(id_col, F.split("term", " ").alias("words"), "term")


def term_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes=(2, 3)) -> DataFrame:
    """Distinct (doc, term) that pass hygiene. Terms are made distinct before the rules run on them."""
    return hygienic(raw_term_documents(docs, id_col, text_col, sizes))


def raw_term_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes=(2, 3), keep: tuple = ()) -> DataFrame:
    """(doc, term, and the columns of ``keep``), once a document, before most of hygiene: rules look at the term alone, so they
    may wait until terms are counted; only runs with a stop word at an edge, the most of all, are never made. ``docs`` has one
    row a document; terms are made distinct inside it and nothing moves."""
    return docs.select(id_col, *keep, F.explode(F.array_distinct(_grams(F.col(text_col), sizes, edges=False))).alias("term"))


def hygienic(rows: DataFrame, after: Column | None = None) -> DataFrame:
    """Rows whose ``term`` passes the rules; with ``after`` (a condition on counts) the rules run on the rows that meet it,
    and Spark can't move them below the count."""
    ok = reject_reason(F.split("term", " ")).isNull()
    return rows.where(ok if after is None else F.when(after, ok).otherwise(False))


def reject_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    g = ngrams(docs, id_col, text_col).groupBy("term").agg(F.count("*").alias("m"))
    return g.withColumn("reason", F.coalesce(reject_reason(F.split("term", " ")), F.lit("kept"))).groupBy("reason").agg(F.sum("m").alias("n"))


def drop_subsumed(terms: DataFrame, col: str = "term") -> DataFrame:
    """Terms that no longer term contains as a run of words: each term's shorter runs are joined by equality."""
    t = terms.select(F.split(norm_term(F.col(col)), " ").alias("w")).distinct()
    lens = F.sequence(F.lit(1), F.size("w") - 1)
    runs = t.where(F.size("w") > 1).select("w", F.explode(lens).alias("n")).select("w", "n", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("i"))
    inner = runs.select(F.array_join(F.slice("w", F.col("i"), F.col("n")), " ").alias("_n")).distinct()
    return terms.withColumn("_n", norm_term(F.col(col))).join(inner, "_n", "left_anti").drop("_n")


def _word_runs(df: DataFrame, col: str, *keep: str) -> DataFrame:
    """(keep, _run): every run of words of a normalised term, itself included."""
    w = F.filter(F.split(norm_term(F.col(col)), " "), lambda x: x != "")
    d = df.select(*keep, w.alias("_w")).where("size(_w) > 0").select("*", F.explode(F.sequence(F.lit(1), F.size("_w"))).alias("_n"))
    d = d.select("*", F.explode(F.sequence(F.lit(1), F.size("_w") - F.col("_n") + 1)).alias("_i"))
    return d.select(*keep, F.array_join(F.slice("_w", F.col("_i"), F.col("_n")), " ").alias("_run")).distinct()


def drop_known(terms: DataFrame, known: DataFrame, col: str = "term") -> DataFrame:
    """Terms that neither contain a known term nor lie in one, as runs of words; both meet by equality of a run."""
    norm = F.trim(F.regexp_replace(norm_term(F.col(col)), " +", " "))
    whole = known.select(F.trim(F.regexp_replace(norm_term(F.col("keyword")), " +", " ")).alias("_run")).where("_run <> ''").distinct()
    holds = _word_runs(terms, col, col).join(whole, "_run").select(F.col(col).alias("_t"))
    lies = terms.select(F.col(col).alias("_t"), norm.alias("_run")).join(_word_runs(known, "keyword"), "_run").select("_t")
    return terms.join(holds.unionByName(lies).distinct(), F.col(col) == F.col("_t"), "left_anti")


def emerging_terms(docs: DataFrame, current: Column, previous: Column, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", least: int = 3, top: int = 12) -> DataFrame:
    """Terms of at least ``least`` documents of the current window, with their count in the previous one."""
    d = docs.withColumn("_now", current).withColumn("_was", previous).where("_now or _was")
    t = raw_term_documents(d.withColumn("_at", F.struct(id_col, "_now", "_was")), "_at", text_col)
    n = t.groupBy("term").agg(F.count_if("_at._now").alias("n_now"), F.count_if("_at._was").alias("n_before"))
    n = cut(hygienic(n, F.col("n_now") >= least))  # few terms of many, looked at twice
    if known is not None:
        n = drop_known(n, known)
    return drop_subsumed(n).orderBy(F.desc("n_now"), F.asc("n_before"), "term").limit(top)


def discover(term_docs: DataFrame, docs: DataFrame | None, id_col: str, seed: str, day: str, domain: str, least: int = 3) -> DataFrame:
    """Support, domain documents, different seeds and newest day of each term; without ``docs``, ``term_docs`` has the columns.

    Seeds are counted by two aggregations and not as sets: a set a term makes Spark sort, and spill, all rows of a task.
    """
    j = term_docs if docs is None else term_docs.join(docs.select(id_col, seed, day, domain), id_col)
    by_seed = j.repartition("term").groupBy("term", seed).agg(F.count("*").alias("_n"), F.count_if(domain).alias("_domain"), F.max(day).alias("_day"))  # both counts where the terms are dealt once
    n = by_seed.groupBy("term").agg(F.sum("_n").alias("support"), F.sum("_domain").alias("domain_docs"), F.count(seed).cast("int").alias("breadth"), F.max("_day").alias("newest"))
    return hygienic(n, F.col("support") >= least)


def lanes(found: DataFrame, top: int = 12, least_breadth: int = 2) -> DataFrame:
    """(term, lane, place): up to ``top`` terms picked in turn from three rankings (support, domain share, seed breadth).

    A term is picked once: a lane gives its first term that is still free, and where it has none the first ranking gives
    one in its place. A lane never needs more than its first ``top`` terms, so only these are brought together.
    """
    share = F.col("domain_docs") / F.col("support")
    rankings = [
        (found, [F.desc("support"), F.desc(share), F.asc("term")]),
        (found.where("domain_docs > 0"), [F.desc(share), F.desc("support"), F.asc("term")]),
        (found.where(F.col("breadth") >= least_breadth), [F.desc("breadth"), F.desc("newest"), F.desc("support"), F.asc("term")]),
    ]
    parts = None
    for k, (rows, order) in enumerate(rankings):
        first = rows.orderBy(*order).limit(top).select("term", F.row_number().over(Window.orderBy(*order)).alias("place"), F.lit(k).alias("lane"))
        parts = first if parts is None else parts.unionByName(first)
    in_order = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("lane") == k, F.struct("place", "term")))), lambda x: x["term"])
    one = parts.agg(F.array(*[in_order(k) for k in range(len(rankings))]).alias("lanes"))
    kind = "struct<term:string,lane:int>"

    def turn(picked, i):
        free = lambda lane: F.array_except(lane, F.transform(picked, lambda x: x["term"]))
        mine, fallback = free(F.element_at("lanes", (i % 3 + 1).cast("int"))), free(F.element_at("lanes", 1))
        pick = F.when(F.size(mine) > 0, F.struct(F.try_element_at(mine, F.lit(1)).alias("term"), (i % 3).cast("int").alias("lane")).cast(kind))
        pick = pick.when(F.size(fallback) > 0, F.struct(F.try_element_at(fallback, F.lit(1)).alias("term"), F.lit(0).alias("lane")).cast(kind))
        return F.concat(picked, F.array_compact(F.array(pick)))

    picked = F.aggregate(F.sequence(F.lit(0), F.lit(top - 1)), F.array().cast(f"array<{kind}>"), turn)
    return one.select(F.posexplode(picked).alias("p", "x")).select("x.term", "x.lane", (F.col("p") + 1).alias("place"))


def evidence_docs(term_docs: DataFrame, docs: DataFrame, id_col: str, order: list, n: int = 3) -> DataFrame:
    j = term_docs.join(docs, id_col)
    return j.withColumn("rn", F.row_number().over(Window.partitionBy("term").orderBy(*order))).where(F.col("rn") <= n).select("term", id_col, "rn")


def single_seed_noise(term_docs: DataFrame, docs: DataFrame, id_col: str, seed: str, least: int = 3) -> DataFrame:
    j = term_docs.join(docs.select(id_col, seed), id_col)
    return j.groupBy("term").agg(F.countDistinct(seed).alias("seeds"), F.count("*").alias("n"), F.min(seed).alias("seed")).where((F.col("seeds") == 1) & (F.col("n") >= least)).drop("seeds")


def known_variants(terms: DataFrame, known: DataFrame) -> DataFrame:
    """Terms that are a known term in another spelling."""
    k = known.select(norm_term(F.col("keyword")).alias("_n"), "keyword")
    return terms.withColumn("_n", norm_term(F.col("term"))).join(k, "_n").where("lower(term) <> lower(keyword)").drop("_n")


def exploration_pool(obs: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest observation of each entity, then only those without a core hit; seeds and sources united over all."""
    from driftwell.operators.asof import latest_per_key

    return latest_per_key(obs, [key], order, unions=("seeds", "sources")).where("filter_reason = 'no_core_hit'")
