"""Results read out of tables: header bands, blocks of rows, orientation, metrics and models, cell by cell.

A table is its rows (``readers.table_rows``): one DataFrame row a table row, with all its cells as an array. Everything
about one table is decided by windows and aggregates over its rows; tables are small, so no group is large, and a hot
document's tables are groups of their own.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions import numbers as N
from driftwell.functions.keys import cell_number, collapse

# What marks a paper's own rows, averages, ablations, computed rows and settings.
OURS = r"(?i)\bours\b|\(ours\)|\bproposed\b|\bour (?:method|model|approach)\b"
MEAN = r"(?i)\b(?:mean|avg\.?|average|overall|total|all)\b"
ABLATION = r"(?i)\babla(?:tion|te|ting)\b|\bcontribution of\b|\beffect of\b"
DERIVED = r"(?i)^(?:(?:rel(?:ative|\.)?\s*|abs(?:olute|\.)?\s*)?(?:improvement|improv\.|impr\.|imp\.)\s*(?:\(.*\))?|(?:Δ|\\Delta)\s*(?:\((?![^)]*\b(?:ours?|proposed)\b)[^)]*\))?)$"
UNIT_COLUMN = r"(?i)\b(?:time|seconds?|hours?|minutes?|params?|parameters|flops|tokens?|cost|memory|latency|size)\b|\((?:s|h|ms|min|gb|mb|k|m|b|\$)\)"
MARKS = ("✓", "✔", "✗", "✘", "×", "\\checkmark", "\\ding{51}", "\\ding{55}", "\\cmark", "\\xmark")
CITED = r"\s*(?:\([^()]*\bet al\.?[^()]*\)|\([^()]*\b(?:19|20)\d{2}[a-z]?\)|\[\d+(?:\s*[,–-]\s*\d+)*\])"
GAIN = r"^\s*\d+(?:\.\d+)?%?\s+([+−-])\s?(\d+(?:\.(\d+))?)%?\s*$"
IN_BRACKETS = r"^(\s*\d+(?:\.\d+)?%?)\s*\(\s*([+−-]\s?\d+(?:\.\d+)?%?)\s*\)\s*$"
#: More columns than this under one metric are categories, of which only an average is a result.
MAX_COLUMNS_PER_KEY = 8
NO_VALUE = r"^(?:[-–—−]+|n/?a|N/?A)$"
NAME = r"\p{L}{2,}"


def _by_table(id_col: str):
    return Window.partitionBy(id_col, "table_id")


def bands(rows: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Table rows with ``is_header`` and ``is_group`` from their structure; formulas in the cells become numbers.

    Rows of the table's head and rows of column headings are headers. Otherwise headers end at the first row with a value
    or a sign of absence, at a row of one cell over the whole width, or at a group row (a name, then one cell over the
    rest) right above values. A group row in the body labels the rows beneath it.
    """
    order = _by_table(id_col).orderBy("row")
    raw = F.transform("own", lambda x: N.math_text(x, numbers=False))
    said = lambda c: F.when(F.exists(c, lambda x: x.contains(N.MATH)), F.transform(c, lambda x: N.math_text(x))).otherwise(F.col(c))
    rows = rows.withColumn("_alike", F.col("cells") == F.col("own")).withColumn("_raw", raw).withColumn("_own", said("own"))
    rows = rows.withColumn("cells", F.when(F.col("_alike"), F.col("_own")).otherwise(said("cells"))).drop("_alike")  # without spans they are the same
    width, n = F.size("cells"), F.size("own")
    group = (F.col("row") > 0) & (n == 2) & (width > 2) & (F.get("spans", F.lit(1)) == width - 1) & (F.get("_raw", F.lit(1)) != "")
    rows = rows.withColumn("is_group", F.coalesce(group, F.lit(False)))
    first = F.trim(F.get("cells", F.lit(0)))
    below = F.lead(F.struct(F.exists("_own", N.is_numeric).alias("valued"), first.alias("first"))).over(order)
    opens = F.col("is_group") & (F.get("_raw", F.lit(0)) != "") & below["valued"] & ((below["first"] == "") | (below["first"] == first))
    banner = (F.col("row") > 0) & (n == 1) & (F.get("spans", F.lit(0)) == width)
    ends = ~F.col("heading") & (banner | F.coalesce(opens, F.lit(False)) | F.exists("_raw", lambda x: N.is_numeric(x) | N.is_missing(x)))
    rows = rows.withColumn("_ends", ends)
    header_rows = F.coalesce(F.min(F.when(F.col("_ends"), F.col("row"))).over(_by_table(id_col)), F.count("*").over(_by_table(id_col)))
    return rows.withColumn("is_header", F.col("row") < header_rows).drop("_raw", "_own", "_ends", "own", "spans", "heading")


def model_label(c: Column) -> Column:
    """A row's name without the spacing command that formulas leave before it."""
    return F.trim(F.regexp_replace(F.trim(c), r"^\\{0,2}\[\s*-?[\d.]+\s*(?:pt|em|ex|mm)(?:\s*/\s*-?[\d.]+\s*(?:pt|em|ex|mm))?\s*\]\s*", ""))


def row_blocks(rows: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Body rows with ``block_id`` and ``block`` of the heading row above them (null before the first); headings are ``is_block``.

    A heading has a name in its first cell and nothing, the same text or only signs of absence in the others; or it is a
    group row whose next row continues it. Inner headings carry the outer one's name.
    """
    order = _by_table(id_col).orderBy("row")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    body = rows.where("not is_header").withColumn("_first", F.trim(F.get("cells", F.lit(0))))
    body = body.withColumn("_rest", F.transform(F.slice("cells", F.lit(2), F.greatest(F.size("cells") - 1, F.lit(0))), F.trim))
    first, rest, label = F.col("_first"), F.col("_rest"), F.get("_rest", F.lit(0))
    body = body.withColumn("_same", F.forall(rest, lambda c: (c == "") | (c == first)))
    absent = F.forall(rest, lambda c: c.rlike(NO_VALUE))
    body = body.withColumn("_plain", (first != "") & first.rlike(NAME) & (F.size(rest) > 0) & (F.col("_same") | absent)).withColumn("_wide", F.col("_plain") & F.col("_same"))
    inner = F.col("is_group") & ~F.col("_plain") & F.forall(rest, lambda c: c == label) & label.rlike(NAME) & ~label.rlike(NO_VALUE)
    body = body.withColumn("_inner", inner).withColumn("_line", F.when(~F.col("is_group"), first))
    body = body.withColumn("_below", F.expr(f"lead(_line) ignore nulls over (partition by `{id_col}`, table_id order by row)"))
    named = F.col("_inner") & (first != "") & ((F.col("_below") == "") | (F.col("_below") == first))
    tidy = F.regexp_replace(model_label(first), r"(?<=\w)- (?=\w)", "-")
    body = body.withColumn("_outer", F.last(F.when(F.col("_wide"), model_label(first)).when(named, tidy), ignorenulls=True).over(upto))
    goes_on = F.col("_inner") & ((F.col("_below") == "") | (F.col("_below") == F.when(first != "", first).otherwise(F.coalesce("_outer", F.lit("")))))
    body = body.withColumn("is_block", F.col("_plain") | F.coalesce(goes_on, F.lit(False)))
    text = F.when(F.col("_plain"), model_label(first)).otherwise(F.concat_ws(" · ", "_outer", model_label(label)))
    head = F.when(F.col("is_block"), F.struct(F.concat_ws(":", F.col("row").cast("string"), text).alias("block_id"), text.alias("block")))
    return body.withColumn("_head", F.last(head, ignorenulls=True).over(upto)).select(*rows.columns, "is_block", "_head.block_id", "_head.block")


def column_paths(rows: DataFrame, id_col: str = "page_id", keep: tuple = ()) -> DataFrame:
    """(id, table_id, paths, and the table's own columns of ``keep``): for each column its headers from top to bottom, repeats of a merged one left out."""
    of_table = [F.first(c).alias(c) for c in keep]
    heads = rows.where("is_header").groupBy(id_col, "table_id").agg(F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("h"), *of_table)
    none = F.array().cast("array<string>")
    step = lambda c: lambda acc, h: F.when((h["cells"][c] != "") & ((F.size(acc) == 0) | (F.try_element_at(acc, F.lit(-1)) != h["cells"][c])), F.concat(acc, F.array(h["cells"][c]))).otherwise(acc)
    at = F.sequence(F.lit(0), F.size(F.col("h")[0]["cells"]) - 1)
    return heads.select(id_col, "table_id", F.transform(at, lambda c: F.aggregate("h", none, step(c))).alias("paths"), *keep)


def row_labels(body: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Adds ``label``: the cells before the first value, equal neighbours once; marks of settings only where they tell rows apart."""
    stop = F.array_position(F.transform("cells", lambda c: N.is_numeric(c) | N.is_missing(c)), True)
    before = N._let(stop, lambda k: F.when(k == 0, F.col("cells")).otherwise(F.slice("cells", F.lit(1), (k - 1).cast("int"))))
    body = body.withColumn("_said", F.filter(before, lambda c: c != ""))
    new = lambda c, i: (i == 0) | (F.get("_said", i - 1) != c) | c.isin(*MARKS)
    body = body.withColumn("_full", F.when(F.size("_said") > 1, F.filter("_said", new)).otherwise(F.col("_said")))
    body = body.withColumn("_bare", F.array_join(F.filter("_full", lambda c: ~c.isin(*MARKS)), " "))
    alike = F.count("*").over(Window.partitionBy(id_col, "table_id", "_bare"))
    label = F.when((F.col("_bare") == "") | (alike > 1), F.array_join("_full", " ")).otherwise(F.col("_bare"))
    return body.withColumn("label", label).drop("_said", "_full", "_bare")


def _as_word(name: Column) -> Column:
    """A pattern for a name that stands alone, case aside."""
    return F.concat(F.lit(r"(?i)(?<![\w-])\Q"), F.regexp_replace(name, r"\\E", ""), F.lit(r"\E(?![\w-])"))


def _folded(name: Column) -> Column:
    """A text with its letters A to Z small, as patterns without case compare it; for a plain search before a pattern's."""
    return F.translate(name, string.ascii_uppercase, string.ascii_lowercase)


def _is_name(text: Column, name: Column) -> Column:
    return F.lower(F.trim(text)) == F.lower(F.trim(name))


def own_label(label: Column, method: Column) -> Column:
    """A row of the paper itself: it bears the method's name, or calls itself ours or proposed."""
    return F.coalesce((method != "") & F.regexp_like(label, _as_word(method)), F.lit(False)) | label.rlike(OURS)


def _named(texts: Column, names: Column) -> Column:
    return F.filter(names, lambda b: F.exists(texts, lambda t: F.regexp_like(t, _as_word(b))))


def author_metrics(cells: DataFrame, sents: DataFrame, papers: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, table_id, col, metric): columns without a metric's name whose metric the paper's own sentence tells.

    The sentence says ``<method> ... <metric> of <value>%`` or ``<value>% <metric>`` for one benchmark, nothing between name
    and value compares with others, and the value stands in exactly one cell of the paper's own rows.
    """
    p = papers.select(id_col, "method", "benchmarks").where("method <> ''")
    s = sents.select(id_col, "sentence").where(F.length("sentence") <= 600).join(p, id_col).where(F.regexp_like("sentence", _as_word(F.col("method"))))
    s = s.withColumn("_b", _named(F.array("sentence"), F.col("benchmarks"))).where("size(_b) = 1")
    forms = {rf"(?i)^(.*?)\b({N.METRIC_WORDS})\s+(?:of|at|=|:)\s*(\d+(?:\.\d+)?)\s?%": (2, 3), rf"(?i)^(.*?)\b(\d+(?:\.\d+)?)\s?%\s+({N.METRIC_WORDS})\b": (3, 2)}
    told = []
    for pattern, (m, v) in forms.items():
        told.append(s.select(id_col, "method", F.col("_b")[0].alias("bench"), "sentence", *[F.regexp_extract("sentence", pattern, k).alias(n) for k, n in ((1, "before"), (m, "metric"), (v, "said"))]))
    told = told[0].unionByName(told[1]).where("said <> ''")
    gap = F.element_at(F.split(F.lower("before"), F.concat(F.lit(r"\Q"), F.lower("method"), F.lit(r"\E"))), -1)
    breaks = r"(?i)\b(?:than|outperform\w*|surpass\w*|beat\w*|exceed\w*|compared|versus|vs\.?|whereas|while|which|who|whose|unlike|against|relative|baselines?)\b"
    told = told.where(F.contains(F.lower("before"), F.lower("method")) & (F.length(gap) <= 80) & ~gap.rlike(r",|\band\b") & ~F.col("before").rlike(breaks))
    told = told.groupBy(id_col, "bench", N.metric_path_key(F.col("metric")).alias("key"), "said").agg(F.min("metric").alias("metric"), F.min_by("sentence", "metric").alias("sentence"))
    own = cells.where("own").withColumn("said", F.regexp_extract("text", r"^\s*(\d+(?:\.\d+)?)(?![\d.]|[eE][-+]?\d|[A-Za-z])", 1))
    met = told.join(own.select(id_col, "bench", "said", "table_id", "col", "path", "text", "caption"), [id_col, "bench", "said"])
    met = met.groupBy(id_col, "bench", "key", "said").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("metric", "sentence", "table_id", "col", "path", "text", "caption")]).where("n = 1")
    joined, cap = F.array_join("path", " / "), N.only_metric(F.col("caption"))
    sizes = F.regexp_extract_all(joined, F.lit(r"\((\d+)\)"), F.lit(1))
    ok = ~(joined.rlike(N.METRIC_ABBR) | joined.rlike(N.METRIC_PHRASE) | joined.rlike(UNIT_COLUMN)) & (joined.contains("%") | F.col("text").contains("%") | F.col("caption").rlike(r"(?i)\bpercent"))
    ok = ok & (cap.isNull() | (N.metric_path_key(cap) == F.col("key"))) & F.forall(sizes, lambda n: F.regexp_like("sentence", F.concat(F.lit(r"(?<![\d.])"), n, F.lit(r"(?![\d.])"))))
    met = met.where(ok).groupBy(id_col, "table_id", "col").agg(F.countDistinct("key").alias("n"), F.min("metric").alias("metric")).where("n = 1")  # two metrics for one column: neither
    return met.select(id_col, "table_id", "col", F.col("metric").alias("told"))


def _has_metric(c: Column) -> Column:
    return c.rlike(N.METRIC_ABBR) | c.rlike(N.METRIC_PHRASE)


def _as_read(path: Column, bench: Column, told: Column | None, lent: Column, units: Column) -> Column:
    """What a column's headers say of one benchmark: metric and its key, direction, the path above an average, whether it is in percent.

    A path without a metric borrows one: ``told`` by a sentence, else ``lent`` by the caption if it only names the benchmark
    or an average. ``units`` are the keys of the metrics that the caption gives in percent; ``known`` is false without a metric.
    """
    last = F.try_element_at(path, F.lit(-1))
    spare = F.trim(F.regexp_replace(last, r"\.$", "")).rlike("^(?:" + MEAN + ")$") | F.forall(path, lambda p: _is_name(p, bench))
    lend = F.when(spare, lent)
    lend = F.when(~_has_metric(F.array_join(path, " / ")), lend if told is None else F.coalesce(told, lend))

    def named(path: Column) -> Column:
        joined = F.array_join(path, " / ")
        metric = N.clean_label(F.array_join(F.filter(path, lambda p: ~_is_name(N.clean_label(p), bench)), " / "))
        known = lambda x: F.struct(F.when(x["metric"] != "", x["metric"]).otherwise(N.clean_label(x["joined"])).alias("metric"), x["joined"].alias("joined"))
        return N._let(N._let(F.struct(joined.alias("joined"), metric.alias("metric")), known), told_of)

    def told_of(x: Column) -> Column:
        above, below = (F.regexp_extract(x["metric"], "^(.*) / (.*)$", k) for k in (1, 2))
        unit = F.coalesce(F.array_contains(units, N.metric_path_key(N.only_metric(x["metric"]))), F.lit(False))
        percent = x["joined"].contains("%") | (F.coalesce(F.size(units), F.lit(0)) > 0) & unit
        return F.when(
            _has_metric(x["joined"]),
            F.struct(
                bench.alias("benchmark"), N.label_key(bench).alias("bench_key"), x["metric"].alias("metric"), N.metric_path_key(x["metric"]).alias("metric_key"), N.metric_direction(x["joined"]).alias("direction"),
                N.label_key(above).alias("parent"), below.rlike(MEAN).alias("mean"), percent.alias("percent"),
            ),
        )

    return N._let(F.concat(F.array_compact(F.array(lend)), path), named)


def _tables(rows: DataFrame, papers: DataFrame, id_col: str, told: bool) -> DataFrame:
    """A row a table that is no ablation: its paper's names, and everything that its columns and its caption alone decide.

    ``columns`` has for each column its path, the benchmarks it names and, of a table read by rows, what it says of each
    benchmark; of a table of models, the model. With ``told`` sentences may name metrics, so those wait for the cells.
    """
    t = column_paths(rows, id_col, ("caption",)).join(papers.select(id_col, F.coalesce("method", F.lit("")).alias("method"), "benchmarks"), id_col)
    t = t.where(~F.coalesce(F.col("caption").rlike(ABLATION), F.lit(False)))
    with_own = F.exists("paths", lambda p: F.array_join(p, " / ").rlike(OURS) | F.coalesce((F.col("method") != "") & (F.size(p) > 0) & _is_name(F.get(p, F.size(p) - 1), F.col("method")), F.lit(False)))
    in_columns = F.size(_named(F.flatten("paths"), F.col("benchmarks"))) > 0
    captioned = F.when(in_columns, F.array().cast("array<string>")).otherwise(_named(F.array(F.coalesce("caption", F.lit(""))), F.col("benchmarks")))
    percent = F.regexp_extract_all("caption", F.lit(N.METRIC_ABBR + r"\s*\(\s*%\s*\)"), F.lit(1)), F.regexp_extract_all("caption", F.lit(N.METRIC_PHRASE + r"\s*\(\s*%\s*\)"), F.lit(1))
    times = F.regexp_extract("caption", r"(?i)\baveraged\s+over\s+([0-9]+)\s+(?:random\s+)?(?:seeds|runs|trials)\b", 1).try_cast("int")
    over = F.when((F.regexp_count("caption", F.lit(r"(?i)\baveraged\s+over\b")) == 1) & (times > 0), times)
    benches = F.filter("benchmarks", lambda b: F.regexp_like("caption", F.concat(F.lit(r"(?i)(?<![\w-])\Q"), b, F.lit(r"\E benchmark\b"))))
    t = t.select("*", with_own.alias("_with_own"), captioned.alias("_captioned"), N.only_metric(F.col("caption")).alias("_m"), F.transform(F.concat(*percent), N.metric_path_key).alias("_units"), over.alias("averaged_over"), benches.alias("_b"))
    t = t.withColumn("_way", N.metric_direction(F.col("_m"))).withColumn("_low", F.transform("benchmarks", lambda b: _folded(F.regexp_replace(b, r"\\E", ""))))

    def column(p: Column) -> Column:
        joined = F.array_join(p, " / ")
        model = N.clean_label(joined)
        own = model.rlike(OURS) | F.coalesce((F.col("method") != "") & _is_name(F.try_element_at(p, F.lit(-1)), F.col("method")), F.lit(False))
        straight = ~F.col("_with_own") & (F.size(p) > 0)
        names = lambda x: F.when(straight, _named(x, F.col("benchmarks")))
        said = [] if told else [F.when(straight, F.transform("benchmarks", lambda b: _as_read(p, b, None, F.col("_m"), F.col("_units")))).alias("said")]
        turned = F.when(~straight, F.struct(model.alias("model"), own.alias("own"), joined.contains("%").alias("percent")))
        ratio = F.when(straight, F.exists(p, lambda x: x.rlike(r"(?i)pass@\d+\s*=\s*\d+\s*/\s*\d+")))
        return F.struct(p.alias("path"), names(p).alias("each"), names(F.array(joined)).alias("whole"), ratio.alias("ratio"), turned.alias("turned"), *said)

    return t.withColumn("columns", F.transform("paths", column)).drop("paths")


def _labelled(label: Column) -> Column:
    """A row by its name: the model, whether it is the paper's own, whether it stands for what it adds to the row above, and whether it is a result's."""

    def own(x: Column) -> Column:
        return F.struct(x.alias("label"), own_label(x, F.col("method")).alias("own"), (x.startswith("+") & F.col("_base").isNotNull()).alias("based"))

    def model(x: Column) -> Column:
        added = F.concat(F.col("_base"), F.lit(" + "), F.regexp_replace(x["label"], r"^[+ ]+", ""))
        return F.struct(F.when(x["own"] & x["based"], added).otherwise(x["label"]).alias("model"), x["own"].alias("own"), x["based"].alias("based"))

    def kept(x: Column) -> Column:
        return F.struct(x["model"].alias("model"), x["own"].alias("own"), x["based"].alias("based"), (x["model"].rlike(r"[A-Za-z].*[A-Za-z]") & ~x["model"].rlike(DERIVED)).alias("kept"))

    return N._let(N._let(N._let(label, own), model), kept)


def table_results(rows: DataFrame, papers: DataFrame, sents: DataFrame | None = None, id_col: str = "page_id") -> DataFrame:
    """Results of the tables: benchmark, metric and their keys, direction, value, model, own, block, unit, averaged_over, locator.

    ``rows`` come from ``bands``; ``papers`` has the id, ``method`` (a name or null) and ``benchmarks`` (names to look for).
    The benchmark is named by the column's headers, else by the row, else by the caption alone; several names drop the
    cell. A cell needs a metric: from its headers, from the caption for averages and for columns that only name the
    benchmark, or from the paper's own ``sents``. Ablation tables give nothing. A (row, benchmark, metric) that stands in
    two columns is dropped, both times; of columns under one heading an average replaces the others, and more than
    ``MAX_COLUMNS_PER_KEY`` without one are categories. Tables with models as columns are read the other way round: their
    rows are the tasks of one benchmark.

    What a caption or a column says is read once a table, what a label says once a row; cells of both kinds of tables go the
    same way and only pick it. ``rows`` are read twice, so cut them first where they are dear.
    """
    t = row_labels(row_blocks(rows, id_col), id_col).drop("caption").join(_tables(rows, papers, id_col, sents is not None).hint("merge"), [id_col, "table_id"])  # both sides grow
    t = t.withColumn("_turned", F.col("_with_own") & F.min(F.col("label").rlike(r"(?i)^(?:Task \d+|Average|Avg\.?|Mean)$")).over(_by_table(id_col)))
    above = F.lag(F.struct("label", "block_id", "is_block")).over(_by_table(id_col).orderBy("row"))
    based = ~above["is_block"] & above["block_id"].eqNullSafe(F.col("block_id")) & ~above["label"].rlike(r"^\+") & above["label"].rlike(r"[A-Za-z].*[A-Za-z]") & ~above["label"].rlike("^" + MEAN)
    straight, turned = ~F.col("_with_own"), F.col("_turned") & (F.size("_b") == 1) & F.col("_m").isNotNull()
    t = t.withColumn("_base", F.when(based, model_label(above["label"]))).where("not is_block").where(straight | turned)
    cited = lambda b: F.regexp_like("label", F.concat(F.lit(r"(?i)^\s*\Q"), b, F.lit(r"\E" + CITED + r"\s*$")))
    by_row = N._let(_named(F.array("label"), F.col("benchmarks")), lambda n: F.struct(n.alias("all"), F.filter(n, lambda b: ~cited(b)).alias("own")))
    empty = F.array().cast("array<string>")
    may = N._let(_folded(F.col("label")), lambda l: F.exists("_low", lambda b: F.contains(l, b)))  # most rows name none, and a pattern of a column is made anew each time
    by_row = F.when(may, by_row).otherwise(F.struct(empty.alias("all"), empty.alias("own")))
    plain = N._let(collapse(F.col("label")), lambda c: model_label(F.when(c != "", c).otherwise(F.col("label"))))
    task = lambda m: F.struct(m.alias("metric"), N.metric_path_key(m).alias("metric_key"), N.metric_path_key(N.only_metric(m)).alias("unit_key"))
    number = lambda text, i: F.struct(i.alias("col"), text.alias("text"), F.get("columns", i).alias("c"), cell_number(text).alias("value"))  # noqa: E731  read once, before a cell is a row
    t = t.select(
        "*", F.when(straight, by_row).alias("_by_row"), F.when(straight, _labelled(plain)).alias("_plain"), F.when(turned, N._let(F.concat_ws(" / ", "_m", "label"), task)).alias("_task"),
        F.filter(F.transform("cells", number), lambda x: x["value"].isNotNull()).alias("_cells"),
    ).drop("cells", "columns")
    cell = t.select("*", F.posexplode_outer("_cells").alias("_at", "_cell")).drop("_cells", "_at").select("*", "_cell.*").drop("_cell")  # outer, as Spark would else make the array twice to see whether it is empty
    cell = cell.where("value is not null and size(c.path) > 0")
    bench = F.coalesce(F.get("c.each", F.lit(0)), F.get("_by_row.own", F.lit(0)), F.when(F.size("_captioned") == 1, F.col("_captioned")[0]))
    cell = cell.withColumn("bench", F.when(straight, bench).otherwise(F.col("_b")[0]))
    cell = cell.where(F.when(straight, ~F.col("c.ratio") & F.col("bench").isNotNull() & ((F.size("c.whole") <= 1) & (F.size("_by_row.own") == 0) | (F.size(F.array_union("c.whole", "_by_row.own")) <= 1))).otherwise(F.col("col") > 0))
    if sents is not None:
        own = own_label(F.col("label"), F.col("method"))
        cell = cell.join(author_metrics(cell.where(straight).withColumn("path", F.col("c.path")).withColumn("own", own), sents, papers, id_col), [id_col, "table_id", "col"], "left")
        said = _as_read(F.col("c.path"), F.col("bench"), F.col("told"), F.col("_m"), F.col("_units"))
    else:
        cell = cell.withColumn("told", F.lit(None).cast("string"))
        said = F.get(F.col("c.said"), F.array_position("benchmarks", F.col("bench")).cast("int") - 1)
    bare = N._let(collapse(F.regexp_replace(F.col("label"), _as_word(F.col("bench")), "")), lambda c: model_label(F.when(c != "", c).otherwise(F.col("label"))))
    name = F.when(F.array_contains("_by_row.all", F.col("bench")), _labelled(bare)).otherwise(F.col("_plain"))
    cell = cell.withColumn("_said", F.when(straight, said)).withColumn("_name", F.when(straight, name)).where(F.when(straight, F.col("_said").isNotNull() & F.col("_name.kept")).otherwise(True))
    either = lambda a, b: F.when(straight, F.col(a)).otherwise(b if isinstance(b, Column) else F.col(b))
    none = F.lit(None)
    percent = F.col("c.turned.percent") | F.coalesce(F.array_contains("_units", F.col("_task.unit_key")), F.lit(False))
    out = cell.select(
        id_col, "table_id", "row", "col", F.col("bench").alias("benchmark"), either("_said.metric", "_task.metric").alias("metric"), either("_said.direction", "_way").alias("direction"), "value", "text",
        either("_name.model", "c.turned.model").alias("model"), either("_name.own", "c.turned.own").alias("own"), either("block_id", none).alias("block_id"), either("block", none).alias("block"), "caption",
        F.when(F.col("_name.based"), F.col("row") - 1).alias("base_row"), F.when(straight, "rows").otherwise("transposed").alias("orientation"), F.col("told").isNotNull().alias("told"),
        either("_said.bench_key", N.label_key(F.col("bench"))).alias("bench_key"), either("_said.metric_key", "_task.metric_key").alias("metric_key"), either("_said.percent", percent).alias("_percent"), "averaged_over",
        F.col("_said.parent").alias("_parent"), F.col("_said.mean").alias("_mean"), straight.alias("_straight"),
    )
    group = Window.partitionBy(id_col, "table_id", "benchmark", "_parent")
    out = out.withColumn("_means", F.max("_mean").over(group)).withColumn("_columns", F.size(F.collect_set("col").over(group)))
    once = F.count("*").over(Window.partitionBy(id_col, "table_id", "row", "benchmark", "metric_key")) == 1
    alone = F.col("_once") & ((F.col("_parent") == "") | F.when(F.col("_means"), F.col("_mean")).otherwise(F.col("_columns") <= MAX_COLUMNS_PER_KEY))
    out = out.withColumn("_once", once).where(~F.col("_straight") | alone).drop("_parent", "_mean", "_means", "_columns", "_once", "_straight")
    unit = F.when(F.col("_percent") | F.col("text").contains("%"), "%")
    return out.select("*", unit.alias("unit"), F.format_string("t%d.r%d.c%d", "table_id", "row", "col").alias("locator")).drop("_percent")


def verified_gains(results: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, locator, gain, base_model): signed second numbers that are the value less exactly one other method's in the column.

    The difference must hold within the rounding of the second number. Other methods are those of the same block; a row
    that adds something to the one above (``+ Ours``) is compared with that row alone.
    """
    said = F.regexp_replace("text", IN_BRACKETS, "$1 $2")
    signed = F.regexp_extract(said, GAIN, 2).try_cast("double") * F.when(F.regexp_extract(said, GAIN, 1) == "+", 1).otherwise(-1)
    within = F.lit(0.5) * F.pow(F.lit(10.0), -F.length(F.regexp_extract(said, GAIN, 3))) + 1e-9
    keys = [id_col, "table_id", "col", "block_id"]
    r = results.withColumn("block_id", F.coalesce("block_id", F.lit("")))
    mine = r.withColumn("gain", signed).withColumn("_within", within).where("gain is not null").select(*keys, "locator", "base_row", "value", "gain", "_within")
    base = r.select(*keys, "own", F.col("row").alias("_row"), F.col("locator").alias("_other"), F.col("value").alias("_value"), F.col("model").alias("base_model"), F.col("text").alias("_text"))
    stands = F.when(F.col("base_row").isNull(), ~F.col("own")).otherwise(F.col("_row") == F.col("base_row"))
    met = mine.join(base, keys).where((F.col("_other") != F.col("locator")) & stands & (F.abs(F.col("value") - F.col("_value") - F.col("gain")) <= F.col("_within")))
    one = met.groupBy(id_col, "locator").agg(F.countDistinct("base_model", "_text").alias("_n"), F.first("gain").alias("gain"), F.min("base_model").alias("base_model"))
    return one.where("_n = 1").drop("_n")
