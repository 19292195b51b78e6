"""More registered queries: scans, seeds, lanes, peers and loads, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftwell.operators import cells, impact, merge, signals, terms, text
from driftwell.plans.queries import query, table

_AT = "2024-01-20 00:00:00"
_at = lambda: F.lit(_AT).cast("timestamp")


@query(f"""WITH r AS (SELECT o_custkey AS profile_id, o_orderpriority AS source, CASE WHEN o_orderkey % 3 = 0 THEN 'partial' ELSE 'done' END AS status, o_orderkey AS k,
  TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (o_orderkey % 300) AS a, TIMESTAMP '2024-01-03' + INTERVAL 1 HOUR * (o_orderkey % 400) AS b, o_orderstatus AS sig FROM orders),
l AS (SELECT profile_id, source, unnest(arg_max({{'status': status, 'a': a, 'b': b, 'sig': sig}}, k)) FROM r GROUP BY profile_id, source),
s AS (SELECT c_custkey AS profile_id, CASE WHEN c_custkey % 4 > 0 THEN 'O' END AS signature FROM customer)
SELECT profile_id, source, CASE WHEN coalesce(signature <> sig, false) OR status IS NULL THEN TIMESTAMP '{_AT}' - INTERVAL 7 DAY
  ELSE least(CASE WHEN status = 'done' THEN b ELSE a END, TIMESTAMP '{_AT}' - INTERVAL 5 DAY) END AS since, sig AS topic_signature FROM l FULL JOIN s USING (profile_id)""")
def next_cursor(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    hours = lambda day, n: F.lit(day).cast("timestamp") + F.make_dt_interval(hours=(F.col("o_orderkey") % n).cast("int"))
    runs = o.select(
        F.col("o_custkey").alias("profile_id"), F.col("o_orderpriority").alias("source"), F.when(F.col("o_orderkey") % 3 == 0, "partial").otherwise("done").alias("status"), F.col("o_orderkey").alias("started_at"),
        hours("2024-01-01", 300).alias("window_from"), hours("2024-01-03", 400).alias("window_to"), F.col("o_orderstatus").alias("topic_signature"),
    )
    now = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("profile_id"), F.when(F.col("c_custkey") % 4 > 0, "O").alias("signature"))
    return signals.next_cursor(runs, _at(), signatures=now)


@query("""WITH a AS (SELECT o_custkey AS seed, CASE WHEN sum((o_orderstatus = 'O')::INT) = count(*) THEN 'done' WHEN sum((o_orderstatus = 'F')::INT) = count(*) THEN 'failed' ELSE 'partial' END AS status FROM orders GROUP BY 1),
n AS (SELECT user_id AS seed, count(*) AS returned FROM events GROUP BY 1)
SELECT c_custkey AS seed, coalesce(status, 'not_attempted') AS status, coalesce(returned, 0) AS returned FROM customer LEFT JOIN a ON a.seed = c_custkey LEFT JOIN n ON n.seed = c_custkey""")
def seed_states(spark, sf_dir):
    state = F.when(F.col("o_orderstatus") == "O", "done").when(F.col("o_orderstatus") == "F", "failed").otherwise("partial")
    attempts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("seed"), state.alias("status"))
    return signals.seed_states(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seed")), attempts, table(spark, sf_dir, "events").select(F.col("user_id").alias("seed")))


@query("""SELECT o_custkey AS profile_id, count(*) AS scans, count(*) FILTER (o_orderstatus <> 'P') AS observed, count(*) FILTER (o_orderpriority LIKE '1%') AS failed,
count(*) FILTER (o_orderstatus = 'P' AND o_orderpriority NOT LIKE '1%' AND o_orderpriority NOT LIKE '2%') AS incomplete, count(*) FILTER (o_orderpriority LIKE '2%') AS deferred FROM orders GROUP BY 1""")
def scan_counts(spark, sf_dir):
    error = F.when(F.col("o_orderpriority").startswith("1"), "timed out").when(F.col("o_orderpriority").startswith("2"), "deferred: later")
    scans = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("profile_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("observations"), error.alias("observation_error"))
    return signals.scan_health(scans)


_CORE = ("the", "und", "les", "que")
_SQL_SCAN = r"""h AS (SELECT doc_id, source, lang, n_chars, list_filter(['the', 'und', 'les', 'que'], lambda w: regexp_matches(text, '(?i)(?:^|[^a-z])' || w || '(?:[^a-z]|$)')) AS core, regexp_matches(text, '(?i)(?:^|[^a-z])(?:de|der)(?:[^a-z]|$)') AS ex,
  CASE WHEN doc_id % 11 > 0 THEN DATE '2024-01-01' + (doc_id % 17)::INT END AS day FROM documents),
j AS (SELECT *, len(core) > 0 AND NOT ex AS eligible FROM h),
r AS (SELECT *, CASE WHEN eligible THEN row_number() OVER (PARTITION BY source, eligible ORDER BY len(core) DESC, doc_id) END AS rank_pos, CASE WHEN eligible THEN row_number() OVER (PARTITION BY source, eligible ORDER BY n_chars DESC, doc_id) END AS rank_before FROM j)"""


def _scan(spark, sf_dir):
    word = lambda w: F.col("text").rlike(rf"(?i)(?:^|[^a-z])(?:{w})(?:[^a-z]|$)")
    d = table(spark, sf_dir, "documents")
    day = F.when(F.col("doc_id") % 11 > 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 17).cast("int")))
    d = d.select("doc_id", "source", "n_chars", F.array_compact(F.array(*[F.when(word(w), F.lit(w)) for w in _CORE])).alias("core_hits"), F.when(word("de|der"), F.array(F.lit("de"))).otherwise(F.array().cast("array<string>")).alias("exclude_hits"), day.alias("day"))
    d = d.withColumn("eligible", (F.size("core_hits") > 0) & (F.size("exclude_hits") == 0)).withColumn("scan_day", F.lit("2024-01-20").cast("date"))
    d = d.withColumn("filter_reason", F.when(F.size("exclude_hits") > 0, "excluded").when(F.size("core_hits") == 0, "no_core_hit")).withColumn("tier", F.when(F.size("core_hits") > 1, 0).otherwise(1))
    place = lambda *order: F.when(F.col("eligible"), F.row_number().over(Window.partitionBy("source", "eligible").orderBy(*order, "doc_id")))
    return d.withColumn("rank_pos", place(F.desc(F.size("core_hits")))).withColumn("rank_before", place(F.desc("n_chars")))


@query(f"""WITH {_SQL_SCAN}, m AS (SELECT *, max(day) FILTER (eligible) OVER (PARTITION BY source) AS newest, coalesce(rank_pos <= 10, false) AS top, list_has_any(core, ['the', 'und']) AS anchored, list_has_any(core, ['les', 'que']) AS auto FROM r)
SELECT source, count(*) AS rows, count(*) FILTER (eligible) AS n_eligible, count(*) FILTER (top) AS n_top, count(*) FILTER (top AND anchored) / nullif(count(*) FILTER (top), 0)::DOUBLE AS anchor_share_top,
count(*) FILTER (eligible AND anchored) / nullif(count(*) FILTER (eligible), 0)::DOUBLE AS anchor_share_eligible, count(*) FILTER (auto AND ex) / nullif(count(*) FILTER (auto), 0)::DOUBLE AS exclude_collision_auto,
count(*) FILTER (top AND len(core) > 1) / nullif(count(*) FILTER (top), 0)::DOUBLE AS top_tier_share, count(*) FILTER (eligible AND auto AND NOT anchored) AS new_from_auto,
count(*) FILTER (top AND day = newest) / nullif(count(*) FILTER (top AND newest IS NOT NULL), 0)::DOUBLE AS freshness, avg(DATE '2024-01-20' - day) FILTER (top) AS mean_delay_days,
count(*) FILTER (top AND rank_before <= 10) / nullif(count(*) FILTER (top), 0)::DOUBLE AS retention FROM m GROUP BY source""")
def scan_measures(spark, sf_dir):
    rows = _scan(spark, sf_dir)
    before = rows.select("source", "doc_id", F.col("rank_before").alias("rank_pos"))
    return impact.scan_measures(rows, "source", F.array(F.lit("the"), F.lit("und")), 10, before)


@query(f"""WITH {_SQL_SCAN}, k AS (SELECT unnest(['the', 'und', 'les', 'que', 'zzz']) AS keyword)
SELECT source, keyword, count(*) FILTER (list_contains(core, keyword)) AS n FROM r, k GROUP BY ALL""")
def keyword_survival(spark, sf_dir):
    words = spark.createDataFrame([(w,) for w in (*_CORE, "zzz")], "keyword string")
    return impact.keyword_hits(_scan(spark, sf_dir), "source", words)


@query(f"""WITH {_SQL_SCAN}, e AS (SELECT *, unnest(list_distinct([source, lang, CASE WHEN n_chars > 500 THEN 'long' ELSE source END])) AS seed FROM r)
SELECT seed, count(*) AS returned, count(*) FILTER (eligible) AS n_eligible, count(*) FILTER (NOT eligible) AS noise FROM e GROUP BY seed""")
def seed_noise(spark, sf_dir):
    lang = table(spark, sf_dir, "documents").select("doc_id", "lang")
    seeds = F.array("source", "lang", F.when(F.col("n_chars") > 500, "long").otherwise(F.col("source")))
    return impact.seed_noise(_scan(spark, sf_dir).join(lang, "doc_id").withColumn("seeds", seeds))


_SQL_RESULTS = """r AS (SELECT l_suppkey AS table_id, l_linenumber AS col, l_orderkey AS row_no, l_orderkey || '.' || l_linenumber AS locator, CASE l_partkey % 5 WHEN 0 THEN 'Foo-' || l_partkey WHEN 1 THEN 'Bar w/ ' || l_partkey ELSE 'Net ' || l_partkey END AS model,
  l_returnflag = 'R' AS own, l_extendedprice AS value, CASE l_linenumber % 3 WHEN 0 THEN 'lower' WHEN 1 THEN 'higher' END AS direction FROM lineitem),
m AS (SELECT table_id, col, min_by(locator, row_no) AS main, min_by(value, row_no) AS v FROM r WHERE own GROUP BY ALL)"""


def _results(spark, sf_dir):
    o = F.col("l_partkey") % 5
    part = F.col("l_partkey").cast("string")
    model = F.when(o == 0, F.concat(F.lit("Foo-"), part)).when(o == 1, F.concat(F.lit("Bar w/ "), part)).otherwise(F.concat(F.lit("Net "), part))
    way = F.when(F.col("l_linenumber") % 3 == 0, "lower").when(F.col("l_linenumber") % 3 == 1, "higher")
    locator = F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    r = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("table_id"), F.col("l_linenumber").alias("col"), F.col("l_orderkey").alias("row_no"), locator.alias("locator"), model.alias("model"), (F.col("l_returnflag") == "R").alias("own"), F.col("l_extendedprice").alias("value"), way.alias("direction"))
    mains = r.where("own").groupBy("table_id", "col").agg(F.min_by("locator", "row_no").alias("locator"), F.min_by("value", "row_no").alias("value")).withColumn("method", F.lit("FOO"))
    return r, mains


@query(f"""WITH {_SQL_RESULTS}, p AS (SELECT r.*, main, row_number() OVER (PARTITION BY table_id, col ORDER BY CASE direction WHEN 'lower' THEN value WHEN 'higher' THEN -value END NULLS LAST, row_no, model, value) AS place FROM r JOIN m USING (table_id, col) WHERE NOT own AND model LIKE 'Net%')
SELECT table_id, col, main, model, value, place FROM p WHERE place <= 3""")
def group_peers(spark, sf_dir):
    r, mains = _results(spark, sf_dir)
    return cells.peers(r, mains, ["table_id", "col"]).select("table_id", "col", "main", "model", "value", "place")


@query(f"""WITH {_SQL_RESULTS} SELECT table_id, col, count(*) AS n, count(*) FILTER (CASE direction WHEN 'higher' THEN value > v WHEN 'lower' THEN value < v ELSE false END) AS better FROM r JOIN m USING (table_id, col) WHERE own AND locator <> main GROUP BY ALL""")
def own_siblings(spark, sf_dir):
    r, mains = _results(spark, sf_dir)
    return cells.own_siblings(r, mains, ["table_id", "col"]).groupBy("table_id", "col").agg(F.count("*").alias("n"), F.count_if("better").alias("better"))


@query("""WITH RECURSIVE f AS (SELECT source || '-' || lang AS term, count(*) AS support, count(*) FILTER (n_chars > 900) AS domain_docs, count(DISTINCT n_chars % 7) AS breadth, max(doc_id) AS newest FROM documents GROUP BY 1),
l AS (SELECT list(term ORDER BY support DESC, domain_docs / support DESC, term) AS l0, list(term ORDER BY domain_docs / support DESC, support DESC, term) FILTER (domain_docs > 0) AS l1, list(term ORDER BY breadth DESC, newest DESC, support DESC, term) FILTER (breadth >= 7) AS l2 FROM f),
p AS (SELECT 0 AS i, []::VARCHAR[] AS seen, NULL::VARCHAR AS term, NULL::INT AS lane UNION ALL
  SELECT i + 1, list_append(seen, coalesce(mine, free)), coalesce(mine, free), CASE WHEN mine IS NOT NULL THEN i % 3 ELSE 0 END FROM (
    SELECT i, seen, list_filter([coalesce(l0, []), coalesce(l1, []), coalesce(l2, [])][i % 3 + 1], lambda t: NOT list_contains(seen, t))[1] AS mine, list_filter(l0, lambda t: NOT list_contains(seen, t))[1] AS free FROM p, l WHERE i < 12))
SELECT term, lane, row_number() OVER (ORDER BY i) AS place FROM p WHERE term IS NOT NULL""")
def term_lanes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("term", F.concat_ws("-", "source", "lang"))
    f = d.groupBy("term").agg(F.count("*").alias("support"), F.count_if(F.col("n_chars") > 900).alias("domain_docs"), F.countDistinct(F.col("n_chars") % 7).alias("breadth"), F.max("doc_id").alias("newest"))
    return terms.lanes(f, least_breadth=7)


@query("""WITH f AS (SELECT o_custkey AS profile_id, o_orderkey AS paper_key, ['useful', 'known', 'odd'][o_orderkey % 3 + 1] AS usefulness, CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE o_orderstatus END AS claim, CASE WHEN o_orderkey % 5 = 0 THEN 'supported' ELSE 'unassessed' END AS support FROM orders),
d AS (SELECT DISTINCT l_orderkey AS paper_key FROM lineitem WHERE l_returnflag = 'R')
SELECT profile_id, f.paper_key, CASE WHEN usefulness = 'odd' THEN 'unknown_value' WHEN support <> 'unassessed' AND trim(claim) = '' THEN 'claim_missing' WHEN d.paper_key IS NULL THEN 'not_delivered' END AS reason FROM f LEFT JOIN d USING (paper_key)""")
def feedback_load(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    useful = F.element_at(F.array(*map(F.lit, ("useful", "known", "odd"))), (k % 3 + 1).cast("int"))
    f = o.select(F.col("o_custkey").alias("profile_id"), k.alias("paper_key"), useful.alias("usefulness"), F.when(k % 2 == 0, " ").otherwise(F.col("o_orderstatus")).alias("claim"), F.when(k % 5 == 0, "supported").otherwise("unassessed").alias("support"))
    sent = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("paper_key")).join(f.select("profile_id", "paper_key"), "paper_key")
    return merge.feedback_load(f, sent, ["useful", "known"], ["supported", "unsupported", "unclear"]).select("profile_id", "paper_key", "reason")


@query("SELECT o_orderkey, o_orderdate::DATE AS day FROM orders WHERE o_orderdate::DATE >= DATE '1998-01-01' - 200 AND o_orderdate::DATE < DATE '1998-01-01'")
def recent_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return merge.recent(o, "day", F.lit("1998-01-01").cast("date"), 200, then=("o_orderkey",))


@query(r"""WITH d AS (SELECT doc_id, text, strpos(text, regexp_extract(text, '[A-Z][a-z]+ing')) - 1 AS p FROM documents WHERE regexp_matches(text, '[A-Z][a-z]+ing'))
SELECT doc_id, CASE WHEN p > 60 THEN '…' ELSE '' END || trim(regexp_replace(substr(text, greatest(p - 60, 0) + 1, least(p + 60, length(text)) - greatest(p - 60, 0)), '\s+', ' ', 'g'), ' ') || CASE WHEN p + 60 < length(text) THEN '…' ELSE '' END AS context FROM d""")
def flag_context(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.around(F.col("text"), "[A-Z][a-z]+ing").alias("context")).where("context is not null")
