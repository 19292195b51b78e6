"""Registered queries on what was missed, moved, repeated and logged, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftwell.operators import impact, similar
from driftwell.plans.queries import query, table
from driftwell.sources import readers


@query("""WITH i AS (SELECT c_custkey AS item_id, c_nationkey AS profile_id, TIMESTAMP '1995-01-01' + INTERVAL 1 DAY * (c_custkey % 900) AS at, CASE c_custkey % 4 WHEN 0 THEN '1994' WHEN 1 THEN strftime(DATE '1993-01-01' + (c_custkey * 7 % 1500)::INT, '%Y-%m') ELSE strftime(DATE '1993-01-01' + (c_custkey * 7 % 1500)::INT, '%Y-%m-%d') END AS published FROM customer),
o AS (SELECT o_custkey AS key, o_orderkey, o_orderdate::TIMESTAMP AS at, CASE o_orderkey % 6 WHEN 0 THEN 'content' WHEN 1 THEN 'title_only' WHEN 2 THEN 'reserve' WHEN 3 THEN 'dropped' ELSE 'filtered' END AS outcome, CASE WHEN o_orderkey % 6 < 3 THEN NULL WHEN o_orderkey % 6 = 3 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'exclude_hit' END WHEN o_orderkey % 5 = 0 THEN 'already_shown' WHEN o_orderkey % 5 < 3 THEN 'exclude_hit' ELSE 'no_core_hit' END AS reason, o_orderpriority AS pri FROM orders),
p AS (SELECT n_nationkey AS profile_id, TIMESTAMP '1995-03-01' + INTERVAL 30 DAY * (n_nationkey % 12) AS first_scan, TIMESTAMP '1994-01-01' + INTERVAL 20 DAY * n_nationkey AS monitored FROM nation),
k AS (SELECT i.*, first_scan, CASE WHEN i.at >= first_scan THEN CASE WHEN n_scans > 0 THEN first_scan + INTERVAL 40 DAY * (date_diff('day', first_scan, i.at) // 40) END END AS scan, CASE WHEN i.at >= first_scan THEN monitored END AS monitored FROM i JOIN p USING (profile_id), (SELECT 1 AS n_scans)),
l AS (SELECT item_id, unnest(arg_max({'outcome': outcome, 'reason': reason}, (o.at, outcome, coalesce(reason, '')))) FROM k JOIN o ON o.key = item_id AND o.at <= k.at GROUP BY item_id),
d AS (SELECT DISTINCT item_id FROM k JOIN o ON o.key = item_id AND pri = '1-URGENT' AND o.at + INTERVAL 200 DAY <= k.at)
SELECT item_id, CASE WHEN scan IS NULL OR (length(published) = 10 AND published > strftime(scan, '%Y-%m-%d')) THEN 'not_yet_evaluable' WHEN item_id IN (SELECT item_id FROM d) THEN 'captured'
  WHEN l.outcome IS NULL AND ((length(published) = 10 AND published < strftime(monitored, '%Y-%m-%d')) OR (length(published) = 7 AND published < strftime(monitored, '%Y-%m'))) THEN 'before_monitoring' WHEN l.outcome IS NULL AND length(published) < 10 THEN 'not_yet_evaluable' WHEN l.outcome IS NULL THEN 'not_retrieved'
  WHEN l.outcome IN ('content', 'title_only') OR l.reason = 'already_shown' THEN 'not_delivered' WHEN l.outcome = 'reserve' OR (l.outcome = 'dropped' AND l.reason IS NULL) THEN 'ranked_out' WHEN l.reason = 'exclude_hit' THEN 'excluded' ELSE 'no_core_hit' END AS gap_stage FROM k LEFT JOIN l USING (item_id)""")
def gap_stages(spark, sf_dir):
    """Customers as items found at some day, their orders as observations and deliveries, nations as profiles with their scans."""
    days = lambda base, n: F.lit(base).cast("timestamp") + F.make_dt_interval(days=n.cast("int"))
    c, o, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "nation")
    day = F.date_add(F.lit("1993-01-01").cast("date"), (F.col("c_custkey") * 7 % 1500).cast("int"))
    published = F.when(F.col("c_custkey") % 4 == 0, "1994").when(F.col("c_custkey") % 4 == 1, F.date_format(day, "yyyy-MM")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    items = c.select(F.col("c_custkey").alias("item_id"), F.col("c_nationkey").alias("profile_id"), days("1995-01-01", F.col("c_custkey") % 900).alias("discovered_at"), published.alias("published"), F.lit("").alias("title"), F.array(F.col("c_custkey")).alias("keys"))
    k, five = F.col("o_orderkey") % 6, F.col("o_orderkey") % 5
    outcome = F.when(k == 0, "content").when(k == 1, "title_only").when(k == 2, "reserve").when(k == 3, "dropped").otherwise("filtered")
    reason = F.when(k < 3, None).when(k == 3, F.when(F.col("o_orderkey") % 2 == 0, "exclude_hit")).when(five == 0, "already_shown").when(five < 3, "exclude_hit").otherwise("no_core_hit")
    seen = o.join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("profile_id")), "o_custkey")
    obs = seen.select("profile_id", F.col("o_custkey").alias("paper_key"), F.lit(None).cast("string").alias("title"), outcome.alias("outcome"), reason.alias("filter_reason"), F.col("o_orderdate").cast("timestamp").alias("observed_at"))
    sent = seen.where("o_orderpriority = '1-URGENT'").select("profile_id", F.col("o_custkey").alias("paper_key"), (F.col("o_orderdate").cast("timestamp") + F.expr("interval 200 days")).alias("sent_at"))
    first = days("1995-03-01", F.col("n_nationkey") % 12 * 30)
    scans = n.select(F.col("n_nationkey").alias("profile_id"), F.explode(F.sequence(first, F.lit("1998-01-01").cast("timestamp"), F.expr("interval 40 days"))).alias("started_at"))
    runs = n.select(F.col("n_nationkey").alias("profile_id"), first.alias("started_at"), days("1994-01-01", F.col("n_nationkey") * 20).alias("window_from"))
    return impact.gap_stage(items, scans, obs, sent, runs).select("item_id", "gap_stage")


_RUN = """SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN 'day' ELSE 'year' END AS precision, n_chars, list_filter(['the', 'und', 'les', 'que'], lambda w: regexp_matches(text, '(?i)(?:^|[^a-z])' || w || '(?:[^a-z]|$)')) AS core, regexp_matches(text, '(?i)(?:^|[^a-z])de(?:[^a-z]|$)') AS de, regexp_matches(text, '(?i)(?:^|[^a-z])el(?:[^a-z]|$)') AS el FROM documents"""


@query(f"""WITH h AS ({_RUN}),
a AS (SELECT doc_id, source, precision, list_filter(core, lambda w: w IN ('the', 'und')) AS core, de AS ex, CASE WHEN list_contains(core, 'the') THEN 1.0 ELSE 0.5 END AS w, n_chars FROM h),
b AS (SELECT doc_id, source, precision, list_filter(core, lambda w: w IN ('the', 'les', 'que')) AS core, el AS ex, CASE WHEN list_contains(core, 'the') THEN 0.8 WHEN list_contains(core, 'les') THEN 0.7 ELSE 0.6 END AS w, n_chars FROM h),
x AS (SELECT *, row_number() OVER (PARTITION BY len(core) > 0 AND NOT ex ORDER BY n_chars DESC, doc_id) AS r FROM a), y AS (SELECT *, row_number() OVER (PARTITION BY len(core) > 0 AND NOT ex ORDER BY len(core) DESC, n_chars DESC, doc_id) AS r FROM b),
j AS (SELECT x.doc_id, x.source, x.precision, len(x.core) > 0 AS ha, len(y.core) > 0 AS hb, len(x.core) > 0 AND NOT x.ex AS ea, len(y.core) > 0 AND NOT y.ex AS eb, y.ex AS exb, x.r AS xr, y.r AS yr, x.w AS wa, y.w AS wb, y.core AS cb FROM x JOIN y USING (doc_id)),
k AS (SELECT *, CASE WHEN ea THEN xr END AS ra, CASE WHEN eb THEN yr END AS rb, ea AND xr <= 40 AS ia, eb AND yr <= 40 AS ib FROM j)
SELECT 'count' AS part, unnest(['eligible_before', 'eligible_after', 'gained', 'entered', 'left', 'newly_hit']) AS name, NULL::DOUBLE AS value, unnest([count(*) FILTER (ea), count(*) FILTER (eb), count(*) FILTER (eb AND NOT ea), count(*) FILTER (ib AND NOT ia), count(*) FILTER (ia AND NOT ib), count(*) FILTER (hb AND NOT ha)]) AS n FROM k
UNION ALL SELECT 'lost', CASE WHEN exb THEN 'exclude_hit' ELSE 'no_core_hit' END, NULL, count(*) FROM k WHERE ea AND NOT eb GROUP BY 2
UNION ALL SELECT 'rank_move', doc_id::VARCHAR, (rb - ra)::DOUBLE, rb FROM k WHERE (ia OR ib) AND ra IS DISTINCT FROM rb
UNION ALL SELECT 'weight_move', doc_id::VARCHAR, round(wb::DOUBLE - wa::DOUBLE, 9), 0 FROM k WHERE ea AND eb AND wa <> wb
UNION ALL SELECT 'exclude_risk', 'rate', count(*) FILTER (hb AND NOT ha AND exb) / nullif(count(*) FILTER (hb AND NOT ha), 0)::DOUBLE, count(*) FILTER (hb AND NOT ha AND exb) FROM k
UNION ALL SELECT 'added_term', t, NULL, count(*) FROM (SELECT unnest(cb) AS t FROM k) WHERE t <> 'the' GROUP BY t
UNION ALL SELECT 'admitted_by', cb[1], NULL, count(*) FROM k WHERE eb AND NOT ea GROUP BY 2
UNION ALL SELECT 'source_precision', source || '|' || precision || '|' || CASE WHEN ia AND ib THEN 'stayed' WHEN ib THEN 'entered' ELSE 'left' END, NULL, count(*) FROM k WHERE ia OR ib GROUP BY 2""")
def profile_impact(spark, sf_dir):
    """Two profiles over the documents: terms, exclusions, weights and order all change between them."""
    has = lambda w: F.col("text").rlike(rf"(?i)(?:^|[^a-z])(?:{w})(?:[^a-z]|$)")
    d = table(spark, sf_dir, "documents").withColumn("precision", F.when(F.col("doc_id") % 3 == 0, "day").otherwise("year"))

    def run(words: dict, exclude: str, order: list):
        hits, none = F.array_compact(F.array(*[F.when(has(w), F.lit(w)) for w in words])), F.array().cast("array<string>")
        weight = F.array_max(F.transform("core_hits", lambda h: F.create_map(*[F.lit(x) for kv in words.items() for x in kv])[h]))
        r = d.select("doc_id", "source", "precision", "n_chars", hits.alias("core_hits"), F.when(has(exclude), F.array(F.lit(exclude))).otherwise(none).alias("exclude_hits"))
        r = r.withColumn("eligible", (F.size("core_hits") > 0) & (F.size("exclude_hits") == 0)).withColumn("tier", F.lit(0)).withColumn("top_weight", weight)
        return r.withColumn("rank_pos", F.when(F.col("eligible"), F.row_number().over(Window.partitionBy("eligible").orderBy(*order, F.desc("n_chars"), "doc_id")))).drop("n_chars")

    out = impact.profile_impact(run({"the": 1.0, "und": 0.5}, "de", []), run({"the": 0.8, "les": 0.7, "que": 0.6}, "el", [F.desc(F.size("core_hits"))]), 40)
    return out.withColumn("value", F.when(F.col("part") == "weight_move", F.round("value", 9)).otherwise(F.col("value")))


@query(r"""WITH t AS (SELECT page_id, regexp_extract(url, '/([a-z][a-z])/', 1) AS g, trim(regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[^a-z0-9]+', ' ', 'g')) AS t FROM pages),
s AS (SELECT page_id, g, t, CASE WHEN length(t) = 0 THEN [] WHEN length(t) < 3 THEN [t] ELSE list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i::INT, 3))) END AS s FROM t)
SELECT a.page_id FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.page_id <> a.page_id AND b.g = a.g AND a.t <> '' AND b.t <> '' AND (a.t = b.t OR len(list_intersect(a.s, b.s)) >= 0.45 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) - 1e-9))""")
def distinct_items(spark, sf_dir):
    """Pages by the language of their address, without those whose titles are nearly another's of that language."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "/([a-z][a-z])/", 1).alias("g"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return similar.drop_near_duplicates(p, "g", "page_id", "title", 0.45).select("page_id")


@query("""WITH l AS (SELECT event_id, ts, CASE event_type WHEN 'signup' THEN 's' WHEN 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN 'k' ELSE 'e' END ELSE 'x' END AS kind, event_type = 'error' AS warn, floor(value)::INT AS v FROM events),
c AS (SELECT *, count(*) FILTER (kind = 's') OVER (ORDER BY ts, event_id) AS block FROM l), e AS (SELECT block, min((ts, event_id)) AS closed FROM c WHERE kind = 'e' AND block > 0 GROUP BY block),
i AS (SELECT c.*, closed FROM c LEFT JOIN e USING (block) WHERE block > 0 AND kind <> 'k' AND (closed IS NULL OR (ts, event_id) <= closed))
SELECT block::INT AS block, min(event_id) FILTER (kind = 's') AS first_line, max(event_id) FILTER (kind = 'e') AS last_line, count(*) AS n_lines, count(*) FILTER (warn) AS warnings, arg_max(v, (ts, event_id)) FILTER (kind = 'x') AS calls, max(v) FILTER (kind = 'e') AS exit_code FROM i GROUP BY block
UNION ALL SELECT NULL, event_id, event_id, 1, 0, NULL, NULL FROM c WHERE kind = 'k'""")
def log_runs(spark, sf_dir):
    """The events as the lines of one log: signups start a run, purchases end it, each fourth purchase tells of a skipped run."""
    kind, v = F.col("event_type"), F.floor("value").cast("string")
    end = kind == "purchase"
    line = F.when(kind == "signup", F.lit("=== start ===")).when(end & (F.col("event_id") % 4 == 0), F.lit("=== skipped ===")).when(end, F.concat(F.lit("=== end (exit "), v, F.lit(")"))).when(kind == "error", F.concat(F.lit("WARN calls="), v)).otherwise(F.concat(F.lit("calls="), v))
    lines = table(spark, sf_dir, "events").select(F.lit("log").alias("file"), "ts", "event_id", line.alias("value"))
    has = lambda s: F.col("value").contains(s)
    r = readers.run_blocks(lines, "file", ["ts", "event_id"], has("start"), has("end (exit"), skipped=has("skipped"))
    return r.select("block", F.col("started.event_id").alias("first_line"), F.col("ended.event_id").alias("last_line"), "n_lines", "warnings", "calls", "exit_code")
