"""More registered queries: evidence, issues, replay and the scalar builders, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftwell.functions import keys as K
from driftwell.operators import asof, evidence, history, impact, match, rank, signals, text
from driftwell.plans.queries import PROFILE_ROWS, SQL_HITS, query, table

NOW = "2024-02-01"
_now = lambda: F.lit(NOW).cast("date")
_TITLE = r"regexp_extract(html, '<title>([^<]*)</title>', 1)"
_title = lambda: F.regexp_extract("html", r"<title>([^<]*)</title>", 1)


@query(r"""WITH i AS (SELECT doc_id AS item_id, source AS owner, 'measured ' || (n_chars + 10) || ' characters, surely ' || lang AS text, CASE doc_id % 5 WHEN 0 THEN [] WHEN 1 THEN ['e' || doc_id, 'e' || (doc_id + 1)] ELSE ['e' || doc_id] END AS ev FROM documents),
x AS (SELECT source AS owner, 'e' || doc_id AS id, 'it has ' || (n_chars + 10 + (doc_id % 3 = 0)::INT) || ' of them' AS excerpt FROM documents),
c AS (SELECT item_id, count(*) FILTER (x.id IS NULL) AS bad, list(regexp_extract(excerpt, '[0-9]+')) AS said FROM (SELECT item_id, owner, unnest(ev) AS id FROM i) e LEFT JOIN x USING (owner, id) GROUP BY item_id)
SELECT item_id, CASE WHEN len(ev) = 0 THEN 'no_evidence' WHEN bad > 0 THEN 'foreign_evidence' WHEN length(text) > 33 THEN 'too_long' WHEN text LIKE '%surely de%' THEN 'assertive' WHEN NOT list_contains(said, regexp_extract(text, '[0-9]+')) THEN 'ungrounded_number' END AS reason FROM i LEFT JOIN c USING (item_id)""")
def accept_items(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    ident = lambda n: F.concat(F.lit("e"), (F.col("doc_id") + n).cast("string"))
    r = F.col("doc_id") % 5
    cited = F.when(r == 0, F.array().cast("array<string>")).when(r == 1, F.array(ident(0), ident(1))).otherwise(F.array(ident(0)))
    items = d.select(F.col("doc_id").alias("item_id"), F.col("source").alias("owner"), F.concat(F.lit("measured "), (F.col("n_chars") + 10).cast("string"), F.lit(" characters, surely "), "lang").alias("text"), cited.alias("evidence"))
    said = F.concat(F.lit("it has "), (F.col("n_chars") + 10 + (F.col("doc_id") % 3 == 0).cast("int")).cast("string"), F.lit(" of them"))
    excerpts = d.select(F.col("source").alias("owner"), ident(0).alias("evidence_id"), said.alias("excerpt"))
    return evidence.accept_items(items, excerpts, max_chars=33, assertive="surely de").select("item_id", "reason")


@query(r"""SELECT doc_id AS paper_key, substr(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), ' '), 1, 600) AS excerpt FROM documents
WHERE n_chars % 3 = n_chars % 2 AND lang <> 'de' AND (doc_id % 10) / 10.0 >= 0.8 AND array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), ' ') <> ''""")
def result_excerpts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    s = d.select(F.col("doc_id").alias("paper_key"), (F.col("n_chars") % 3).alias("numbers_total"), (F.col("n_chars") % 2).alias("numbers_matched"), F.when(F.col("lang") == "de", "planned").when(F.col("lang").isNotNull(), "measured").alias("coverage_kind"), ((F.col("doc_id") % 10) / 10).alias("coverage_ratio"), F.split("text", "\n").alias("results"))
    return evidence.result_excerpts(s)


@query(r"""WITH s AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS sentence, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS sid FROM documents),
b AS (SELECT doc_id, unnest(['the', 'les', 'von']) AS bench FROM documents),
f AS (SELECT doc_id, bench, sid, sentence, regexp_matches(sentence, '^[A-Z]') AS caption, NOT regexp_matches(sentence, '(?i)with') AS other FROM s JOIN b USING (doc_id)
WHERE length(sentence) <= 2000 AND regexp_matches(sentence, '(?i)and|ion|en') AND regexp_matches(sentence, '[0-9]+') AND len(regexp_extract_all(sentence, '[0-9]+')) < 7 AND NOT contains(sentence, '\') AND regexp_matches(sentence, '(?i)(?:^|[^\w-])' || bench || '(?:[^\w-]|$)'))
SELECT doc_id, bench, arg_min(sid, (caption, other, sid)) AS sid, length(arg_min(sentence, (caption, other, sid))) AS n FROM f GROUP BY doc_id, bench""")
def performance_evidence(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    s = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "sentence")).select("doc_id", (F.col("p") + 1).alias("sid"), "sentence")
    b = d.select("doc_id", F.explode(F.array(*map(F.lit, ("the", "les", "von")))).alias("bench"))
    return evidence.performance_evidence(s, b, "(?i)and|ion|en", "[0-9]+", "(?i)with", "^[A-Z]", longest=2000).select("doc_id", "bench", "sid", F.length("sentence").alias("n"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderdate AS d, unnest(['c' || o_custkey, 'p' || floor(o_totalprice / 50)::BIGINT]) AS alias, o_orderstatus FROM orders),
n AS (SELECT alias, arg_max(k, (d, k)) AS newest FROM o GROUP BY alias) SELECT k, min(o_orderstatus) AS status FROM o JOIN n USING (alias) GROUP BY k HAVING bool_and(newest = k)""")
def newest_of_aliases(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    aliases = F.array(F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.concat(F.lit("p"), F.floor(F.col("o_totalprice") / 50).cast("string")))
    items = o.select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("at"), aliases.alias("aliases"), F.col("o_orderstatus").alias("status"))
    return evidence.newest_of_aliases(items, "k", "at").select("k", "status")


@query(rf"""WITH t AS (SELECT page_id, {_TITLE} AS title, trim(regexp_replace(lower({_TITLE}), '[^a-z0-9]+', ' ', 'g')) AS t, CASE WHEN page_id % 3 = 0 THEN page_id END AS k FROM pages),
o AS (SELECT t, arg_max(k, page_id) FILTER (k IS NOT NULL) AS k FROM t GROUP BY t)
SELECT page_id, coalesce(CASE WHEN page_id % 2 = 0 THEN t.k END, o.k) AS matched, CASE WHEN page_id % 2 = 0 AND t.k IS NOT NULL THEN 'id' WHEN o.k IS NOT NULL THEN 'title' END AS how
FROM t LEFT JOIN o ON o.t = t.t AND list_max(list_transform(string_split(t.t, ' '), lambda x: length(x))) >= 5""")
def title_fallback(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", _title().alias("title"))
    seen = p.where("page_id % 3 = 0").select(F.col("page_id").alias("k"), "title", F.col("page_id").alias("at"))
    items = p.withColumn("k", F.when(F.col("page_id") % 6 == 0, F.col("page_id")))
    return evidence.by_id_or_title(items, seen, "page_id", "k", "title", "at")


_AXES = ("the", "les", "und", "que", "zzz")
_SQL_AXES = r"""i AS (SELECT doc_id, text, DATE '2023-06-01' + (doc_id % 240)::INT AS published, ['s' || source || (doc_id % 40), 'n' || n_chars] AS aliases, ['captured', 'excluded', 'ranked_out'][doc_id % 3 + 1] AS gap_stage FROM documents),
e AS (SELECT i.*, term FROM i, (SELECT unnest(['the', 'les', 'und', 'que', 'zzz']) AS term) WHERE published BETWEEN DATE '2024-02-01' - 183 AND DATE '2024-02-01' AND regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}])' || term || '(?:[^\p{L}\p{N}]|$)')),
x AS (SELECT term, doc_id, gap_stage, unnest(aliases) AS alias FROM e), f AS (SELECT term, alias, min(doc_id) AS first FROM x GROUP BY ALL),
k AS (SELECT term, doc_id, min(gap_stage) AS gap_stage FROM x JOIN f USING (term, alias) GROUP BY term, doc_id HAVING bool_and(first = doc_id)),
g AS (SELECT term, count(*) AS papers, count(*) FILTER (gap_stage <> 'captured') AS missed FROM k GROUP BY term HAVING count(*) >= 2)"""


def _axis_items(d):
    stage = F.element_at(F.array(*map(F.lit, ("captured", "excluded", "ranked_out"))), (F.col("doc_id") % 3 + 1).cast("int"))
    aliases = F.array(F.concat(F.lit("s"), "source", (F.col("doc_id") % 40).cast("string")), F.concat(F.lit("n"), F.col("n_chars").cast("string")))
    day = F.date_add(F.lit("2023-06-01").cast("date"), (F.col("doc_id") % 240).cast("int"))
    return d.select(F.col("doc_id").alias("item_id"), "text", F.array(*map(F.lit, _AXES)).alias("axes"), aliases.alias("aliases"), day.alias("published"), _now().alias("observed"), stage.alias("gap_stage"))


@query(f"WITH {_SQL_AXES} SELECT * FROM g")
def axis_groups(spark, sf_dir):
    return evidence.axis_groups(_axis_items(table(spark, sf_dir, "documents")))


@query(rf"""WITH {_SQL_AXES}, c AS (SELECT doc_id, text, DATE '2024-02-01' - (doc_id % 90)::INT AS first_seen FROM documents),
w AS (SELECT doc_id, text, CASE WHEN doc_id % 90 <= 28 THEN 'recent' WHEN doc_id % 90 <= 56 THEN 'previous' END AS w FROM c),
h AS (SELECT term, count(*) FILTER (w = 'recent') AS recent, count(*) FILTER (w = 'previous') AS previous FROM g JOIN w ON regexp_matches(text, '(?i)(?:^|[^\p{{L}}\p{{N}}_])' || term || '(?:es|s)?(?:[^\p{{L}}\p{{N}}_]|$)') GROUP BY term)
SELECT term, papers, missed, coalesce(recent, 0) AS recent, coalesce(previous, 0) AS previous, (SELECT count(*) FROM w WHERE w = 'recent') AS recent_total, (SELECT count(*) FROM w WHERE w = 'previous') AS previous_total FROM g LEFT JOIN h USING (term)""")
def emerging_axes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    kw = match.keyword_table(spark, [("axes", t, "core", 1.0, None) for t in _AXES])
    hits = match.match_keywords(d, kw).select(F.col("keyword").alias("term"), "doc_id")
    seen = d.select("doc_id", F.date_sub(_now(), (F.col("doc_id") % 90).cast("int")).alias("first_seen"))
    return evidence.emerging_axes(evidence.axis_groups(_axis_items(d)), hits, seen, _now())


@query("""WITH f AS (SELECT user_id % 50 AS profile_id, min(ts) AS first_sent FROM events WHERE event_type = 'purchase' GROUP BY 1),
b AS (SELECT e.user_id % 50 AS profile_id, e.ts, (e.ts + INTERVAL 9 HOUR)::DATE AS day FROM events e LEFT JOIN f ON f.profile_id = e.user_id % 50 WHERE e.event_type = 'view' AND (first_sent IS NULL OR e.ts < first_sent))
SELECT 'legacy:' || profile_id || ':' || day AS issue_id, profile_id, day, count(*) AS paper_count, min(ts) AS sent_at, 'sent' AS status FROM b GROUP BY profile_id, day""")
def legacy_issues(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("profile_id", F.col("user_id") % 50)
    first = e.where("event_type = 'purchase'").groupBy("profile_id").agg(F.min("ts").alias("first_sent"))
    return evidence.legacy_issues(e.where("event_type = 'view'").select("profile_id", F.col("ts").alias("shown_at")), first)


@query("""WITH n AS (SELECT o_orderkey AS issue_id, o_custkey AS profile_id, count(l_orderkey) AS total, count(*) FILTER (l_returnflag = 'N') AS sent FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 4 = 0 GROUP BY ALL),
l AS (SELECT o_orderkey AS issue_id, o_custkey AS profile_id, 'sent' AS status FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 4 <> 0)
SELECT issue_id, profile_id, status FROM l UNION ALL SELECT issue_id, profile_id, CASE WHEN sent <= 0 THEN 'failed' WHEN sent < total THEN 'partial' ELSE 'sent' END FROM n""")
def record_issues(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("issue_id"), F.col("o_custkey").alias("profile_id")), table(spark, sf_dir, "lineitem")
    n = li.groupBy(F.col("l_orderkey").alias("issue_id")).agg(F.count("*").alias("recipients_total"), F.count_if(F.col("l_returnflag") == "N").alias("recipients_sent"))
    new = o.where("issue_id % 4 = 0").join(n, "issue_id", "left").na.fill(0, ["recipients_total", "recipients_sent"])
    ledger = o.where("issue_id % 2 = 0").withColumn("status", F.lit("sent"))
    return evidence.record_issues(ledger, new).select("issue_id", "profile_id", "status")


@query("""WITH s AS (SELECT 'p' || (event_id % 2) AS policy, event_id % 7 AS weight FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 1),
o AS (SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events WHERE event_type <> 'error' AND ts < TIMESTAMP '2024-01-20' GROUP BY user_id),
r AS (SELECT user_id AS paper_key, row_number() OVER (ORDER BY round(value * ((SELECT weight FROM s) + 1), 4) DESC, user_id) AS rank_pos FROM o)
SELECT paper_key, rank_pos, policy AS snapshot_policy, 'p1' AS scored_with, policy = 'p1' AS policy_match FROM r, s WHERE rank_pos <= 25""")
def replay(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    obs = e.where("event_type <> 'error'").select(F.col("user_id").alias("paper_key"), F.col("ts").alias("observed_at"), F.col("event_id").alias("scan_id"), "value")
    scans = e.where("event_type = 'error'").select(F.col("ts").alias("started_at"), F.col("event_id").alias("scan_id"), F.concat(F.lit("p"), (F.col("event_id") % 2).cast("string")).alias("policy"), (F.col("event_id") % 7).alias("weight"))

    def score(papers, scan):
        worth = F.round(F.col("value") * (scan.select("weight").scalar() + 1), 4)
        return papers.withColumn("worth", worth).withColumn("rank_pos", F.row_number().over(Window.orderBy(F.desc("worth"), "paper_key")))

    return evidence.replay(obs, scans, F.lit("2024-01-20").cast("timestamp"), score, "p1", 25)


@query("""SELECT d.doc_id, coalesce(CASE l.toxic WHEN 1 THEN 'rejected' WHEN 0 THEN 'verified' END, 'missing') AS verdict, array_to_string(list_filter(['the', 'und', 'les'], lambda t: contains(lower(text), t) AND t <> 'und'), ',') AS terms FROM documents d LEFT JOIN labels l USING (doc_id)""")
def attach_verdicts(spark, sf_dir):
    items = table(spark, sf_dir, "documents").withColumn("candidate_terms", F.array(*map(F.lit, ("the", "und", "les"))))
    verdicts = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "rejected").when(F.col("toxic") == 0, "verified").alias("verdict"))
    return evidence.attach_verdicts(items, verdicts, "doc_id", ["und"]).select("doc_id", "verdict", F.array_join("candidate_terms", ",").alias("terms"))


@query("""WITH c AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS reused FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= DATE '1994-01-01' GROUP BY 1) SELECT c_custkey AS o_custkey, reused FROM customer LEFT JOIN c ON c.o_custkey = c_custkey""")
def reuse_lookup(spark, sf_dir):
    checks = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("check_id"), "o_orderdate", (F.col("o_orderstatus") == "F").alias("finished"))
    return evidence.reuse_lookup(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), checks, ["o_custkey"], "o_orderdate", F.lit("1994-01-01").cast("date"))


@query("SELECT event_id AS check_id FROM (SELECT event_id, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS n FROM events) WHERE n <= 3")
def within_daily_cap(spark, sf_dir):
    return evidence.within_daily_cap(table(spark, sf_dir, "events").select(F.col("event_id").alias("check_id"), "ts"), "ts", 3).select("check_id")


@query("SELECT 'T' || row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS thread_no, o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def thread_catalogue(spark, sf_dir):
    return evidence.thread_catalogue(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 20).select("thread_no", "o_orderkey")


@query("""SELECT 'k' || (event_id % 40) AS keyword, event_type AS kind, sum(CASE WHEN user_id % 3 = 0 THEN 1 WHEN user_id % 3 = 1 THEN -1 ELSE 0 END)::BIGINT AS net, array_to_string(list_sort(list(DISTINCT 'a' || (user_id % 4))), ',') AS actors FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1, 2""")
def change_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    action = F.when(F.col("user_id") % 3 == 0, "added").when(F.col("user_id") % 3 == 1, "removed").otherwise("noted")
    c = e.select(F.concat(F.lit("k"), (F.col("event_id") % 40).cast("string")).alias("keyword"), F.col("event_type").alias("kind"), action.alias("action"), F.concat(F.lit("a"), (F.col("user_id") % 4).cast("string")).alias("actor"), F.col("ts").alias("at"))
    return evidence.change_summary(c, F.lit("2024-01-10").cast("timestamp")).withColumn("actors", F.array_join("actors", ","))


@query("SELECT event_id AS report_id, ts AS at, event_type AS keyword, CASE WHEN user_id % 2 = 0 THEN 'add' ELSE 'remove' END AS op FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND event_id % 5 <> 0")
def applied_changes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    one = F.to_json(F.array(F.struct(F.col("event_type").alias("keyword"), F.when(F.col("user_id") % 2 == 0, "add").otherwise("remove").alias("op"))))
    r = e.select(F.col("event_id").alias("report_id"), F.col("ts").alias("at"), F.when(F.col("event_id") % 5 == 0, "{not json").otherwise(one).alias("applied"))
    return evidence.applied_since(r, F.lit("2024-01-15").cast("timestamp")).where("keyword is not null")


@query(f"SELECT page_id FROM pages WHERE page_id % 3 = 0 AND DATE '2024-01-01' + (page_id % 60)::INT >= DATE '2024-02-01' - 29 AND contains(lower({_TITLE}), 'th')")
def catalogue_filter(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", _title().alias("title"), (F.col("page_id") % 3 == 0).alias("summarized"), F.lit("web").alias("source"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 60).cast("int")).alias("fetched"))
    return evidence.catalogue_filter(p, "web", True, 30, _now(), "th").select("page_id")


@query(f"WITH {SQL_HITS}, a AS (SELECT profile_id, keyword FROM kw WHERE position >= 4) SELECT profile_id, keyword, count(DISTINCT doc_id) AS n_docs FROM a LEFT JOIN hits USING (profile_id, keyword) GROUP BY ALL")
def new_keyword_results(spark, sf_dir):
    kw = match.keyword_table(spark, PROFILE_ROWS)
    added = kw.select("profile_id", "keyword", F.date_add(F.lit("2024-01-01").cast("date"), F.col("position")).alias("added_at"))
    return evidence.new_keyword_results(match.match_keywords(table(spark, sf_dir, "documents"), kw), added, F.lit("2024-01-05").cast("date"))


@query("SELECT k, array_to_string(list_sort(list(DISTINCT via)), ',') AS via FROM (SELECT o_custkey AS k, 'seed' AS via FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, 'query' FROM orders WHERE o_totalprice > 150000) GROUP BY k")
def assemble_arm(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey"))
    return evidence.assemble_arm(o.where("o_orderstatus = 'F'"), o.where("o_totalprice > 150000"), "k").withColumn("via", F.array_join("via", ","))


@query("SELECT 't' || (user_id % 500) AS token, min(ts) AS received_at FROM events WHERE ts > TIMESTAMP '2024-01-12' GROUP BY 1")
def reactions_since(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("ts").alias("received_at"), F.concat(F.lit("t"), (F.col("user_id") % 500).cast("string")).alias("token"))
    return evidence.reactions_since(e, F.lit("2024-01-12").cast("timestamp"))


@query(r"""SELECT page_id, CASE WHEN page_id % 4 = 0 AND page_id % 8 <> 0 THEN '10.1/x' || page_id END AS doi, CASE WHEN page_id % 5 = 0 THEN 'set:' || page_id WHEN page_id % 8 = 0 THEN 's2:' || page_id WHEN page_id % 4 = 0 THEN 'doi:10.1/x' || page_id WHEN page_id % 4 = 1 THEN '2401.' || page_id
ELSE 'title:' || trim(regexp_replace(lower(""" + _TITLE + r"""), '[^a-z0-9]+', ' ', 'g')) END AS paper_key FROM pages""")
def paper_keys(spark, sf_dir):
    n, s = F.col("page_id"), F.col("page_id").cast("string")
    doi = F.when((n % 4 == 0) & (n % 8 != 0), F.concat(F.lit("10.1/x"), s))
    ident = F.when(n % 4 == 0, F.concat(F.lit("s2:"), s)).when(n % 4 == 1, F.concat(F.lit("https://x.org/abs/2401."), s, F.lit("v2")))
    key = F.when(n % 5 == 0, F.concat(F.lit("set:"), s))
    return table(spark, sf_dir, "pages").select("page_id", doi.alias("doi"), K.paper_key(key, ident, F.upper(doi), _title()).alias("paper_key"))


@query("""WITH r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y') WHEN 2 THEN 'soon' END AS raw FROM orders),
d AS (SELECT o_orderkey, CASE WHEN raw IS NULL THEN 'missing' WHEN length(raw) = 4 AND raw <> 'soon' THEN 'year' WHEN raw = 'soon' THEN 'invalid' ELSE 'day' END AS precision, CASE WHEN length(raw) = 10 THEN raw::DATE END AS day FROM r)
SELECT o_orderkey, precision, day, round(pow(0.5, greatest(DATE '1998-01-01' - day, 0) / 30.0), 9) AS recency FROM d""")
def date_labels(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    r = F.col("o_orderkey") % 4
    raw = F.when(r == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(r == 1, F.date_format("o_orderdate", "yyyy")).when(r == 2, "soon")
    d = o.select("o_orderkey", K.partial_date(raw).alias("d"))
    return d.select("o_orderkey", "d.precision", "d.day", F.round(K.recency(F.col("d.day"), F.lit("1998-01-01").cast("date")), 9).alias("recency"))


@query("""SELECT p_partkey, CASE WHEN p_size = 1 THEN NULL ELSE contains(lower(p_brand), 'brand#1') END AS venue, round(CASE WHEN p_size > 25 THEN 1.0 ELSE 0.5 END * (0.8 + 0.2 * least(p_partkey % 3, 1)) + p_partkey % 2 * 0.1 + CASE WHEN p_size <> 1 AND contains(lower(p_brand), 'brand#1') THEN 0.3 ELSE 0 END + 0.15 * (p_size % 5) / 10, 4)::DOUBLE AS score,
CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN (p_size > 20)::INT ELSE (p_size > 20)::INT + (p_size > 40)::INT END AS retraction, CASE WHEN p_size >= 45 THEN 'full' WHEN p_size > 5 THEN 'measured_partial' ELSE 'planned' END AS coverage,
CASE WHEN p_partkey % 4 = 0 THEN 'unmeasured' WHEN p_partkey % 4 = 1 THEN 'no_numbers' WHEN p_size % 2 = 0 THEN 'all_matched' ELSE 'some_unmatched' END AS verification, p_partkey % 2 = 0 OR p_size > 30 AS full_text FROM part""")
def score_labels(spark, sf_dir):
    n, size = F.col("p_partkey"), F.col("p_size")
    venue = K.venue_hit(F.when(size == 1, "").otherwise(F.col("p_brand")), F.array(F.lit("Brand#1")))
    score = K.explanation_score(F.when(size > 25, 1.0).otherwise(0.5), n % 3 + 1, (n % 2).cast("int"), venue, size % 5 / 10)
    one, two = F.when(n % 3 != 0, size > 20), F.when(n % 3 == 2, size > 40)
    ratio = F.when(size >= 45, 1.0).when(size > 5, 0.5)
    total = F.when(n % 4 == 1, 0).when(n % 4 > 1, 2)
    return table(spark, sf_dir, "part").select(
        "p_partkey", venue.alias("venue"), score.alias("score"), K.retraction_code(one, two).alias("retraction"), K.coverage_code(ratio, F.lit(1.0)).alias("coverage"),
        K.verification_code(total, F.when(size % 2 == 0, 2).otherwise(1)).alias("verification"), K.full_text_route(F.when(n % 2 == 0, "id"), F.when(size > 30, "https://x.org").otherwise("ftp://x")).alias("full_text"),
    )


@query(rf"""WITH t AS (SELECT page_id, {_TITLE} AS title, html FROM pages), n AS (SELECT *, list_distinct(list_filter(string_split(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) AS a FROM t),
m AS (SELECT *, CASE WHEN page_id % 2 = 0 THEN a ELSE list_append(a, 'zzz') END AS b FROM n)
SELECT page_id, coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0) >= 0.8, false) AS same_title, length(trim(regexp_replace(lower(title), '\s+', ' ', 'g'))) >= 12 AND contains(trim(regexp_replace(lower(html), '\s+', ' ', 'g')), trim(regexp_replace(lower(title), '\s+', ' ', 'g'))) AS quoted,
regexp_matches(html, '(?i)token\s*[:=]\s*\S{{8,}}') AS secret FROM m""")
def text_labels(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("title", _title())
    other = F.when(F.col("page_id") % 2 == 0, F.col("title")).otherwise(F.concat("title", F.lit(" zzz")))
    return p.select("page_id", K.title_match(F.col("title"), other).alias("same_title"), K.quote_found(F.col("html"), F.col("title")).alias("quoted"), K.secret_like(F.col("html")).alias("secret"))


@query("""WITH m AS (SELECT p_partkey, ['Accuracy ↑', 'FID', 'Top-1 acc', 'Speed', 'Error ↓'][p_partkey % 5 + 1] AS label, p_size / 10.0 AS a, p_retailprice / 1000.0 AS b FROM part),
d AS (SELECT *, CASE WHEN label LIKE '%↑%' THEN 'higher' WHEN label LIKE '%↓%' OR label = 'FID' THEN 'lower' WHEN label LIKE '%acc%' THEN 'higher' END AS way, (abs(a) <= 1) = (abs(b) <= 1) AS same FROM m)
SELECT p_partkey, way, regexp_replace(lower(regexp_replace(label, '[↑↓]', '', 'g')), '[^a-z0-9]+', '', 'g') AS metric, round(CASE WHEN same THEN a WHEN way = 'higher' THEN CASE WHEN abs(a) <= 1 THEN a * 100 ELSE a END END::DOUBLE, 6) AS a, round(CASE WHEN same THEN b WHEN way = 'higher' THEN CASE WHEN abs(b) <= 1 THEN b * 100 ELSE b END END::DOUBLE, 6) AS b FROM d""")
def metric_labels(spark, sf_dir):
    label = F.element_at(F.array(*map(F.lit, ("Accuracy ↑", "FID", "Top-1 acc", "Speed", "Error ↓"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    m = table(spark, sf_dir, "part").select("p_partkey", label.alias("label"), (F.col("p_size") / 10.0).cast("double").alias("a"), (F.col("p_retailprice") / 1000.0).cast("double").alias("b"))
    way = K.direction(F.col("label"))
    both = K.comparable(F.col("a"), F.col("b"), F.coalesce(way == "higher", F.lit(False)))
    return m.select("p_partkey", way.alias("way"), K.metric_key(F.col("label")).alias("metric"), F.round(both["a"], 6).alias("a"), F.round(both["b"], 6).alias("b"))


@query("""WITH u AS (SELECT o_custkey, count(*) AS n, min(o_orderkey) AS v FROM orders GROUP BY 1 HAVING count(*) = 1), d AS (SELECT o_orderdate, count(*) AS n, min(o_orderkey) AS v FROM orders GROUP BY 1 HAVING count(*) = 1)
SELECT c_custkey, coalesce(u.v, d.v) AS o_orderkey FROM customer LEFT JOIN u ON u.o_custkey = c_custkey LEFT JOIN d ON d.o_orderdate = DATE '1993-01-01' + (c_custkey % 2000)::INT""")
def priority_lookup(spark, sf_dir):
    items = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("mine"), F.date_add(F.lit("1993-01-01").cast("date"), (F.col("c_custkey") % 2000).cast("int")).alias("day"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("o_custkey"), F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderkey")
    return asof.priority_lookup(items, o, [("mine", "o_custkey"), ("day", "o_orderdate")], "o_orderkey").select(F.col("mine").alias("c_custkey"), "o_orderkey")


@query("""WITH m AS (SELECT date_trunc('day', ts)::DATE AS day, median(value) AS value, count(value) AS n FROM events GROUP BY 1), l AS (SELECT *, lag(value) OVER (ORDER BY day) AS before, lag(n) OVER (ORDER BY day) AS nb FROM m)
SELECT day, value, CASE WHEN n < 3 OR coalesce(nb < 3, true) THEN 'insufficient' WHEN value - before <= -0.1 THEN 'worse' WHEN value - before >= 0.1 THEN 'better' ELSE 'steady' END AS verdict FROM l""")
def health_verdict(spark, sf_dir):
    s = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "value")
    return impact.health_verdict(s, "day", "value").select("day", "value", "verdict")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice < 1000 OR o_totalprice IS NULL THEN 'invalid' WHEN o_orderstatus = 'O' THEN 'needs_search' WHEN o_orderpriority = '5-LOW' THEN 'insufficient' WHEN o_totalprice > 200000 THEN 'held' ELSE 'eligible' END AS decision FROM orders""")
def gate_decisions(spark, sf_dir):
    rules = {"price": (F.col("o_totalprice") >= 1000, "invalid"), "closed": (F.col("o_orderstatus") != "O", "needs_search"), "priority": (F.col("o_orderpriority") != "5-LOW", "insufficient"), "small": (F.col("o_totalprice") <= 200000, "held")}
    return impact.gate(table(spark, sf_dir, "orders"), rules).select("o_orderkey", "decision")


@query("""WITH i AS (SELECT user_id % 20 AS profile_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'partial' ELSE 'sent' END AS status, event_id % 9 AS n_items, ts FROM events)
SELECT profile_id, count(*) FILTER (status = 'sent') AS sent, (sum(n_items) FILTER (status = 'sent'))::BIGINT AS papers, count(*) FILTER (status = 'failed') AS failed, max(ts) AS last_at FROM i GROUP BY profile_id""")
def ledger_counters(spark, sf_dir):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "partial").otherwise("sent")
    i = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("profile_id"), status.alias("status"), (F.col("event_id") % 9).alias("n_items"), F.col("ts").alias("sent_at"))
    return signals.ledger_counters(i).drop("last_status")


@query("""WITH r AS (SELECT user_id % 30 AS k, event_id AS n, round(value / 100, 4) AS w, CASE WHEN event_type = 'click' THEN 'feedback' ELSE 'owner' END AS origin FROM events),
d AS (SELECT *, lag(w) OVER (PARTITION BY k ORDER BY n) AS before FROM r) SELECT k, arg_max(w, n) AS base, max(n) AS changed_at FROM d WHERE origin <> 'feedback' AND (before IS NULL OR abs(w - before) >= 0.005) GROUP BY k""")
def last_direct_change(spark, sf_dir):
    r = table(spark, sf_dir, "events").select((F.col("user_id") % 30).alias("k"), F.col("event_id").alias("n"), F.round(F.col("value") / 100, 4).alias("w"), F.when(F.col("event_type") == "click", "feedback").otherwise("owner").alias("origin"))
    return history.last_direct_change(r, ["k"], "n", "w")


@query("SELECT user_id, arg_min(event_type, (ts, event_id)) AS event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def first_provenance(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return history.first_provenance(e, ["user_id"], "at", ["event_type", "event_id"])


@query("SELECT p_partkey AS paper_key, p_size AS citation_count, p_retailprice FROM part ORDER BY coalesce(CASE WHEN p_partkey % 3 > 0 THEN p_size END, 0) DESC, coalesce(CASE WHEN p_partkey % 2 > 0 THEN floor(p_retailprice)::INT END, 0) DESC, p_partkey LIMIT 15")
def simple_rank(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("paper_key"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_size")).alias("citation_count"), F.when(F.col("p_partkey") % 2 > 0, F.floor("p_retailprice").cast("int")).alias("year"), F.col("p_size").alias("size"), "p_retailprice")
    return rank.simple_rank(p, 15).select("paper_key", F.col("size").alias("citation_count"), "p_retailprice")


@query("""WITH k AS (SELECT s_suppkey AS k, 1.0::DOUBLE AS w FROM supplier WHERE s_suppkey % 2 = 0), c AS (SELECT s_suppkey AS k, ['add', 'remove', 'set'][s_suppkey % 3 + 1] AS change, (s_acctbal / 1000)::DOUBLE AS w FROM supplier WHERE s_suppkey % 5 > 0)
SELECT coalesce(k.k, c.k) AS k, CASE WHEN c.k IS NOT NULL THEN least(greatest(c.w, 0.35), 2.0) ELSE k.w END AS weight FROM k FULL JOIN c USING (k) WHERE change IS NULL OR change <> 'remove'""")
def apply_changes(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("k", F.col("s_suppkey"))
    op = F.element_at(F.array(*map(F.lit, ("add", "remove", "set"))), (F.col("k") % 3 + 1).cast("int"))
    c = s.where("k % 5 > 0").select("k", op.alias("change"), (F.col("s_acctbal") / 1000).cast("double").alias("weight"))
    return history.apply_changes(s.where("k % 2 = 0").select("k", F.lit(1.0).alias("weight")), c, ["k"])


@query("""WITH h AS (SELECT doc_id, list_filter(['the', 'les', 'und', 'que'], lambda t: contains(text, ' ' || t || ' ')) AS hits FROM documents), o AS (SELECT doc_id, hits[1] AS keyword FROM h WHERE len(hits) = 1)
SELECT keyword, count(*) AS n, array_to_string(list_sort(list(doc_id))[1:3], ',') AS samples FROM o GROUP BY keyword HAVING count(*) >= 3""")
def hit_alone(spark, sf_dir):
    hits = F.filter(F.array(*map(F.lit, ("the", "les", "und", "que"))), lambda t: F.col("text").contains(F.concat(F.lit(" "), t, F.lit(" "))))
    out = signals.hit_alone(table(spark, sf_dir, "documents").select("doc_id", hits.alias("hits")), "doc_id", "hits")
    return out.withColumn("samples", F.array_join(F.col("samples").cast("array<string>"), ","))


@query("""WITH e AS (SELECT 'x' || (event_id % 25) AS axis, strftime(ts, '%Y-%m-%d') AS week, user_id FROM events), l AS (SELECT max(week) AS w FROM e)
SELECT axis, min(week) AS first_week, max(week) AS last_week, count(DISTINCT user_id) AS total, count(DISTINCT user_id) FILTER (week = '2024-01-20') AS this_week, CASE WHEN min(week) = '2024-01-20' THEN 'new' WHEN count(*) FILTER (week = '2024-01-20') > 0 THEN 'active' ELSE 'quiet' END AS status FROM e GROUP BY axis""")
def watchlist(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("x"), (F.col("event_id") % 25).cast("string")).alias("axis"), F.date_format("ts", "yyyy-MM-dd").alias("week"), F.col("user_id").alias("paper_key"))
    return signals.watchlist(e, "axis", "week", "2024-01-20")


@query("SELECT o_orderpriority AS name, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1 HAVING count(DISTINCT o_custkey) >= 2 ORDER BY n DESC, name LIMIT 10")
def prolific(spark, sf_dir):
    return signals.prolific(table(spark, sf_dir, "orders").select("o_custkey", F.array("o_orderpriority").alias("names")), "names", "o_custkey")


@query("""SELECT 'k' || (event_id % 12) AS keyword, count(*) FILTER (event_type = 'click') AS done, count(*) FILTER (event_type = 'view') AS partial, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type NOT IN ('click', 'view', 'error')) AS not_attempted, sum(user_id % 9)::BIGINT AS returned FROM events WHERE event_id % 6 <> 0 GROUP BY 1""")
def seed_attempts(spark, sf_dir):
    status = F.when(F.col("event_type") == "click", "done").when(F.col("event_type") == "view", "partial").when(F.col("event_type") == "error", "failed").otherwise("not_attempted")
    one = F.to_json(F.array(F.struct(F.concat(F.lit("k"), (F.col("event_id") % 12).cast("string")).alias("keyword"), status.alias("status"), (F.col("user_id") % 9).cast("int").alias("returned"))))
    return signals.seed_attempts(table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 6 == 0, "oops").otherwise(one).alias("seed_attempts"))).where("keyword is not null")


@query("""SELECT doc_id, sid, length(coalesce(lag(s) OVER w || ' ', '') || s || coalesce(' ' || lead(s) OVER w, '')) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS sid FROM documents) WINDOW w AS (PARTITION BY doc_id ORDER BY sid)""")
def with_neighbours(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "sentence")).select("doc_id", (F.col("p") + 1).alias("sid"), "sentence")
    return text.with_neighbours(s).select("doc_id", "sid", F.length("context").alias("n"))
