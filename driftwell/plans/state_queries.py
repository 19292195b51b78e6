"""Registered queries on loads, ledgers, histories and evidence, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwell.functions import keys as K
from driftwell.operators import asof, cells, evidence, feedback, history, impact, links, match, merge, rank, search, signals, terms, text
from driftwell.plans.queries import dealt, parts, query, table
from driftwell.sources import readers

_days = lambda base, n: F.lit(base).cast("timestamp") + F.make_dt_interval(days=n.cast("int"))


@query("SELECT event_id, CASE WHEN event_id % 50 > 0 THEN ts END AS ts FROM events WHERE event_id % 50 = 0 OR ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'")
def window_scan(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 50 > 0, F.col("ts")).alias("ts"))
    return signals.window_scan(e, "ts", "2024-01-05", "2024-01-12")


@query("SELECT user_id AS scan_id, event_type AS paper_key, count(*) > 0 AS kept FROM events GROUP BY ALL")
def append_once(spark, sf_dir):
    """Two overlapping halves of the events as scans, the second one written twice."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("scan_id"), F.col("event_type").alias("paper_key"), "event_id")
    old = e.where("event_id % 3 < 2").select("scan_id", "paper_key").distinct().withColumn("kept", F.lit(True))
    new = e.where("event_id % 3 > 0").select("scan_id", "paper_key").withColumn("kept", F.lit(True))
    return merge.append_once(merge.append_once(old, new), new)


@query("SELECT o_orderkey, o_custkey, o_orderstatus AS status FROM orders WHERE o_custkey % 5 > 0 UNION ALL SELECT o_orderkey, o_custkey, 'new' FROM orders WHERE o_custkey % 5 = 0 AND o_orderstatus = 'O'")
def replaced_entities(spark, sf_dir):
    """A fifth of the customers are read anew; those without an open order are left with nothing."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"))
    new = o.where("status = 'O'").withColumn("status", F.lit("new"))
    return merge.replace_entity(o, new, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")).where("o_custkey % 5 = 0"), "o_custkey")


@query("SELECT o_orderkey AS scan_id, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus <> 'F' THEN NULL WHEN o_orderkey % 3 = 0 THEN 'closed' ELSE o_orderpriority END AS error, o_totalprice AS total FROM orders")
def closed_runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    runs = o.select(F.col("o_orderkey").alias("scan_id"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("error"), F.when(F.col("o_orderkey") % 2 > 0, F.col("o_totalprice")).alias("total"))
    closing = o.select(F.col("o_orderkey").alias("scan_id"), F.when(F.col("o_orderstatus") == "F", "closed").alias("error"), F.col("o_totalprice").alias("total"))
    return merge.close_run(runs, closing)


@query("SELECT c_custkey AS paper_key, DATE '1995-06-01' AS collected_on FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate::DATE = DATE '1995-06-01')")
def missing_snapshots(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("paper_key"), F.lit("1995-06-01").cast("date").alias("collected_on"))
    have = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("paper_key"), F.col("o_orderdate").cast("date").alias("collected_on"))
    return merge.missing_today(wanted, have)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 40")
def backlog(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"))
    return merge.backlog(o, "status", ["o_orderdate", "o_orderkey"], 40).select("o_orderkey", "o_orderdate")


@query("""WITH r AS (SELECT 'p' || n_regionkey AS profile_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::INT AS revision, n_name AS snapshot, 'user' AS origin FROM nation)
SELECT * FROM r UNION ALL SELECT 'p2', (SELECT max(revision) + 1 FROM r WHERE profile_id = 'p2'), (SELECT snapshot FROM r WHERE profile_id = 'p2' AND revision = 2), 'rollback'""")
def rolled_back(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    before = n.select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("k"))
    place = n.join(before, (F.col("n_regionkey") == F.col("r")) & (F.col("k") <= F.col("n_nationkey"))).groupBy("n_regionkey", "n_nationkey", "n_name").agg(F.count("*").cast("int").alias("revision"))
    r = place.select(F.concat(F.lit("p"), F.col("n_regionkey").cast("string")).alias("profile_id"), "revision", F.col("n_name").alias("snapshot"), F.lit("user").alias("origin"))
    return history.rollback(r, "p2", 2)


@query("""SELECT vec_id, concat_ws(',', CASE WHEN vec_id % 7 = 0 THEN 'has_model' END, CASE WHEN len(embedding) <> 64 OR vec_id % 11 = 0 THEN 'dimension' END, CASE WHEN vec_id % 13 = 0 THEN 'known_paper' END) AS errors FROM embeddings""")
def validated_load(spark, sf_dir):
    """Vectors with and without a model, shortened ones and unknown papers: what is rejected, and why."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 > 0, "m").alias("model"), F.when(F.col("vec_id") % 11 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")).alias("v"))
    good, bad = merge.validated_load(e, {"has_model": F.col("model").isNotNull(), "dimension": F.size("v") == 64, "known_paper": F.col("vec_id") % 13 > 0})
    return good.select("vec_id", F.lit("").alias("errors")).unionByName(bad.select("vec_id", F.array_join("errors", ",").alias("errors")))


@query("""SELECT o_orderkey, list_sort(list_filter(['o' || o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'doi:10.1/x' || o_orderkey END, CASE WHEN o_orderkey % 2 = 0 THEN 'title:order ' || o_orderkey || ' ' || lower(replace(o_orderpriority, '-', ' ')) END], lambda x: x IS NOT NULL)) AS keys FROM orders""")
def entity_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey").cast("string")
    keys = K.entity_keys(F.concat(F.lit("https://host/abs/o"), k, F.lit("v3")), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("10.1/X"), k)), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Order #"), k, F.lit(": "), F.col("o_orderpriority"))))
    return o.select("o_orderkey", F.array_sort(keys).alias("keys"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 4 > 0 AS linked, o_orderkey % 6 > 1 AS same FROM orders)
SELECT k, CASE WHEN linked AND same THEN 'first' WHEN k % 5 > 0 THEN 'second' END AS verified_by FROM o""")
def identified(spark, sf_dir):
    """Orders as items: a first record for three of four, with another title for some; a second one for four of five."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey").cast("string")
    title = F.concat(F.lit("The grand report on all of order number "), k)
    items = o.select(F.col("o_orderkey").alias("k"), k.alias("ident"), title.alias("title"))
    first = o.where("o_orderkey % 4 > 0").select(k.alias("ident"), F.when(F.col("o_orderkey") % 6 > 1, F.upper(title)).otherwise("Something else entirely").alias("title"))
    second = o.where("o_orderkey % 5 > 0").select(k.alias("ident"), F.concat(title, F.lit("!")).alias("title"))
    return merge.identify(items, first, second).select("k", "verified_by")


@query("""SELECT c_custkey AS paper_key, a.t AS first_seen, b.t AS summarised_at FROM customer LEFT JOIN (SELECT o_custkey AS k, min(o_orderdate) AS t FROM orders GROUP BY 1) a ON a.k = c_custkey LEFT JOIN (SELECT o_custkey AS k, min(o_orderdate) AS t FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b ON b.k = c_custkey""")
def attached_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    seen = o.select(F.col("o_custkey").alias("paper_key"), F.col("o_orderdate").alias("seen_at"))
    return asof.attach_dates(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("paper_key")), seen, o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("paper_key"), F.col("o_orderdate").alias("at")))


@query("""SELECT o_orderkey AS issue_id, o_custkey AS paper_key, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'issue ' || o_orderkey END, CASE WHEN o_custkey % 4 = 0 THEN c_name END, o_custkey::VARCHAR) AS title FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def reaction_titles(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("issue_id"), F.col("o_custkey").alias("paper_key"))
    items = o.where("issue_id % 3 = 0").withColumn("title", F.concat(F.lit("issue "), F.col("issue_id").cast("string")))
    titles = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("paper_key"), F.col("c_name").alias("title"))
    return feedback.reaction_log(o, items, titles)


@query("""SELECT o_orderkey AS k, concat_ws(',', CASE WHEN o_orderkey % 3 = 0 THEN 'profile_id' END, CASE WHEN o_orderkey % 7 = 0 THEN 'before_hash' END, CASE WHEN o_orderkey % 11 = 0 THEN 'policy' END) AS mismatch, o_orderkey % 3 > 0 AND o_orderkey % 7 > 0 AND o_orderkey % 11 > 0 AS bound FROM orders""")
def bound_experiments(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    a = o.select(k.alias("run_id"), F.col("o_custkey").alias("profile_id"), F.sha2(k.cast("string"), 256).alias("before_hash"), F.lit("v3").alias("policy"))
    r = o.select(k.alias("run_id"), F.when(k % 3 > 0, F.col("o_custkey")).alias("profile_id"), F.when(k % 7 > 0, F.sha2(k.cast("string"), 256)).otherwise("?").alias("before_hash"), F.when(k % 11 > 0, "v3").otherwise("v2").alias("policy"))
    b = impact.bind_experiment(a, r, ["profile_id", "before_hash", "policy"])
    return b.select(F.col("run_id").alias("k"), F.array_join("mismatch", ",").alias("mismatch"), "bound")


@query(r"""WITH h AS (SELECT source, list_filter(['the', 'und'], lambda w: regexp_matches(text, '(?i)(?:^|[^a-z])' || w || '(?:[^a-z]|$)')) AS core, regexp_matches(text, '(?i)(?:^|[^a-z])de(?:[^a-z]|$)') AS ex FROM documents)
SELECT source, count(*) AS n, round(avg((len(core) > 0)::INT), 9) AS hit_ratio, round(avg((len(core) > 0 AND NOT ex)::INT), 9) AS eligible_ratio, round(avg(ex::INT), 9) AS excluded_ratio FROM h GROUP BY source""")
def hit_ratios(spark, sf_dir):
    has = lambda w: F.col("text").rlike(rf"(?i)(?:^|[^a-z]){w}(?:[^a-z]|$)")
    none = F.array().cast("array<string>")
    d = table(spark, sf_dir, "documents").select("source", F.array_compact(F.array(*[F.when(has(w), F.lit(w)) for w in ("the", "und")])).alias("core_hits"), F.when(has("de"), F.array(F.lit("de"))).otherwise(none).alias("exclude_hits"))
    r = signals.hit_ratios(d.withColumn("eligible", (F.size("core_hits") > 0) & (F.size("exclude_hits") == 0)), "source")
    return r.select("source", "n", *[F.round(c, 9).alias(c) for c in ("hit_ratio", "eligible_ratio", "excluded_ratio")])


@query("SELECT CASE doc_id % 3 WHEN 0 THEN 'doi' WHEN 1 THEN 'title' ELSE 'id' END AS kind, count(*) AS n FROM documents GROUP BY 1")
def source_mix(spark, sf_dir):
    k = F.col("doc_id") % 3
    return signals.source_mix(table(spark, sf_dir, "documents").select(F.concat(F.when(k == 0, "doi:").when(k == 1, "title:").otherwise("x"), F.col("doc_id").cast("string")).alias("key")), "key")


@query("""WITH s AS (SELECT conv_id, round(sum(length(text)) FILTER (role = 'assistant') / sum(length(text))::DOUBLE, 9) AS coverage_ratio FROM conversations GROUP BY conv_id) SELECT * FROM s WHERE coverage_ratio IS NOT NULL AND coverage_ratio < 0.6""")
def partial_coverage(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    n = F.length("text")
    r = c.groupBy("conv_id").agg(F.round(F.sum(F.when(F.col("role") == "assistant", n)) / F.sum(n), 9).alias("coverage_ratio"))
    return signals.partial_coverage(r, least=0.6)


@query("""WITH o AS (SELECT user_id AS k, event_type AS seed, CASE WHEN value > 60 THEN 'core' ELSE 'no_core_hit' END AS reason, ts, event_id FROM events)
SELECT k, list_sort(list_distinct(list(seed))) AS seeds, arg_max(reason, (ts, event_id)) AS filter_reason FROM o GROUP BY k HAVING arg_max(reason, (ts, event_id)) = 'no_core_hit'""")
def exploration_pool(spark, sf_dir):
    o = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.array("event_type").alias("seeds"), F.array("event_type").alias("sources"), F.when(F.col("value") > 60, "core").otherwise("no_core_hit").alias("filter_reason"), "ts", "event_id")
    return terms.exploration_pool(o, "k", ["ts", "event_id"]).select("k", "seeds", "filter_reason")


@query("""WITH t AS (SELECT DISTINCT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{9,}'))) AS term FROM documents), j AS (SELECT term, lang FROM t JOIN documents USING (doc_id))
SELECT term, count(*) AS n, min(lang) AS seed FROM j GROUP BY term HAVING count(DISTINCT lang) = 1 AND count(*) >= 3""")
def single_seed_terms(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    t = d.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{9,}"), F.lit(0)))).alias("term"))
    return terms.single_seed_noise(t, d, "doc_id", "lang")


@query("""WITH t AS (SELECT DISTINCT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{9,}'))) AS term FROM documents) SELECT term, doc_id, rn FROM (SELECT term, doc_id, row_number() OVER (PARTITION BY term ORDER BY n_chars DESC, doc_id) AS rn FROM t JOIN documents USING (doc_id)) WHERE rn <= 3""")
def term_evidence(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    t = d.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{9,}"), F.lit(0)))).alias("term"))
    return terms.evidence_docs(t, d.select("doc_id", "n_chars"), "doc_id", [F.desc("n_chars"), "doc_id"])


@query("""WITH e AS (SELECT user_id, event_type AS keyword, ts, value, event_id FROM events), h AS (SELECT keyword, list({'revision': event_id, 'weight': value} ORDER BY event_id) AS weights FROM e WHERE event_id % 97 = 0 GROUP BY 1),
r AS (SELECT keyword, count(DISTINCT user_id) AS recent_hits FROM e WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1), x AS (SELECT keyword, count(*) FILTER (value > 50) AS n_pos, count(*) FILTER (value <= 50) AS n_neg FROM e WHERE event_id % 5 = 0 GROUP BY 1)
SELECT keyword, len(weights) AS n_weights, weights[1].weight AS first_weight, recent_hits, n_pos, n_neg FROM h LEFT JOIN r USING (keyword) LEFT JOIN x USING (keyword)""")
def keyword_table(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("paper_key"), F.col("event_type").alias("keyword"), F.col("ts").alias("at"), "value", "event_id")
    reactions = e.where("event_id % 5 = 0").select(F.array("keyword").alias("hits"), F.when(F.col("value") > 50, 1).otherwise(-1).alias("sign"))
    h = e.where("event_id % 97 = 0").select("keyword", F.col("event_id").alias("revision"), F.col("value").alias("weight"))
    t = feedback.keyword_table(e, reactions, h, F.lit("2024-01-20").cast("timestamp"))
    return t.select("keyword", F.size("weights").cast("long").alias("n_weights"), F.col("weights")[0]["weight"].alias("first_weight"), "recent_hits", "n_pos", "n_neg")


@query("SELECT count(*) FILTER (c_acctbal > -500) AS evaluable, count(*) FILTER (c_acctbal > 0) AS retrieved, count(*) FILTER (c_acctbal > 3000) AS core_hit, count(*) FILTER (c_acctbal > 8000) AS delivered FROM customer")
def capture_funnel(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return signals.capture_funnel(c.select(*[(F.col("c_acctbal") > n).alias(k) for k, n in (("evaluable", -500), ("retrieved", 0), ("core_hit", 3000), ("delivered", 8000))]))


@query("""SELECT o_orderkey AS k, concat_ws(',', 'P1:T', CASE WHEN o_orderkey % 3 = 0 THEN 'P2:S0007' END, CASE WHEN o_orderkey % 5 = 0 THEN 'P9:A' END) AS cited, CASE WHEN o_orderkey % 5 = 0 THEN 'P9:A' ELSE '' END AS unknown FROM orders""")
def citation_audit(spark, sf_dir):
    k = F.col("o_orderkey")
    said = F.concat(F.lit("As shown [P1:T] and again [P1:T]"), F.when(k % 3 == 0, ", see [P2:S0007]").otherwise(""), F.when(k % 5 == 0, " but [P9:A]").otherwise(""), F.lit(" [not an id]."))
    a = text.citation_audit(said, F.array(F.lit("P1:T"), F.lit("P2:S0007")))
    return table(spark, sf_dir, "orders").select(k.alias("k"), F.array_join(a["cited"], ",").alias("cited"), F.array_join(a["unknown"], ",").alias("unknown"))


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS paper_id, l_partkey AS ref_id, year(o_orderdate) AS y FROM lineitem JOIN orders ON o_orderkey = l_orderkey), s AS (SELECT ref_id FROM c GROUP BY 1 ORDER BY count(DISTINCT paper_id) DESC, ref_id LIMIT 3)
SELECT paper_id, count(DISTINCT ref_id) AS n FROM c WHERE ref_id IN (SELECT ref_id FROM s) AND y >= 1996 GROUP BY 1 ORDER BY n DESC, paper_id LIMIT 10""")
def frontier_papers(spark, sf_dir):
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    n = parts(l)
    l, o = dealt(l.select("l_orderkey", "l_partkey"), "l_orderkey", n), dealt(o.select("o_orderkey", "o_orderdate"), "o_orderkey", n)
    cites = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("paper_id"), F.col("l_partkey").alias("ref_id"), F.year("o_orderdate").alias("year"))
    return impact.frontier(cites, impact.shared_references(cites, top=3), 1996)


@query("""SELECT o_custkey AS paper_key, arg_max({'repo_url': 'r' || o_orderkey, 'tier': ['official', 'author', 'third_party', 'analogous'][o_orderkey % 4 + 1], 'ok': o_orderstatus = 'F'}, ((o_orderstatus = 'F')::INT, -(o_orderkey % 4), o_orderkey % 7, 'r' || o_orderkey)) AS b, count(*) AS runs FROM orders GROUP BY 1""".replace("SELECT o_custkey AS paper_key, arg_max", "SELECT paper_key, b.repo_url AS repo_url, b.tier AS tier, b.ok AS success FROM (SELECT o_custkey AS paper_key, arg_max") + ")")
def code_ladder(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    tier = F.get(F.array(*map(F.lit, ("official", "author", "third_party", "analogous"))), (k % 4).cast("int"))
    runs = o.select(F.col("o_custkey").alias("paper_key"), F.concat(F.lit("r"), k.cast("string")).alias("repo_url"), tier.alias("tier"), F.lit("run").alias("stage"), (k % 7).alias("stage_no"), (F.col("o_orderstatus") == "F").alias("success"))
    return cells.code_ladder(runs).select("paper_key", "repo_url", "tier", "success")


@query("""WITH r AS (SELECT l_orderkey AS k, 'M' || l_suppkey AS model, l_linenumber AS row_no, CASE WHEN s_acctbal > 2000 THEN round(s_acctbal)::BIGINT END AS c FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
SELECT k, arg_max(model, (c, -row_no)) FILTER (c IS NOT NULL) AS model, count(c) AS checked FROM r GROUP BY k""")
def most_cited(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.concat(F.lit("M"), F.col("l_suppkey").cast("string")).alias("model"), F.col("l_linenumber").alias("row_no"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("M"), F.col("s_suppkey").cast("string")).alias("model"), F.when(F.col("s_acctbal") > 2000, F.round("s_acctbal").cast("long")).alias("citations"))
    return cells.most_cited(r, s, ["k"], ("row_no", "file", "at"))  # a line number may stand twice in an order: then the row that lies first


@query("""WITH n AS (SELECT c_nationkey AS reader, c_custkey AS paper_key, c_custkey % 3 AS retraction, c_mktsegment AS repro FROM customer), s AS (SELECT c_nationkey AS reader, c_custkey AS paper_key, c_custkey % 2 AS retraction, CASE WHEN c_custkey % 7 = 0 THEN 'old' ELSE c_mktsegment END AS repro FROM customer WHERE c_custkey % 4 > 0),
j AS (SELECT n.*, s.paper_key IS NULL AS new, concat_ws(',', CASE WHEN s.paper_key IS NULL OR n.retraction <> s.retraction THEN 'retraction' END, CASE WHEN s.paper_key IS NULL OR n.repro <> s.repro THEN 'repro' END) AS changed FROM n LEFT JOIN s USING (reader, paper_key))
SELECT reader, paper_key, changed, place FROM (SELECT *, row_number() OVER (PARTITION BY reader ORDER BY retraction <> 1, new, paper_key) AS place FROM j WHERE changed <> '') WHERE place <= 10""")
def changes_since_sent(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("reader"), F.col("c_custkey").alias("paper_key"), "c_mktsegment")
    now = c.select("reader", "paper_key", (F.col("paper_key") % 3).alias("retraction"), F.col("c_mktsegment").alias("repro"))
    sent = c.where("paper_key % 4 > 0").select("reader", "paper_key", (F.col("paper_key") % 2).alias("retraction"), F.when(F.col("paper_key") % 7 == 0, "old").otherwise(F.col("c_mktsegment")).alias("repro"))
    r = asof.changed_since_sent(now, sent, ["reader", "paper_key"], ["retraction", "repro"], 10, "paper_key", F.col("retraction") == 1)
    return r.select("reader", "paper_key", F.array_join("changed", ",").alias("changed"), "place")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 3 = 0), c AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 3 = 1) SELECT coalesce(a.k, c.k) AS k, CASE WHEN a.k IS NULL THEN 'added' ELSE 'removed' END AS change FROM a FULL JOIN c ON a.k = c.k WHERE a.k IS NULL OR c.k IS NULL""")
def reconciled(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    of = lambda n: o.where(F.col("o_orderkey") % 3 == n).select(F.col("o_custkey").alias("k")).distinct()
    return history.reconcile(of(0), of(1), ["k"])


@query("""SELECT paper_key FROM (SELECT 'o' || o_orderkey AS paper_key FROM orders WHERE o_orderkey % 2 = 0 UNION SELECT 'o' || o_orderkey FROM orders WHERE o_orderkey % 3 = 0 UNION SELECT 'doi:10.1/x' || o_orderkey FROM orders WHERE o_orderkey % 15 = 0)""")
def backfilled(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    ident = F.concat(F.lit("o"), k.cast("string"))
    s = o.where("o_orderkey % 3 = 0").select(ident.alias("ident"), F.when(k % 5 == 0, F.concat(F.lit("10.1/X"), k.cast("string"))).alias("doi"))
    return merge.backfill_delivered(o.where("o_orderkey % 2 = 0").select(ident.alias("paper_key")), s)


@query("""SELECT c_nationkey AS k, sha256(string_agg(j, chr(10) ORDER BY j)) AS content_sha FROM (SELECT c_nationkey, '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}' AS j FROM customer) GROUP BY 1""")
def snapshot_shas(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "k")
    return history.small_snapshot_sha(c, ["k"], ["c_custkey", "c_mktsegment"])


@query("""WITH a AS (SELECT user_id, max(ts) FILTER (ts < TIMESTAMP '2024-01-03') AS before, min(ts) AS first FROM events GROUP BY 1) SELECT user_id, coalesce((SELECT e.value FROM events e WHERE e.user_id = a.user_id AND e.ts = a.before), (SELECT e.value FROM events e WHERE e.user_id = a.user_id AND e.ts = a.first)) AS value FROM a""")
def snapshot_or_earliest(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    g = e.groupBy("user_id").agg(F.max_by("value", F.when(F.col("ts") < F.lit("2024-01-03").cast("timestamp"), F.col("ts"))).alias("a"), F.min_by("value", "ts").alias("b"))
    return g.select("user_id", asof.value_with_fallback(F.col("a"), F.col("b")).alias("value"))


@query("SELECT s_suppkey, CASE WHEN r <= 5 THEN 'content' WHEN r <= 12 THEN 'reserve' ELSE 'title_only' END AS part FROM (SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier)")
def rank_split(spark, sf_dir):
    from pyspark.sql import Window

    s = table(spark, sf_dir, "supplier").withColumn("r", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")))
    return s.select("s_suppkey", rank.split_by_rank(F.col("r"), 5, 7).alias("part"))


@query("""WITH d AS (SELECT l_orderkey AS k, l_linenumber AS n, round(l_quantity::DOUBLE * 1.125::DOUBLE - l_linenumber * 5.5::DOUBLE, (l_linenumber % 3)::INT)::DOUBLE + 0.0::DOUBLE AS diff FROM lineitem)
SELECT k, n, diff, CASE WHEN diff = 0 THEN 'equal' WHEN n % 4 = 0 THEN NULL WHEN (diff > 0) = (n % 2 = 1) THEN 'better' ELSE 'worse' END AS verdict FROM d""")
def value_differences(spark, sf_dir):
    """Quantities against a line's own mark, at none, one or two digits, for metrics of either and of unknown direction."""
    n = F.col("l_linenumber")
    d = cells.difference(F.col("l_quantity").cast("double") * 1.125, n * 5.5, n % 3, F.when(n % 4 > 0, F.when(n % 2 == 1, "higher").otherwise("lower")))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), n.alias("n"), d["diff"].alias("diff"), d["verdict"].alias("verdict"))


@query(r"""WITH a AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(text, '[a-z]{4,}'))) AS w FROM conversations) SELECT conv_id, turn, string_agg(w, ' ' ORDER BY w) AS words FROM a GROUP BY ALL""")
def inverted_index(spark, sf_dir):
    """Each turn's distinct words as an index word to position in alphabetical order, and the text that it spells."""
    w = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]{4,}"), F.lit(0))))
    index = F.map_from_arrays(w, F.transform(w, lambda x, i: F.array(i)))
    return table(spark, sf_dir, "conversations").where(F.size(w) > 0).select("conv_id", "turn", text.inverted_index_text(index).alias("words"))
