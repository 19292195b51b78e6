"""Registered queries on landed feeds, texts with structure and streams, each beside its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftwell.operators import cells, evidence, impact, links, match, search, terms, text
from driftwell.operators.graph import checkpoint_dir, connected_components
from driftwell.plans.queries import EVENTS, dealt, parts, query, table
from driftwell.sources import readers
from driftwell.streaming import streams


def _landed(df, kind: str) -> str:
    """``df``'s one text column as files of a row each in the shared folder."""
    at = f"{checkpoint_dir(df.sparkSession)}/{kind}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", 1).text(at)
    return at


_say = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])


@query("""SELECT 'c' || c_custkey AS ident, 'Report on ' || c_name AS title, 'All of ' || c_mktsegment || ' it is' AS abstract, '1995-01-' || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') AS published, 'A ' || c_nationkey || ',B' AS authors, 'cs.' || c_nationkey || CASE WHEN c_custkey % 2 = 0 THEN ',stat' ELSE '' END AS categories FROM customer""")
def atom_feed(spark, sf_dir):
    """Customers as the entries of Atom feeds, a feed a file, read back as records."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    entry = _say(
        "<entry><id>http://host/abs/c", k.cast("string"), "v2</id><title>Report  on\n ", F.col("c_name"), "</title><summary> All of ", F.col("c_mktsegment"), "  it is </summary><published>1995-01-", F.lpad((k % 28 + 1).cast("string"), 2, "0"), "</published><author><name>A ",
        F.col("c_nationkey").cast("string"), "</name></author><author><name>B</name></author><category term=\"cs.", F.col("c_nationkey").cast("string"), "\"/>", F.when(k % 2 == 0, "<category term=\"stat\"/>").otherwise(""), "</entry>",
    )
    feeds = c.groupBy(F.floor(k / 50).alias("f")).agg(_say("<feed>", F.array_join(F.collect_list(entry), ""), "</feed>").alias("value")).select("value")
    a = readers.atom_feed(spark, _landed(feeds, "atom"))
    return a.select("ident", "title", "abstract", "published", F.array_join("authors", ",").alias("authors"), F.array_join("categories", ",").alias("categories"))


@query("""SELECT CASE WHEN p_partkey % 2 = 0 THEN 'i' || p_partkey END AS ident, CASE WHEN p_partkey % 3 = 0 THEN '10.1/' || p_partkey END AS doi, p_name AS title, CASE p_partkey % 4 WHEN 0 THEN '1999-05-01' WHEN 1 THEN NULL ELSE '1998' END AS published, p_brand AS venue, p_size::BIGINT AS citation_count FROM part WHERE p_partkey % 7 > 0""")
def json_results(spark, sf_dir):
    """Parts as nested search results, a response a line; some without title, date or ids."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    ids = F.struct(F.when(k % 2 == 0, _say("i", k.cast("string"))).alias("ArXiv"), F.when(k % 3 == 0, _say("10.1/", k.cast("string"))).alias("DOI"))
    row = F.struct(k.cast("string").alias("paperId"), F.when(k % 7 > 0, F.col("p_name")).otherwise(" ").alias("title"), F.when(k % 4 == 0, "1999-05-01").alias("publicationDate"), F.when(k % 4 > 1, 1998).alias("year"), F.col("p_brand").alias("venue"), F.col("p_size").cast("long").alias("citationCount"), ids.alias("externalIds"))
    answers = p.groupBy(F.floor(k / 40).alias("f")).agg(F.to_json(F.struct(F.collect_list(row).alias("data"))).alias("value")).select("value").repartition(4, "value")
    at = f"{checkpoint_dir(spark)}/json-{uuid.uuid4().hex}"
    answers.select(F.from_json("value", "data array<struct<paperId:string,title:string,publicationDate:string,year:int,venue:string,citationCount:bigint,externalIds:struct<ArXiv:string,DOI:string>>>").alias("r")).select("r.*").write.option("maxRecordsPerFile", 1).json(at)
    return readers.json_results(spark, at).select("ident", "doi", "title", "published", "venue", "citation_count")


@query("""WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber, l_quantity::INT AS q, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, '| line ' || l_linenumber || ' | ' || l_quantity::INT || CASE WHEN l_linenumber % 2 = 0 THEN ' | ' || l_returnflag ELSE '' END || ' |') AS r FROM lineitem)
SELECT doc_id, 'Order ' || doc_id AS caption, r::INT AS row, unnest([0, 1, 2])::INT AS col, unnest(['line ' || l_linenumber, q::VARCHAR, CASE WHEN l_linenumber % 2 = 0 THEN f ELSE '' END]) AS text, unnest([l_linenumber, q, NULL])::DOUBLE AS value FROM l""")
def markdown_cells(spark, sf_dir):
    """Orders as markdown with a table of their lines; odd lines lack their last cell."""
    n = F.col("l_linenumber")
    row = _say("| line ", n.cast("string"), " | ", F.col("l_quantity").cast("int").cast("string"), F.when(n % 2 == 0, _say(" | ", F.col("l_returnflag"))).otherwise(""), " |")
    l = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"), "l_orderkey")
    d = l.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(n.alias("n"), row.alias("row")))), lambda x: x["row"]), "\n").alias("rows"))
    d = d.select("doc_id", _say("intro\n# Order ", F.col("doc_id").cast("string"), "\n\n| a | b | c |\n|---|:-:|---|\n", F.col("rows"), "\nend | of it\n").alias("text"))
    return readers.markdown_cells(d).where("row > 0").select("doc_id", "caption", "row", "col", "text", "value")


@query("""SELECT c_custkey AS doc_id, unnest(['summary', 'results', 'risks']) AS section, unnest(['about ' || c_name || '|more', 'r ' || c_custkey || '|## detail|x', CASE WHEN c_custkey % 2 = 0 THEN 'none' ELSE '' END]) AS lines FROM customer""")
def markdown_sections(spark, sf_dir):
    """Notes on customers with sections, a deeper heading, a repeated section and an old name of one."""
    k = F.col("c_custkey")
    note = _say("lost\n# Summary\n- about ", F.col("c_name"), "\n* more\n\n# Results\nr ", k.cast("string"), "\n## detail\nx\n# Dangers\n", F.when(k % 2 == 0, "none\n").otherwise("\n"), "# summary\nagain")
    s = text.sections(table(spark, sf_dir, "customer").select(k.alias("doc_id"), note.alias("text")), aliases={"dangers": "risks"})
    return s.select("doc_id", "section", F.array_join("lines", "|").alias("lines"))


@query("""SELECT l_orderkey AS doc_id, l_linenumber AS claim_id, l_suppkey % 3 <= 1 AND (l_orderkey, l_linenumber + l_suppkey % 3) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem) AS grounded FROM lineitem""")
def cited_numbers(spark, sf_dir):
    """Each order is a text of one sentence a line with that line's own number; claims cite a sentence up to two further on, which may not exist."""
    l = table(spark, sf_dir, "lineitem")
    n = parts(l)
    l = l.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("claim_id"), "l_suppkey")
    sents = l.select("doc_id", F.col("claim_id").cast("int").alias("sid"), _say("Line gave ", (F.col("claim_id") + 1000).cast("string"), " units.").alias("sentence"))
    claims = l.select("doc_id", "claim_id", (F.col("claim_id") + F.col("l_suppkey") % 3).cast("int").alias("sid"), (F.col("claim_id") + 1000).cast("string").alias("number"))
    return text.ground_cited(claims, sents, parts=n).select("doc_id", "claim_id", "grounded")


@query("""WITH t AS (SELECT item_id, text, lower(regexp_extract(text, '[A-Za-z]{5,}')) AS w FROM benchmark), p AS (SELECT *, strpos(lower(text), w) AS pos FROM t), s AS (SELECT *, greatest(pos - 20, 1) AS lo FROM p)
SELECT item_id, CASE WHEN pos > 0 THEN (CASE WHEN lo > 1 THEN '…' ELSE '' END) || substr(text, lo, 40) || (CASE WHEN lo + 39 < length(text) THEN '…' ELSE '' END) END AS snippet FROM s WHERE w <> ''""")
def snippets(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").withColumn("w", F.lower(F.regexp_extract("text", "[A-Za-z]{5,}", 0))).where("w <> ''")
    return b.select("item_id", search.snippet(F.col("text"), F.col("w"), 40).alias("snippet"))


@query("""WITH t AS (SELECT p_partkey AS paper_key, 'Net' || upper(substr(p_name, 1, 2)) || p_partkey || ': ' || p_name AS title FROM part WHERE p_partkey % 20 = 0), x AS (SELECT o_orderkey AS text_id, o_orderkey * 20 % (SELECT max(p_partkey) FROM part) AS k FROM orders WHERE o_orderkey % 50 = 0),
m AS (SELECT text_id, paper_key FROM x JOIN t ON t.paper_key = x.k) SELECT text_id, paper_key FROM m JOIN t USING (paper_key) WHERE text_id % 3 = 1 OR text_id % 3 = 2 AND length(title) > 24""")
def title_mentions(spark, sf_dir):
    """Texts that name one part by its acronym, its whole title in capitals (enough for a long one), or only its bare number."""
    p, o = table(spark, sf_dir, "part").where("p_partkey % 20 = 0"), table(spark, sf_dir, "orders").where("o_orderkey % 50 = 0")
    papers = p.select(F.col("p_partkey").alias("paper_key"), _say("Net", F.upper(F.substring("p_name", 1, 2)), F.col("p_partkey").cast("string"), ": ", F.col("p_name")).alias("title"))
    top = table(spark, sf_dir, "part").agg(F.max("p_partkey").alias("top"))
    x = o.crossJoin(F.broadcast(top)).select(F.col("o_orderkey").alias("text_id"), (F.col("o_orderkey") * 20 % F.col("top")).alias("paper_key")).join(papers, "paper_key")  # one row
    name = F.regexp_extract("title", "^([^:]*)", 1)
    said = F.when(F.col("text_id") % 3 == 0, _say("no ", F.col("paper_key").cast("string"), " here")).when(F.col("text_id") % 3 == 1, _say("We follow ", name, ", as others.")).otherwise(_say("See ", F.upper("title"), "!"))
    shown = x.where("false").select("text_id", "paper_key")
    return match.title_mentions(x.select("text_id", said.alias("text")), papers, shown)


@query("""SELECT o_orderkey AS k, o_orderkey % 4 = 0 OR o_orderkey % 5 = 0 AS survey FROM orders""")
def survey_papers(spark, sf_dir):
    k = F.col("o_orderkey")
    title = F.when(k % 4 == 0, "Robots: A Systematic Review").otherwise(_say("Order ", k.cast("string")))
    abstract = F.when(k % 5 == 0, "In this work we give a survey of it.").when(k % 5 == 1, _say(F.repeat(F.lit("x"), F.lit(400)), " this survey")).otherwise("Nothing.")
    return table(spark, sf_dir, "orders").select(k.alias("k"), text.is_survey(title, abstract).alias("survey"))


@query("""SELECT o_orderkey AS doc_id, unnest(CASE o_orderkey % 6 WHEN 0 THEN [1, 3] WHEN 1 THEN [1] WHEN 2 THEN []::INT[] WHEN 3 THEN []::INT[] WHEN 4 THEN [2] ELSE [1, 2, 3] END) AS sid, unnest(CASE o_orderkey % 6 WHEN 0 THEN ['MVTec AD', 'VisA'] WHEN 1 THEN ['LIBERO'] WHEN 4 THEN [''] ELSE ['', '', ''] END) AS benchmarks FROM orders WHERE o_orderkey % 6 NOT IN (2, 3)""")
def own_claims(spark, sf_dir):
    """Texts of claims: repeated benchmarks, claims of others, denials, earlier work, and more claims than are kept."""
    best = "We achieve state-of-the-art results"
    texts = [
        [f"{best} on MVTec AD.", f"{best} on MVTec AD again.", f"{best} on VisA."], ["Our model outperforms all methods on LIBERO.", "Existing methods achieve state-of-the-art results in our field."], ["We do not reach state-of-the-art results.", "Recent state-of-the-art models achieve SOTA."],
        ["In our prior work we set a new SOTA.", "They achieve state-of-the-art results."], ["Nothing here.", "We outperform existing state-of-the-art methods."], [f"{best} on it.", f"{best} on Towel.", f"{best} everywhere.", f"{best} at last."],
    ]
    said = F.get(F.array(*[F.array(*map(F.lit, t)) for t in texts]), (F.col("o_orderkey") % 6).cast("int"))
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.posexplode(said).alias("p", "sentence")).select("doc_id", (F.col("p") + 1).alias("sid"), "sentence")
    return text.own_claims(s).select("doc_id", "sid", F.array_join("benchmarks", ",").alias("benchmarks"))


@query("""SELECT c_custkey AS doc_id, unnest(CASE c_custkey % 4 WHEN 0 THEN ['https://github.com/o' || c_custkey || '/repo'] WHEN 1 THEN ['https://gitlab.com/o' || c_custkey || '/a-b', 'https://github.com/x/long-name'] WHEN 2 THEN []::VARCHAR[] ELSE ['https://huggingface.co/o/m.' || c_custkey] END) AS url FROM customer""")
def repository_links(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    said = [
        _say("Our code is at https://github.com/O", k, "/repo.git."), _say("Code: https://gitlab.com/o", k, "/a-b and the project lies at https://github.com/x/long-\nname, code https://github.com/x/long"),
        _say("Code of it: https://github.com/features/actions, and", F.repeat(F.lit(" x"), F.lit(60)), " https://github.com/o/plain"), _say("available (https://huggingface.co/o/m.", k, ")"),
    ]
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.get(F.array(*said), (F.col("c_custkey") % 4).cast("int")).alias("text"))
    return links.repository_links(d)


@query("""SELECT s_suppkey AS k, s_suppkey % 3 = 0 OR s_suppkey % 5 = 0 AS corroborated, CASE s_suppkey % 4 WHEN 0 THEN 'list' WHEN 1 THEN 'not_code' ELSE 'code' END AS kind FROM supplier""")
def repository_checks(spark, sf_dir):
    k = F.col("s_suppkey")
    said = _say("implementation", F.when(k % 3 == 0, " of gaussian splatting").when(k % 3 == 1, " of gaussian things").otherwise(""), F.when(k % 5 == 0, " by lindqvist").otherwise(""))
    name = F.when(k % 4 == 0, "awesome-robots").when(k % 4 == 1, "net-dataset").otherwise(_say("net", k.cast("string")))
    return table(spark, sf_dir, "supplier").select(k.alias("k"), links.corroborates(said, F.lit("Gaussian Splatting for all"), F.array(F.lit("A. Lindqvist"))).alias("corroborated"), links.repo_kind(name).alias("kind"))


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS doc_id, l_suppkey % 40 AS s, l_partkey % 3 AS v FROM lineitem), o AS (SELECT doc_id, s, count(DISTINCT v) AS n, min(v) AS v FROM m GROUP BY ALL) SELECT doc_id, 'Net-' || s AS name, s * 10 + v AS ref_id FROM o WHERE n = 1 AND v = 0""")
def bibliography_links(spark, sf_dir):
    """Names cited after each mention: only those always cited alike whose reference bears the name, not its version 2."""
    l = table(spark, sf_dir, "lineitem")
    s, v = F.col("l_suppkey") % 40, F.col("l_partkey") % 3
    m = l.select(F.col("l_orderkey").alias("doc_id"), _say("Net-", s.cast("string")).alias("name"), (s * 10 + v).alias("ref_id")).distinct()
    k = F.col("ref_id")
    n = F.floor(k / 10).cast("string")
    bib = m.select("ref_id").distinct().select("ref_id", F.when(k % 10 == 0, _say("The Net ", n, ": strong and small")).when(k % 10 == 1, _say("Net-", n, " v2 at scale")).otherwise("Other work").alias("title"))
    return links.bibliography_links(m, bib)


@query("""SELECT p_partkey AS page_id, CASE p_partkey % 5 WHEN 0 THEN 'row_missing' WHEN 1 THEN 'value_differs' WHEN 2 THEN 'ambiguous_row' ELSE 'verified' END AS status FROM part""")
def verified_cells(spark, sf_dir):
    """Claims against their page's table: the value as a ratio or a percentage, a wrong value, a repeated and a missing row."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    size = (F.col("p_size") % 50 + 2).cast("string")
    rows = F.when(k % 5 == 0, "<tr><td>Other<td>3.5").when(k % 5 == 2, _say("<tr><td>Net-A<td>", size, "<tr><td>net a<td>", size)).otherwise(_say("<tr><td>Net-A [3]<td>", size, ".5"))
    pages = p.select(k.alias("page_id"), _say("<table><tr><th>M<th>SR", rows, "</table>").alias("html"))
    value = (F.col("p_size") % 50 + 2.5) / F.when(k % 5 == 3, 100).otherwise(1) + F.when(k % 5 == 1, 7).otherwise(0)
    claims = p.select(k.alias("page_id"), F.when(k % 5 == 2, "Net A").otherwise("Net-A 3").alias("model"), value.alias("value"))
    return cells.verify_cell(claims, readers.html_cells(pages), "page_id").select("page_id", "status")


@query("""WITH e AS (SELECT user_id, (ts::DATE - DATE '2024-01-01')::INT AS d FROM events WHERE event_id % 7 = 0), n AS (SELECT user_id // 10 AS c, count(DISTINCT d) AS days, min(d) AS a, max(d) AS z, count(DISTINCT user_id) AS u FROM e GROUP BY 1)
SELECT c, days, a, z FROM n WHERE u > 1 AND days >= 3""")
def thread_chains(spark, sf_dir):
    """Users of one ten are linked one to the next that occurs; chains of at least three days."""
    e = table(spark, sf_dir, "events").where("event_id % 7 = 0").select(F.col("user_id").alias("thread_id"), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("day"))
    u = e.select("thread_id", F.floor(F.col("thread_id") / 10).alias("c")).distinct()
    edges = u.join(u.groupBy("c").agg(F.min("thread_id").alias("dst")), "c").where("thread_id <> dst").select(F.col("thread_id").alias("src"), "dst")
    chains = impact.thread_chains(e, connected_components(edges))
    return chains.select(F.floor(F.col("component") / 10).alias("c"), "days", F.col("first_day").alias("a"), F.col("last_day").alias("z"))


@query("""WITH i AS (SELECT o_orderkey AS k, o_custkey % 10 AS profile_id, o_orderdate AS at, ['captured', 'not_delivered', 'ranked_out', 'excluded', 'no_core_hit', 'not_retrieved', 'before_monitoring', 'not_yet_evaluable'][o_orderkey % 8 + 1] AS stage, o_orderkey % 8 AS s, ['x' || o_orderkey % 3, 'y' || o_orderkey % 5] AS axes FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'),
a AS (SELECT profile_id, axis, count(*) AS n FROM (SELECT profile_id, unnest(list_distinct(axes)) AS axis FROM i) GROUP BY ALL), t AS (SELECT profile_id, string_agg(axis, ',' ORDER BY n DESC, axis) AS top_axes FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY n DESC, axis) AS r FROM a) WHERE r <= 3 GROUP BY 1)
SELECT profile_id, count(*) AS items, count(*) FILTER (s < 6) AS evaluable, count(*) FILTER (s < 5) AS retrieved, count(*) FILTER (s < 3) AS core_hit, count(*) FILTER (s = 0) AS delivered, count(*) FILTER (s BETWEEN 1 AND 5) AS missed, any_value(top_axes) AS top_axes FROM i JOIN t USING (profile_id) GROUP BY 1""")
def evidence_summary(spark, sf_dir):
    k = F.col("o_orderkey")
    stages = ("captured", "not_delivered", "ranked_out", "excluded", "no_core_hit", "not_retrieved", "before_monitoring", "not_yet_evaluable")
    items = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("profile_id"), F.col("o_orderdate").cast("timestamp").alias("discovered_at"), F.get(F.array(*map(F.lit, stages)), (k % 8).cast("int")).alias("gap_stage"), F.array(_say("x", (k % 3).cast("string")), _say("y", (k % 5).cast("string"))).alias("axes"))
    s = evidence.evidence_summary(items, F.lit("1995-01-01").cast("timestamp"), F.lit("1996-01-01").cast("timestamp"), top=3)
    return s.withColumn("top_axes", F.array_join("top_axes", ","))


@query("SELECT DISTINCT event_id FROM events")
def stream_deduplicated(spark, sf_dir):
    """The events, each of which the lagging source tells twice."""
    s = streams.read_files(spark, f"{sf_dir}/events.parquet*", EVENTS).select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.explode(F.array(F.lit(1), F.lit(2))).alias("told"))
    return streams.run_to_table(streams.deduplicated(s, "ts", "event_id"), "append").select("event_id")


@query("WITH d AS (SELECT event_type, ts, unnest(range(0, 7)) AS back FROM events) SELECT (ts::DATE - back::INT)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM d GROUP BY ALL")
def stream_sliding_counts(spark, sf_dir):
    s = streams.read_files(spark, f"{sf_dir}/events.parquet*", EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.run_to_table(streams.sliding_counts(s, "ts", "event_type", "7 days", "1 day"))


@query("SELECT DISTINCT user_id, (ts + INTERVAL 9 HOUR - INTERVAL 5 HOUR)::DATE AS day FROM events")
def stream_once_a_day(spark, sf_dir):
    """One row a user and operating day, however many events and batches tell of it."""
    from driftwell.functions.keys import operating_day

    at = f"{checkpoint_dir(spark)}/daily-{uuid.uuid4().hex}"
    s = streams.read_files(spark, f"{sf_dir}/events.parquet*", EVENTS).select("user_id", operating_day(F.col("ts").cast("timestamp")).alias("day"))
    sink = streams.once_a_day_sink(f"{at}/table", ["user_id", "day"])
    for run in ("a", "b"):  # two streams over the same events: the second finds nothing new
        s.writeStream.foreachBatch(sink).option("checkpointLocation", f"{at}/{run}").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/table").select("user_id", "day")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1")
def stream_upserts(spark, sf_dir):
    """First and last time and newest type of each user, kept by a stream."""
    at = f"{checkpoint_dir(spark)}/upserts-{uuid.uuid4().hex}"
    order = F.struct(F.col("ts").cast("timestamp").alias("ts"), "event_id")
    s = streams.read_files(spark, f"{sf_dir}/events.parquet*", EVENTS).select("user_id", F.col("event_type").alias("last_type"), F.col("ts").cast("timestamp").alias("first_seen"), order.alias("at"))
    sink = streams.upsert_sink(f"{at}/table", ["user_id"], "at", overwrite=["last_type"], keep_first=["first_seen"])
    s.writeStream.foreachBatch(sink).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return streams.latest_version(spark, f"{at}/table").select("user_id", "last_type", "first_seen", F.col("at.ts").alias("last_seen"))
