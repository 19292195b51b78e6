"""Small cases of the findings of round 3, each wrong or unbounded before."""

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from driftwell.functions import keys
from driftwell.functions import numbers as N
from driftwell.operators import cells, impact, search, similar, tables, terms, text
from driftwell.plans import queries
from driftwell.plans.queries import QUERIES
from driftwell.sources import paged, readers
from driftwell.streaming import stateful


def test_similar_items_meet_in_blocks_of_their_group(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 40)  # many blocks a group: neighbours lie in the same and in others
    texts = [f"{a}{b}{c} stone {a}{c}" for a in "abcd" for b in "efgh" for c in "klm"] + ["quite another", "nothing like it"]
    rows = [(k, None if k % 5 == 0 else "g", t) for k, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "k long, grp string, text string").repartition(3)
    sets = {k: {t[i : i + 3] for i in range(len(t) - 2)} for k, _, t in rows}
    for least in (0.45, 0.8):
        want = {a for a, g, _ in rows for b, h, _ in rows if a != b and g == h and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9}
        assert {r.k for r in similar.near_duplicates(d, "grp", "k", least=least).collect()} == want


def test_near_duplicate_titles_as_in_the_sql(spark, tmp_path):
    titles = ["abcdeX", "abcdeY", "abc", "abc", "quite", "quite", "other one", "other one"]
    urls = ["http://h/en/1", "http://h/en/2", "http://h/en/3", "http://h/en/4", "http://h/en/5", "http://h/en/6", None, None]
    rows = [(k, u, f"<title>{t}</title>") for k, (t, u) in enumerate(zip(titles, urls, strict=True))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(r.page_id for r in QUERIES["near_duplicate_titles"](spark, str(tmp_path)).collect()) == [2, 3, 6, 7]


def test_most_cited_ties_go_to_the_first_row(spark):
    r = spark.createDataFrame([("p", m, 1, at) for at, m in enumerate(["z", "a", "m"])], "k string, model string, row_no int, at int")
    c = spark.createDataFrame([("z", 7), ("a", 7), ("m", 7)], "model string, citations long")
    assert [tuple(x) for x in cells.most_cited(r, c, ["k"], ("row_no", "at")).collect()] == [("p", "z", 3)]
    assert [x.model for x in cells.most_cited(r.withColumn("row_no", -F.col("at")), c, ["k"]).collect()] == ["m"]


def test_unknown_language_is_no_measured_result(spark, tmp_path):
    d = spark.createDataFrame([(8, "said", None, 6), (18, "so", "en", 6), (28, "und", "de", 6)], "doc_id long, text string, lang string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.paper_key for r in QUERIES["result_excerpts"](spark, str(tmp_path)).collect()] == [18]


def test_reference_pairs_of_small_and_large_sets(spark, monkeypatch):
    monkeypatch.setattr(impact, "WIDE", 6)  # both ways, alone and mixed
    refs = {p: {(p // 3 * 7 + k * (1 + p % 2)) % 40 for k in range(3 + p % 9)} for p in range(60)}
    rows = [(p, r) for p, s in refs.items() for r in s]
    d = spark.createDataFrame([*rows, *rows[:50], (None, 1), (1, None)], "p long, r long").repartition(3)
    for least in (0.34, 0.7):
        want = {(a, b): len(refs[a] & refs[b]) / len(refs[a] | refs[b]) for a in refs for b in refs if a < b}
        want = {k: v for k, v in want.items() if v >= least}
        got = impact.reference_similarity(d, "p", "r", least)
        assert {(x.a, x.b): x.similarity for x in got.collect()} == want and got.count() == len(want) > 20


def test_reference_pairs_move_only_with_their_rarest_references(spark):
    d = spark.createDataFrame([(p, r) for p in range(20) for r in (p // 2, 50 + p // 4)], "p long, r long")
    plan = impact.reference_similarity(d, "p", "r", 0.34)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" not in plan


def test_components_broadcast_no_pointers(spark):
    from driftwell.operators import graph

    asked = []
    keep = graph.counted
    graph.counted = lambda df, c: (asked.append(df._jdf.queryExecution().executedPlan().toString()), keep(df, c))[1]
    try:
        got = graph.connected_components(spark.createDataFrame([(k, k + 1) for k in range(9)], "src long, dst long"))
    finally:
        graph.counted = keep
    assert {r.component for r in got.collect()} == {0} and len(asked) > 2 and not any("BroadcastHashJoin" in p for p in asked)


def test_pages_are_dealt_out_before_they_are_parsed(spark):
    pages = spark.createDataFrame([(k, f"<table><tr><th>M<tr><td>{k}</table>") for k in range(40)], "page_id long, html string").coalesce(1)
    rows = readers.table_rows(pages)
    assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted((r.page_id, r.row, r.cells[0]) for r in rows.collect()) == sorted(x for k in range(40) for x in ((k, 0, "M"), (k, 1, str(k))))


def test_a_sentence_is_searched_once(spark):
    d = spark.createDataFrame([("accuracy of 71.5% and 3.2% of the data",), ("in Section 4.2 accuracy",), (None,)], "s string").withColumn("v", N.scored_value(F.col("s")))
    assert [r.v for r in d.collect()] == [True, False, False]
    assert d._jdf.queryExecution().analyzed().toString().count("solve rates") == 1


def test_grouped_pages_are_dealt_out_before_they_are_parsed(spark):
    rows = [(k, f"<table><tr><th>a<tr><td>{k}.5</table>") for k in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, html string").groupBy("page_id").agg(F.max("html").alias("html"))
    at = readers.table_rows(pages).select("row", F.spark_partition_id().alias("part"))
    assert at.select("part").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_columns_are_read_once_a_table(spark):
    """Rows of a table with two benchmarks, one named by a row; no expression on headers runs on the cells."""
    table = "<table><caption>SR (%) averaged over 3 runs</caption><thead><tr><th>Method<th>A1 SR<th>B1 F1<tbody>" + "".join(f"<tr><td>Net {n}<td>{k}.5<td>{k}.25" for k, n in enumerate("PQ")) + "</table>"
    rows = tables.bands(readers.table_rows(spark.createDataFrame([(1, table)], "page_id long, html string"))).cache()
    papers = spark.createDataFrame([(1, None, ["A1", "B1"])], "page_id long, method string, benchmarks array<string>")
    r = tables.table_results(rows, papers)
    assert {(x.locator, x.metric_key, x.bench_key, x.model, x.unit, x.averaged_over) for x in r.collect()} == {
        ("t0.r1.c1", "a1sr", "a1", "Net P", "%", 3), ("t0.r2.c1", "a1sr", "a1", "Net Q", "%", 3), ("t0.r1.c2", "b1f1", "b1", "Net P", None, 3), ("t0.r2.c2", "b1f1", "b1", "Net Q", None, 3),
    }
    cells = r._jdf.queryExecution().optimizedPlan().toString().split("Generate posexplode")[0]
    assert "accuracy|solve rates" not in cells


def test_runs_with_a_stop_word_at_an_edge_are_never_counted(spark):
    d = spark.createDataFrame([(1, "of the deep networks and the end- cases grow"), (2, None), (3, "")], "doc_id long, text string")
    raw = {r.term for r in terms.raw_term_documents(d).collect()}
    assert raw == {"deep networks", "cases grow"}
    assert {r.term for r in terms.term_documents(d).collect()} == {r.term for r in terms.hygienic(terms.ngrams(d)).collect()}


def test_breadth_is_counted_without_sets(spark):
    rows = [("zebra crossing", s, k, s == "a") for k, s in enumerate(["a", "b", "a", None, "b"])] + [("rare one", "a", 9, False)]
    t = terms.discover(spark.createDataFrame(rows, "term string, seed string, day int, dom boolean"), None, "doc_id", "seed", "day", "dom")
    assert [tuple(r) for r in t.collect()] == [("zebra crossing", 5, 2, 2, 4)] and dict(t.dtypes)["breadth"] == "int"
    assert "collect_set" not in t._jdf.queryExecution().optimizedPlan().toString()


def test_searches_pass_by_letters_that_begin_no_match(spark):
    for p in (N.METRIC_ABBR, N.METRIC_PHRASE, N.VALUE, N.SECTION_MARK):
        assert p.removeprefix("(?i)").startswith("(?=")
    d = spark.createDataFrame([("SR 3.5 and mAP, 12 %",), ("none",), ("",), (None,)], "s string")
    got = d.select(N._spans(F.col("s"), N.METRIC_ABBR).alias("names"), N._spans(F.col("s"), N.VALUE).alias("values")).collect()
    assert [r.names and [(x.lo, x.hi) for x in r.names] for r in got] == [[(0, 2), (11, 14)], [], [], None]
    assert [tuple(x) for x in got[0]["values"]] == [(3, 6, "SR ", " and mAP, "), (16, 20, " and mAP, ", "")]


def test_a_sentence_is_not_taken_to_pieces(spark):
    """One search tells whether a value is near: no pieces of the text, no spans; each case is one way to be near or not."""
    far = " x" * 19 + "  "  # 40 characters
    want = {
        f"accuracy{far}71.5%": True, f"accuracy{far} 71.5%": False, f"71.5%{far} F1": False, f"71.5 %{far}F1": True, "F1 score, F1-score 5.": False,
        "sec. 4.2 and SEC 5.1%, Section\n6.5 F1 §7.5": False, "sec. 4.2 and Section5.1 F1 7.5": True, "sections 4.2 F1": True, "9.5% for time, 8.5 of the data: F1": False, "9.5% for times F1": True, "mAP@0.5": False, "mAP@0.5 0.5": True, "recall@5%": False, "xF1 7.5": False,
    }
    d = spark.createDataFrame([(k,) for k in want], "s string").select("s", N.scored_value(F.col("s")).alias("v"))
    assert {r.s: r.v for r in d.collect()} == want
    assert "lambda" not in d._jdf.queryExecution().analyzed().toString()


def test_markdown_tables_are_found_inside_their_row(spark):
    said = "| z |\n# One\nx\n| a | b |\n|---|---|\n| 1 |\n## Two\n|---|\n\n |c|d|e|\n| 2.5 | | 7"
    d = spark.createDataFrame([(1, said), (2, None), (3, "")], "doc_id long, text string")
    m = readers.markdown_cells(d)
    assert sorted(tuple(r) for r in m.collect()) == [
        (1, 1, None, 0, 0, "z", None), (1, 2, "One", 0, 0, "a", None), (1, 2, "One", 0, 1, "b", None), (1, 2, "One", 1, 0, "1", 1.0), (1, 2, "One", 1, 1, "", None),
        (1, 4, "Two", 0, 0, "c", None), (1, 4, "Two", 0, 1, "d", None), (1, 4, "Two", 0, 2, "e", None),
    ]
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan


def test_large_tables_are_dealt_out_in_more_parts(spark, monkeypatch):
    monkeypatch.setattr(queries, "TASK_ROWS", 10)
    assert queries.dealt(spark.range(95), "id").rdd.getNumPartitions() == 10 and queries.dealt(spark.range(5), "id").rdd.getNumPartitions() == 4


def test_claims_meet_their_block_of_sentences(spark):
    sents = spark.createDataFrame([(1, k, f"{k} and {k}.5") for k in (30, 31, 32, 33, 40)] * 2 + [(1, 50, None), (2, 31, "7")], "doc_id long, sid int, sentence string")
    want = {(31, "32.5"): True, (32, "31"): True, (33, "31"): False, (34, "33"): False, (50, "50"): False, (40, "40"): True, (None, "40"): False, (33, None): False}
    claims = spark.createDataFrame([(1, k, *c) for k, c in enumerate(want)], "doc_id long, claim_id int, sid int, number string")
    for parts in (None, 3):
        g = text.ground_cited(claims, sents, parts=parts)
        assert {(r.sid, r.number): r.grounded for r in g.collect()} == want and g.count() == len(want)
    assert g._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_shared_references_are_made_distinct_where_papers_lie(spark, tmp_path):
    cites = spark.createDataFrame([(1, 7), (1, 7), (2, 7), (3, 8), (3, 8), (None, 8), (4, 9), (5, 9), (5, None), (6, None)], "paper_id long, ref_id long")
    s = impact.shared_references(cites.repartition(5, "paper_id"))
    assert s._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(") == 2  # by the paper, then by the reference
    assert [tuple(r) for r in s.collect()] == [(None, 2), (7, 2), (9, 2)]


def test_a_number_is_read_once_a_cell(spark):
    d = spark.createDataFrame([("1,234.5%",), ("−3",), ("1 / 2",), ("1e999",), ("ResNet50",), ("a/b 7",), (None,)], "t string").select(keys.cell_number(F.col("t")).alias("v"))
    assert [r.v for r in d.collect()] == [1234.5, -3.0, None, None, None, 7.0, None]
    assert d._jdf.queryExecution().optimizedPlan().toString().count("try_cast") <= 1 and d._jdf.queryExecution().analyzed().toString().count("regexp_extract") == 1


def test_a_key_of_a_stream_has_one_value_in_the_store():
    """Each call of the store waits for an answer, so a batch may read and write a key's state once, however many presses it holds."""

    class Value:
        held, calls = None, 0

        def get(self):
            self.calls += 1
            return self.held

        def update(self, value):
            self.calls, self.held = self.calls + 1, value

        def clear(self):
            self.held = None

    class Handle:
        def __init__(self):
            self.values = []

        def getValueState(self, *_):
            self.values.append(Value())
            return self.values[-1]

        registerTimer = deleteTimer = lambda self, at: None

    h, p = Handle(), stateful.ReactionStates()
    p.init(h)
    press = [Row(at=k * 10**6, action=a, event_id=str(k), delivered=-(10**9), expires=10**12) for k, a in enumerate(["more", "useful", "out", "more"])]
    assert {r.event_id: r.status for r in p.handleInputRows(("t",), iter(press[:2]), None)} == {"0": "valid", "1": "valid"}
    assert {r.event_id: r.status for r in p.handleInputRows(("t",), iter(press[2:]), None)} == dict.fromkeys("0123", "burst")
    assert len(h.values) == 1 and h.values[0].calls == 4
    h, n = Handle(), stateful.ChangeNotices(["a"], ["k"], 1000)
    n.init(h)
    rows = [Row(kind=kind, micros=at, axes={"a": v}) for kind, at, v in (("state", 1, "x"), ("sent", 2, "x"), ("state", 3, "y"))]
    assert [r.changed for row in rows for r in n.handleInputRows((1,), iter([row]), None)] == [["a"], [], ["a"]]
    assert len(h.values) == 1 and h.values[0].calls == 6


def test_a_landed_page_is_found_by_keys_and_read_in_batches(spark, tmp_path, monkeypatch):
    keys_ = [f"k{k:04}" for k in range(300)]
    spark.createDataFrame([(k, int(k[1:])) for k in keys_] + [(None, -1)], "key string, v long").repartition(3).write.parquet(f"{tmp_path}/pages")
    monkeypatch.setattr(paged.LandedPages, "BATCH", 7)
    feed = paged.LandedPages(f"{tmp_path}/pages")
    for before, after, size in ((None, None, 40), ("k0100", None, 40), ("k0100", "k0090", 40), (None, "k0299", 5), (None, None, 1000), ("k0005", None, 5)):
        page = [k for k in reversed(keys_) if (before is None or k < before) and (after is None or k > after)][:size]
        assert feed.ends(before, after, size) == ((page[0], page[-1], len(page)) if page else None)
        assert [r["key"] for r in feed(before, after, size)] == page
    rows = feed.rows("k0100", "k0050", ["v", "none", "key"])
    assert iter(rows) is rows and sorted(rows) == [(k, None, f"k{k:04}") for k in range(50, 100)]

    def whole(self, *_):
        raise AssertionError("a page was held whole")

    monkeypatch.setattr(paged.LandedPages, "__call__", whole)
    q = paged.paged_feed(spark, feed, "key string, v long", name="landed", page_size=50, max_pages=9).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.v for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(300))


def test_each_task_keeps_the_best_documents_of_a_query(spark, monkeypatch):
    """Many strips, blocks and merges: pairs as in a plain count, and with k no more rows than k a query, task and block."""
    for name, value in (("STRIP", 2), ("BLOCK", 4), ("DOCS", 7), ("CELLS", 60), ("PAIRS", 5)):
        monkeypatch.setattr(search, name, value)
    words = ["ant", "bee", "cat", "dog", "eel", "fox", "gnu", "hen"]
    said = {i: " ".join(words[(i * j + j * j) % 8] for j in range(i % 9)) for i in range(90)} | {90: None, 91: "", 92: "none of them"}
    asked = {j: " ".join(words[(j * 3 + n) % 8] for n in range(1 + j % 4)) + " ant" * (j % 3) for j in range(9)} | {9: "unheard", 10: "", 11: None}
    docs = spark.createDataFrame([(f"d{i:02}", t) for i, t in said.items()], "doc_id string, text string").repartition(3)
    queries = spark.createDataFrame(list(asked.items()), "query_id int, query string")
    held = {f"d{i:02}": (t or "").split() for i, t in said.items()}
    mean, df = sum(map(len, held.values())) / len(held), {w: sum(w in t for t in held.values()) for w in words}
    part = lambda w, t: np.log(1 + (len(held) - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean))
    want = {(j, i): sum(part(w, t) for w in q.split() if w in t) for j, q in asked.items() if q for i, t in held.items() if set(q.split()) & set(t)}
    every = search.bm25(docs, queries)
    got = {(r.query_id, r.doc_id): r.score for r in every.collect()}
    assert got.keys() == want.keys() and max(abs(got[x] - want[x]) for x in want) < 1e-6 and dict(every.dtypes)["query_id"] == "int"
    best = search.bm25(docs, queries, 2)
    assert best.count() <= 2 * 9 * 3
    first = {(j, i) for j in asked for i in sorted((i for q, i in got if q == j), key=lambda i: (-got[j, i], i))[:2]}
    assert {(r.query_id, r.doc_id) for r in search.top_k(best, "query_id", 2, "doc_id").collect()} == first
    assert "Join" not in best._jdf.queryExecution().optimizedPlan().toString()


def test_hybrid_ranks_without_pairs_of_documents_and_queries(spark, tmp_path):
    rows = {"benchmark": ([(0, "red fox"), (100, "blue")], "item_id long, text string"), "documents": ([(1, "red fox"), (2, "red sea"), (3, "fox red fox fox"), (4, None)], "doc_id long, text string")}
    rows["embeddings"] = ([(0, [1.0, 0.0]), (2, [1.0, 0.1]), (5, [0.0, 1.0])], "vec_id long, embedding array<float>")
    for name, (r, schema) in rows.items():
        spark.createDataFrame(r, schema).repartition(2).write.parquet(f"{tmp_path}/{name}.parquet")
    d = QUERIES["hybrid_rrf"](spark, str(tmp_path))
    # by words 3, 1, 2, by vectors 0, 2, 5
    assert [(r.query_id, r.id, r.score, r["rank"]) for r in d.orderBy("query_id", "rank").collect()] == [
        (0, 2, round(1 / 63 + 1 / 62, 8), 1), (0, 0, round(1 / 61, 8), 2), (0, 3, round(1 / 61, 8), 3), (0, 1, round(1 / 62, 8), 4), (0, 5, round(1 / 63, 8), 5),
    ]
    assert "Join" not in d._jdf.queryExecution().optimizedPlan().toString()


def test_sentences_tell_the_metric_of_a_column(spark):
    cells_ = spark.createDataFrame([(1, True, "A1", "71.5%", 0, 2, ["A1"], ""), (2, True, "A1", "64.0%", 0, 3, ["A1"], "")], "page_id long, own boolean, bench string, text string, table_id int, col int, path array<string>, caption string")
    sents = spark.createDataFrame([(1, "On A1 our Net reaches an accuracy of 71.5% overall."), (2, "On A1 our Net reaches 64.0% recall.")], "page_id long, sentence string")
    papers = spark.createDataFrame([(1, "Net", ["A1"]), (2, "Net", ["A1"])], "page_id long, method string, benchmarks array<string>")
    assert {tuple(r) for r in tables.author_metrics(cells_, sents, papers).collect()} == {(1, 0, 2, "accuracy"), (2, 0, 3, "recall")}
