"""Small cases of the findings of round 4, each wrong or unbounded before."""

from driftwell.operators import graph, tables
from driftwell.plans.queries import QUERIES
from driftwell.sources import readers
from tests.conftest import SF


def test_components_plan_each_round_alike(spark):
    """The size that Spark believes a round's tables to have has no more digits than the joins of one round give it."""
    edges = [(k, k + 1) for k in range(0, 40)] + [(100 + k * 7 % 20, 100 + (k + 1) * 7 % 20) for k in range(19)] + [(5, 200), (200, 201)]
    digits, keep = [], graph.counted
    graph.counted = lambda df, c: (digits.append(len(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))), keep(df, c))[1]
    try:
        got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    finally:
        graph.counted = keep
    assert got == {n: 0 if n < 41 or n >= 200 else 100 for e in edges for n in e}
    assert len(digits) > 6 and max(digits) <= 100


def test_cells_of_both_kinds_of_tables_go_one_way(spark):
    """A table read by rows, one of models as columns, and one whose label names the benchmark: their cells are laid out once."""
    html = [
        "<table><caption>SR (%)</caption><thead><tr><th>Method<th>A1<th>DS<tbody><tr><td>Base<td>1.5<td>2.5<tr><td>+ Ours<td>3.5<td>4.5<tr><td>Net a1<td>6.5<td>x</table>",
        "<table><caption>Success rate on the A1 benchmark</caption><tr><th><th>Net P<th>Net Q (Ours)<tr><th scope=row>Task 1<td>1.5%<td>2.5<tr><th scope=row>Task 2<td>3.5<td>4.5</table>",
    ]
    rows = tables.bands(readers.table_rows(spark.createDataFrame(list(enumerate(html)), "page_id long, html string"))).cache()
    r = tables.table_results(rows, spark.createDataFrame([(k, None, ["A1"]) for k in range(2)], "page_id long, method string, benchmarks array<string>"))
    assert r._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode") == 1
    got = {(x.page_id, x.locator, x.metric_key, x.direction, x.value, x.model, x.own, x.base_row, x.unit, x.orientation, x.told, x.bench_key) for x in r.collect()}
    assert got == {
        (0, "t0.r1.c1", "sr", "higher", 1.5, "Base", False, None, "%", "rows", False, "a1"), (0, "t0.r2.c1", "sr", "higher", 3.5, "Base + Ours", True, 1, "%", "rows", False, "a1"),
        (0, "t0.r3.c1", "sr", "higher", 6.5, "Net", False, None, "%", "rows", False, "a1"),
        *((1, f"t0.r{t}.c{c}", f"srtask{t}", "higher", v, m, o, None, u, "transposed", False, "a1") for t, c, v, m, o, u in ((1, 1, 1.5, "Net P", False, "%"), (1, 2, 2.5, "Net Q (Ours)", True, None), (2, 1, 3.5, "Net P", False, None), (2, 2, 4.5, "Net Q (Ours)", True, None))),
    }


def test_pages_written_plainly_are_cut_at_their_tags(monkeypatch):
    cell = ["Net 7 & co", "<", "a > b", "&lt;b&gt;", "<!-- <td>x -->", "<br/>", "<br>", "<b title='>'>y</b>", "<script><td>1</script>", "<td", "<td/>", "<td colspan = 2>", "<math alttext='\\pm 3'><mn>3</mn></math>"]
    head = ["<table>", "<TABLE class='a b'>", "<table><caption>A &amp; b</caption>", "<table><thead><tr><th rowspan=2>M<th colspan=\"2\">B<tr><th Scope=col>x<th>y</thead>"]
    pages = [f"{h}<tr><td>{a}<th scope=row>{b}</th><td rowspan=2>3<tr><td>{b}<td class='ltx_th_row' colspan=2>{a}</table> tail {a}" for h in head for a in cell for b in cell]
    quick = [readers.grids(x) for x in pages]
    fed, keep = [], readers._Tables.feed
    monkeypatch.setattr(readers._Tables, "feed", lambda self, x: (fed.append(x), keep(self, x)))
    assert readers.grids("<table><tr><td>1 &lt; 2</td><th scope=row>a<td colspan='2'>b</table>")[0][3] == ["1 < 2", "a", "b", "b"] and not fed
    monkeypatch.setattr(readers._Tables, "read", lambda self, x: (keep(self, x), self.close()))
    assert [readers.grids(x) for x in pages] == quick and sum(map(bool, quick)) > 50


def test_pages_are_laid_out_once_for_all_stages(spark):
    """What is left to do once rows and results are there reads no lines again: papers know of their page from where it was kept."""
    a = QUERIES["document_analysis"](spark, SF)
    assert "Relation" not in a._jdf.queryExecution().optimizedPlan().toString()
    assert a.where("reason = 'no_html'").count() > 0 and a.where("reason is null").count() > 0


def test_a_number_is_read_once_before_its_cell_is_a_row(spark):
    """Cells without a number never become rows; the search for the number stands once in the plan."""
    d = spark.createDataFrame([(1, 0, "SR (%)", 0, ["M", "A1", "A1 DS"], True, False), (1, 0, "SR (%)", 1, ["Net P", "1,234.5", "−2"], False, False)], "page_id long, table_id int, caption string, row int, cells array<string>, is_header boolean, is_group boolean").cache()
    r = tables.table_results(d, spark.createDataFrame([(1, None, ["A1"])], "page_id long, method string, benchmarks array<string>"))
    assert sorted((x.locator, x.value) for x in r.collect()) == [("t0.r1.c1", 1234.5), ("t0.r1.c2", -2.0)]
    assert r._jdf.queryExecution().optimizedPlan().toString().count(r"(?=[-+.\d])") == 1
