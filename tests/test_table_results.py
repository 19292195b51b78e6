"""Tables to results: grids, header bands, blocks, formulas, metrics, orientation and consistency."""

from pyspark.sql import functions as F

from driftwell.functions import numbers as N
from driftwell.functions.keys import cell_number
from driftwell.operators import tables, text
from driftwell.sources import readers

ROWS = "page_id long, table_id int, caption string, row int, cells array<string>, is_header boolean, is_group boolean"


def grid(spark, *all_tables, groups=()):
    rows = [(1, k, caption, r, cells, r < heads, r in groups) for k, (caption, heads, g) in enumerate(all_tables) for r, cells in enumerate(g)]
    return spark.createDataFrame(rows, ROWS).repartition(3)


def papers(spark, method="Novel", benchmarks=("Bench-Z",)):
    return spark.createDataFrame([(1, method, list(benchmarks))], "page_id long, method string, benchmarks array<string>")


def results(spark, *all_tables, sents=None, **paper):
    s = None if sents is None else spark.createDataFrame([(1, t) for t in sents], "page_id long, sentence string")
    return tables.table_results(grid(spark, *all_tables), papers(spark, **paper), s)


def each(spark, *all_tables, sents=None, **paper):
    """Results of tables that are each the only one of its page, by page."""
    rows = [(k, 0, caption, r, cells, r < heads, False) for k, (caption, heads, g) in enumerate(all_tables) for r, cells in enumerate(g)]
    kw = {"method": "Novel", "benchmarks": ["Bench-Z"]} | paper
    p = spark.createDataFrame([(k, kw["method"], list(kw["benchmarks"])) for k in range(len(all_tables))], "page_id long, method string, benchmarks array<string>")
    s = None if sents is None else spark.createDataFrame(list(enumerate(sents)), "page_id long, sentence string")
    return tables.table_results(spark.createDataFrame(rows, ROWS).repartition(3), p, s).cache()


def own(df):
    return {r.page_id: r for r in df.where("own").collect()}


def simple(value="48.0 (+6.0)", header="success rate", caption="Bench-Z results.", rows=None):
    return caption, 1, [["Method", header], *(rows or [["Base-A", "42.0"], ["Ours", value]])]


def test_formulas(spark):
    want = {
        r"\mathbf{71.0}{\scriptstyle\,\bm{\pm}\,\mathbf{0.8}}": "71.0 ± 0.8", r"\underline{65.0}": "65.0", r"45.2\%": "45.2%", r"71.0\pm0.8\%": "71.0 ± 0.8%", r"\textcolor{gray}{2.5}": "2.5",
        r"43.17_{{\color[rgb]{0.45,0.45,0.45}\scriptscriptstyle 2.18}}": "43.17 ± 2.18", "87.2_{1}": "87.2 ₁", r"45_{\scriptstyle 2}": "45 ± 2", "x_{t}": None, r"\frac{1}{2}": None, "13/20": None,
        r"3\times 10^{-4}": "3e-4", "10^{-3}": "1e-3", r"1.5\cdot10^{6}": "1.5e6", r"\mathcal{L}_{2}": None, "2^{10}": None, r"-\mathbf{1.5}": "-1.5", r"\mathbf{-1.5}": "-1.5", r"\pm 3": None, "": None,
    }
    d = spark.createDataFrame([(k,) for k in want], "alt string").select("alt", N.math_number(F.col("alt")).alias("n"))
    assert {r.alt: r.n for r in d.collect()} == want
    cells = {"3e-4": 3e-4, "87.2 ₁": 87.2, "−1.5": -1.5, "1,234": 1234.0, "13/20": None, "ResNet50": None, "71.0 ± 0.8": 71.0, "12M": None, ".5": 0.5, "n/a": None, "v2.1 3": 3.0, None: None, "1e999": None}
    d = spark.createDataFrame([(k,) for k in cells], "t string").select("t", cell_number(F.col("t")).alias("n"))
    assert {r.t: r.n for r in d.collect()} == cells


def test_values_near_metrics(spark):
    want = {
        "We reach an accuracy of 71.5% here.": True, "Accuracy is good. See Section 4.2 for it.": False, "See §4.4 accuracy": False, "10.5% of the training samples keep accuracy": False, "Our F1 was 0.93": True,
        "accuracy" + " x" * 30 + " 71.5%": False, "In 2024 accuracy on 100 tasks": False, "71.5% accuracy": True, "accuracy of 10.5% of the data and 71.5%": True, "ap 71.5": False, "AP 71.5": True, "": False, None: False,
    }
    d = spark.createDataFrame([(k,) for k in want], "s string").select("s", N.scored_value(F.col("s")).alias("n"))
    assert {r.s: r.n for r in d.collect()} == want


def test_header_bands(spark):
    html = {
        1: "<table><tr><td>Method<td>SR<tr><td>A<td>1.0<tr><td>B<td>2.0</table>",  # no th at all
        2: "<table><thead><tr><td>Year<td>2024</thead><tbody><tr><th scope=row>A<td>1.0</tbody></table>",
        3: "<table><tr><th>M<th>X<th>Y<tr><td colspan=3>Group one<tr><td>A<td>1.0<td>2.0</table>",
        4: "<table><tr><th>M<th>X<th>Y<tr><td>Big<td colspan=2>Single agent<tr><td><td>1.0<td>2.0</table>",
        5: "<table><tr><th>M<th>X<th>Y<tr><td><td colspan=2>Accuracy (%)<tr><td>A<td>1.0<td>2.0</table>",
        6: "<table><tr><td>M<td><math alttext='\\mathbf{1}'><mn>1</mn></math><td>N<tr><td>A<td><math alttext='\\mathbf{7.5}'></math><td>3.0</table>",
        7: "<table><tr><td>a<td><table><tr><td>9</table><td>1.5</table>",
        8: "<table><tr><td rowspan=2 colspan=2>a<td>b<tr><td>c<td>d</table>",
    }
    pages = spark.createDataFrame(list(html.items()) + [(9, None), (10, "")], "page_id long, html string")
    rows = tables.bands(readers.table_rows(pages)).collect()
    heads = {k: sum(r.is_header for r in rows if r.page_id == k and r.table_id == 0) for k in html}
    assert heads == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 1, 7: 0, 8: 2}
    assert {(r.page_id, r.row) for r in rows if r.is_group} == {(4, 1), (5, 1)}
    assert {tuple(r.cells) for r in rows if r.page_id == 6} == {("M", "1", "N"), ("A", "7.5", "3.0")} and {r.table_id for r in rows if r.page_id == 7} == {1}
    assert [r.cells for r in rows if r.page_id == 8 and r.row == 1] == [["a", "a", "c", "d"]]


def test_blocks(spark):
    g = [["Method", "SR", "DS"], ["Base", "1", "2"], ["Gemini-3-Flash", "Gemini-3-Flash", "Gemini-3-Flash"], ["A", "3", "4"], ["Failed", "-", "–"], ["B", "5", "6"], ["Qwen- 4B", "Single", "Single"], ["", "7", "8"], ["", "Parallel", "Parallel"], ["", "9", "9"]]
    rows = {r.row: (r.is_block, r.block) for r in tables.row_blocks(grid(spark, ("", 1, g), groups=(6, 8))).collect()}
    assert [rows[k] for k in range(1, 10)] == [
        (False, None), (True, "Gemini-3-Flash"), (False, "Gemini-3-Flash"), (True, "Failed"), (False, "Failed"), (True, "Qwen-4B · Single"), (False, "Qwen-4B · Single"), (True, "Qwen-4B · Parallel"), (False, "Qwen-4B · Parallel"),
    ]


def test_labels_keep_marks_only_where_they_tell_rows_apart(spark):
    g = [["M", "a", "b", "SR"], ["Ours", "✓", "✗", "1"], ["Ours", "✓", "✓", "2"], ["SFT", "✗", "✓", "3"], ["Net", "Net", "", "4"]]
    body = tables.row_blocks(grid(spark, ("", 1, g)))
    assert [r.label for r in tables.row_labels(body).orderBy("row").collect()] == ["Ours ✓ ✗", "Ours ✓ ✓", "SFT", "Net"]


GAINS = {"48.0 (+6.0)": 6.0, "48.0 (+6.0%)": 6.0, "48.0(+6.0)": 6.0, "48.0 +6.0": 6.0, "36.0 (−6.0)": -6.0, "36.0 (-6.0%)": -6.0, "48.04 (+6.0)": 6.0}
NO_GAINS = ("48.0 (6.0)", "48.0 (+5.0)", "48.0 (+6.0", "48.0 +6.0)", "48.0 (±6.0)", "48.0 (+6.0) extra", "48.06 (+6.0)")


def test_gains(spark):
    blocks = (
        [["Base-A", "42.0"], ["Base-B", "42.0"], ["Ours", "48.0 (+6.0)"]], [["Base-A", "42.0"], ["Group-X", "Group-X"], ["Ours", "48.0 (+6.0)"]], [["Base-A", "42.0"], ["Base-B", "40.0"], ["+Ours", "48.0 (+6.0)"]],
        [["Base-A", "42.0"], ["Base-B", "42.0"], ["+Ours", "48.0 (+6.0)"]],
    )
    r = each(spark, *[simple(v) for v in (*GAINS, *NO_GAINS)], *[simple(rows=x) for x in blocks])
    got = {x.page_id: (x.gain, x.base_model) for x in tables.verified_gains(r).collect()}
    last = len(GAINS) + len(NO_GAINS) + 3
    assert got == {k: (g, "Base-A") for k, g in enumerate(GAINS.values())} | {last: (6.0, "Base-B")} and own(r)[last].model == "Base-B + Ours"


def test_units_and_repeats(spark):
    units = (
        ("success rate (%)", "48.0", "Bench-Z results.", "%"), ("success rate", "48.0%", "Bench-Z results.", "%"), ("success rate", "48.0 (+6.0%)", "Bench-Z results.", "%"),
        ("success rate", "48.0", "Bench-Z: average success rate (%), accuracy.", "%"), ("SR", "48.0", "Bench-Z: success rate (%).", "%"), ("accuracy", "48.0", "Bench-Z: success rate (%), accuracy.", None),
        ("success rate", "48.0", "Bench-Z: success rate and accuracy (%).", None), ("success rate", "48.0", "Bench-Z results.", None),
    )
    repeats = (("averaged over 7 random seeds", 7), ("AVERAGED OVER 11 trials", 11), ("averaged over 0 runs", None), ("averaged over tasks", None), ("averaged over 3 runs, averaged over tasks", None))
    r = own(each(spark, *[simple(v, h, c) for h, v, c, _ in units], *[simple(caption=f"Bench-Z, {p}.") for p, _ in repeats]))
    assert [r[k].unit for k in range(len(units))] == [u for *_, u in units] and [r[len(units) + k].averaged_over for k in range(len(repeats))] == [n for _, n in repeats]


def test_header_paths_give_metric_and_benchmark(spark):
    t = ("Average score and success rate (%).", 2, [["Method", "Bench-Z", "Bench-Z", "Bench-Z (%)"], ["Method", "average score", "success rate", "accuracy"], ["Ours", "52.0", "48.0", "44.0"]])
    got = {r.locator: (r.benchmark, r.metric, r.metric_key, r.direction, r.unit) for r in results(spark, t).collect()}
    assert got == {"t0.r2.c2": ("Bench-Z", "success rate", "sr", "higher", "%"), "t0.r2.c3": ("Bench-Z", "Bench-Z (%) / accuracy", "benchzacc", "higher", "%")}


def test_averages_replace_categories(spark):
    wide = ("Bench-Z", 2, [["M", *["SR"] * 10], ["M", *[f"cat{k}" for k in range(10)]], ["Ours", *["1.5"] * 10]])
    mean = ("Bench-Z", 2, [["M", *["SR"] * 4], ["M", "Fold-0", "Fold-1", "Fold-2", "Mean"], ["Ours", "1", "2", "3", "2"]])
    few = ("Bench-Z", 2, [["M", "SR", "SR"], ["M", "1-shot", "5-shot"], ["Ours", "1", "2"]])
    twice = ("Bench-Z", 1, [["M", "SR", "SR", "DS"], ["Ours", "1", "2", "3"]])
    assert {(r.table_id, r.metric, r.value) for r in results(spark, wide, mean, few, twice).collect()} == {(1, "SR / Mean", 2.0), (2, "SR / 1-shot", 1.0), (2, "SR / 5-shot", 2.0), (3, "DS", 3.0)}


def test_benchmarks_that_are_not_one(spark):
    both = {"benchmarks": ("Alpha-Set", "Beta-Set")}
    a = ("Results", 2, [["M", "Alpha-Set", "Beta-Set"], ["M", "SR", "SR"], ["Ours", "1", "2"], ["Ours on Beta-Set", "3", "4"]])
    cap = ("Alpha-Set and Beta-Set", 1, [["M", "SR"], ["Ours", "5"]])
    cited = ("Alpha-Set", 1, [["M", "SR"], ["Beta-Set (Lee et al., 2026)", "69.1"], ["Ours", "70"]])
    got = {(r.table_id, r.model, r.benchmark, r.value) for r in results(spark, a, cap, cited, **both).collect()}
    assert got == {(0, "Ours", "Alpha-Set", 1.0), (0, "Ours", "Beta-Set", 2.0), (0, "Ours on", "Beta-Set", 4.0), (2, "Beta-Set (Lee et al., 2026)", "Alpha-Set", 69.1), (2, "Ours", "Alpha-Set", 70.0)}


def test_rows_that_are_no_methods(spark):
    rows = [["Improvement", "2.0"], ["Δ (%)", "1"], ["Δ (Ours)", "3"], ["✓", "4"], ["GAIN", "5"]]
    assert {(r.page_id, r.model) for r in each(spark, simple(rows=rows), simple(caption="Ablation on Bench-Z")).collect()} == {(0, "Δ (Ours)"), (0, "GAIN")}


def test_transposed_tables(spark):
    t = ("Success rate on the Bench-Z benchmark", 1, [["", "Rival", "Ours"], ["Task 1", "10", "20"], ["Task 2", "30", "40"], ["Average", "20", "30"]])
    odd = ("Success rate on the Bench-Z benchmark", 1, [["", "Rival", "Ours"], ["Kitchen", "10", "20"]])
    got = {(r.model, r.metric, r.value, r.own, r.orientation) for r in results(spark, t, odd).collect()}
    assert got == {(m, f"Success rate / {task}", v, m == "Ours", "transposed") for task, a, b in (("Task 1", 10.0, 20.0), ("Task 2", 30.0, 40.0), ("Average", 20.0, 30.0)) for m, v in (("Rival", a), ("Ours", b))}


def test_metrics_that_only_the_text_tells(spark):
    t = ("Bench-Z main results", 2, [["Method", "Overall Metrics (%)", "Overall Metrics (%)", "Time (s)"], ["Method", "All (75)", "Lite (22)", "Time (s)"], ["Rival", "70.1", "80.0", "78.2"], ["Novel", "78.2", "81.0", "5.0"]])
    said = (
        "Across 75 tasks in Bench-Z, Novel reaches a medal rate of 78.2%.", "Across 22 tasks in Bench-Z, Novel reaches a medal rate of 78.2%.", "Novel outperforms Rival, which has an accuracy of 78.2% on Bench-Z in 75 tasks.",
        "On 75 tasks of Bench-Z Novel reaches a medal rate of 99.9%.",
    )
    lent = ("Average SR on Bench-Z", 1, [["Method", "Bench-Z", "Avg."], ["Novel", "1.5", "2.5"]])
    got = {(r.page_id, r.model, r.metric, r.value, r.told) for r in each(spark, *[t] * 4, lent, sents=said).collect()}
    name = "medal rate / Overall Metrics (%) / All (75)"
    assert got == {(0, "Rival", name, 70.1, True), (0, "Novel", name, 78.2, True), (4, "Novel", "SR", 1.5, False)}


def test_results_of_nothing(spark):
    assert not tables.table_results(grid(spark, ("", 0, [])), papers(spark)).count()
    d = readers.table_rows(spark.createDataFrame([(1, None)], "page_id long, html string"))
    assert not tables.table_results(tables.bands(d), papers(spark), text.sentences(spark.createDataFrame([(1, None)], "page_id long, text string"), "page_id")).count()
