"""Registered queries over tables that Spark lays out from the star schema, beside SQL that never sees the HTML."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwell.functions import numbers as N
from driftwell.operators import analysis, tables
from driftwell.operators.graph import cut
from driftwell.plans.queries import query, table
from driftwell.sources import readers

_LINES = """l AS (SELECT l_partkey AS page_id, l_suppkey % 10 = 0 AS own, 'Net ' || l_suppkey || CASE WHEN l_suppkey % 10 = 0 THEN ' (Ours)' ELSE '' END AS model, l_returnflag AS flag, l_linenumber AS n,
  l_quantity::DOUBLE AS sr, round(l_discount * 100, 1)::DOUBLE AS ds, row_number() OVER w - 1 AS i, dense_rank() OVER (PARTITION BY l_partkey ORDER BY l_returnflag) AS b FROM lineitem WINDOW w AS (PARTITION BY l_partkey ORDER BY l_returnflag, l_orderkey, l_linenumber, l_suppkey)),
k AS (SELECT *, page_id % 5 = 0 AS turned, 2 + i + b AS row_no, 1 + min(i) OVER (PARTITION BY page_id, flag) + b AS head, bool_or(own) OVER (PARTITION BY page_id) AS any_own FROM l WHERE page_id % 11 > 0)"""


def _pages(spark, sf_dir):
    """A page a part: its orders as rows under the header band of one benchmark, in blocks by flag, or turned by 90 degrees."""
    cell = lambda v: F.format_string("%.1f", v)
    sr = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("<math alttext='\\mathbf{"), cell(F.col("l_quantity").cast("double")), F.lit("}\\pm 0.5'><mn>1</mn></math>"))).otherwise(cell(F.col("l_quantity").cast("double")))
    model = F.concat(F.lit("Net "), F.col("l_suppkey").cast("string"), F.when(F.col("l_suppkey") % 10 == 0, " (Ours)").otherwise(""))
    line = F.struct("l_returnflag", "l_orderkey", "l_linenumber", "l_suppkey", model.alias("model"), sr.alias("sr"), cell(F.round(F.col("l_discount").cast("double") * 100, 1)).alias("ds"))
    parts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("page_id")).agg(F.array_sort(F.collect_list(line)).alias("x"))
    x = F.col("x")
    banner = lambda r, i: F.when((i == 0) | (F.get(x, i - 1)["l_returnflag"] != r["l_returnflag"]), F.concat(F.lit("<tr><td colspan=3>Flag "), r["l_returnflag"], r["l_returnflag"])).otherwise("")
    body = F.array_join(F.transform(x, lambda r, i: F.concat(banner(r, i), F.lit("<tr><td>"), r["model"], F.lit("<td>"), r["sr"], F.lit("<td>"), r["ds"])), "")
    head = F.when(F.col("page_id") % 3 == 1, "<tr><td rowspan=2>Method<td colspan=2>Bench-A<tr><td>SR (%)<td>DS").otherwise("<thead><tr><th rowspan=2>Method<th colspan=2>Bench-A<tr><th>SR (%)<th>DS</thead><tbody>")
    runs = F.concat(F.lit("<table><caption>Results averaged over "), (F.col("page_id") % 7).cast("string"), F.lit(" runs</caption>"))
    lane = lambda name, c: F.concat(F.lit(f"<tr><th scope=row>{name}"), F.array_join(F.transform(x, lambda r: F.concat(F.lit("<td>"), r[c])), ""))
    turned = F.concat(F.lit("<table><caption>Success rate on the Bench-A benchmark</caption><tr><th>"), F.array_join(F.transform(x, lambda r: F.concat(F.lit("<th>"), r["model"])), ""), lane("Task 1", "sr"), lane("Task 2", "ds"), F.lit("</table>"))
    html = F.when(F.col("page_id") % 5 == 0, turned).otherwise(F.concat(runs, head, body, F.lit("</table>")))
    return parts.select("page_id", F.when(F.col("page_id") % 11 > 0, html).alias("html"))


def _papers(pages):
    named = F.when(F.col("page_id") % 13 > 0, F.array(F.lit("Bench-A"))).otherwise(F.array().cast("array<string>"))
    return pages.select("page_id", F.lit(None).cast("string").alias("method"), named.alias("benchmarks"), F.col("html").isNotNull().alias("has_html"))


@query(f"""WITH {_LINES}, s AS (SELECT * FROM k WHERE NOT turned),
c AS (SELECT page_id, row_no AS row, unnest([0, 1, 2]) AS col, unnest([model, printf('%.1f', sr) || CASE WHEN n = 1 THEN ' ± 0.5' ELSE '' END, printf('%.1f', ds)]) AS text, unnest([NULL, sr, ds]) AS value FROM s
  UNION ALL SELECT DISTINCT page_id, head, unnest([0, 1, 2]), 'Flag ' || flag || flag, NULL FROM s
  UNION ALL SELECT DISTINCT page_id, unnest([0, 0, 0, 1, 1, 1]), unnest([0, 1, 2, 0, 1, 2]), unnest(['Method', 'Bench-A', 'Bench-A', 'Method', 'SR (%)', 'DS']), NULL FROM s
  UNION ALL SELECT page_id, unnest([0, 1, 2]), i + 1, unnest([model, printf('%.1f', sr) || CASE WHEN n = 1 THEN ' ± 0.5' ELSE '' END, printf('%.1f', ds)]), unnest([NULL, sr, ds]) FROM k WHERE turned
  UNION ALL SELECT DISTINCT page_id, unnest([0, 1, 2]), 0, unnest(['', 'Task 1', 'Task 2']), NULL FROM k WHERE turned)
SELECT page_id, row::INT AS row, col::INT AS col, text, row < CASE WHEN page_id % 5 = 0 THEN 1 ELSE 2 END AS is_header, CASE WHEN text LIKE 'Net %' THEN NULL WHEN text LIKE 'Task %' THEN substr(text, 6)::DOUBLE ELSE value END AS value, CASE WHEN text LIKE 'Net %' THEN 1 ELSE 0 END AS named FROM c""")
def html_cells(spark, sf_dir):
    """Cells of all tables; a name's own number (``Net 7``) counts as its number, so names are told apart in the result."""
    c = readers.html_cells(_pages(spark, sf_dir)).withColumn("named", F.col("text").startswith("Net ").cast("int"))
    return c.select("page_id", "row", "col", "text", "is_header", F.when(F.col("named") == 0, F.col("value")).alias("value"), "named")


_RESULTS = f"""{_LINES}, res AS (
  SELECT page_id, 't0.r' || row_no || '.c1' AS locator, row_no, 1 AS col, 'sr' AS metric_key, sr AS value, model, own, 'Flag ' || flag || flag AS block, '%' AS unit, nullif(page_id % 7, 0)::INT AS averaged_over, 'rows' AS orientation FROM k WHERE NOT turned
  UNION ALL SELECT page_id, 't0.r' || row_no || '.c2', row_no, 2, 'ds', ds, model, own, 'Flag ' || flag || flag, NULL, nullif(page_id % 7, 0)::INT, 'rows' FROM k WHERE NOT turned
  UNION ALL SELECT page_id, 't0.r1.c' || (i + 1), 1, i + 1, 'srtask1', sr, model, own, NULL, NULL, NULL, 'transposed' FROM k WHERE turned AND any_own
  UNION ALL SELECT page_id, 't0.r2.c' || (i + 1), 2, i + 1, 'srtask2', ds, model, own, NULL, NULL, NULL, 'transposed' FROM k WHERE turned AND any_own),
r AS (SELECT * FROM res WHERE page_id % 13 > 0)"""


@query(f"WITH {_RESULTS} SELECT page_id, locator, metric_key, 'higher' AS direction, value, model, own, block, unit, averaged_over, orientation FROM r")
def table_results(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    r = tables.table_results(cut(tables.bands(readers.table_rows(pages))), _papers(pages))
    return r.select("page_id", "locator", "metric_key", "direction", "value", "model", "own", "block", "unit", "averaged_over", "orientation")


@query(f"""WITH {_RESULTS}, o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN orientation = 'rows' THEN col ELSE 0 END, CASE WHEN orientation = 'rows' THEN row_no ELSE col END, row_no) AS place FROM r WHERE own),
f AS (SELECT * FROM o WHERE place = 1),
m AS (SELECT r.page_id, r.metric_key, r.block, arg_max({{'locator': r.locator, 'model': r.model, 'value': r.value}}, (r.value, -r.row_no, -r.col)) AS best FROM r JOIN f ON r.page_id = f.page_id AND r.metric_key = f.metric_key AND r.block IS NOT DISTINCT FROM f.block WHERE r.own GROUP BY ALL),
p AS (SELECT m.page_id, count(*) AS n_peers, arg_max({{'model': r.model, 'value': r.value}}, (r.value, -r.row_no, r.model)) AS top, max(r.value) AS best_peer FROM m JOIN r ON r.page_id = m.page_id AND r.metric_key = m.metric_key AND r.block IS NOT DISTINCT FROM m.block WHERE NOT r.own GROUP BY m.page_id),
a AS (SELECT DISTINCT l_partkey AS page_id FROM lineitem), w AS (SELECT DISTINCT page_id FROM res), ow AS (SELECT DISTINCT page_id FROM r WHERE own)
SELECT a.page_id, m.best.locator AS locator, m.best.model AS model, m.best.value AS value, CASE WHEN m.page_id IS NOT NULL THEN coalesce(n_peers, 0) END AS n_peers, best_peer,
  CASE WHEN m.page_id IS NULL THEN NULL WHEN o.value IS NULL THEN 'first' WHEN m.best.value > o.value THEN 'above' WHEN m.best.value = o.value THEN 'equal' ELSE 'below' END AS standing,
  CASE WHEN a.page_id % 13 = 0 THEN 'no_benchmark' WHEN a.page_id % 11 = 0 THEN 'no_html' WHEN a.page_id NOT IN (SELECT page_id FROM w) THEN 'no_results' WHEN a.page_id NOT IN (SELECT page_id FROM ow) THEN 'no_own_row' END AS reason
FROM a LEFT JOIN m USING (page_id) LEFT JOIN p USING (page_id)
  LEFT JOIN LATERAL (SELECT max(x.best.value) AS value FROM m x WHERE x.metric_key = m.metric_key AND x.page_id <> m.page_id) o ON true""")
def document_analysis(spark, sf_dir):
    pages = cut(_pages(spark, sf_dir))  # parsed once, and asked for by papers more than once
    papers, rows = _papers(pages), cut(tables.bands(readers.table_rows(pages)))
    a = analysis.analyse(papers, rows, tables.table_results(rows, papers))
    return a.select("page_id", "locator", "model", "value", "n_peers", "best_peer", "standing", "reason")


@query(r"""WITH d AS (SELECT l_orderkey AS k, l_linenumber AS n, l_linenumber % 7 AS form, l_quantity::INT AS q, round(l_discount * 100)::INT AS e FROM lineitem)
SELECT k, n, CASE form WHEN 0 THEN q || '.5' WHEN 1 THEN q || '.5 ± 0.' || e WHEN 2 THEN q || 'e-' || e WHEN 3 THEN q || ' ' || translate(e::VARCHAR, '0123456789', '₀₁₂₃₄₅₆₇₈₉') WHEN 4 THEN q || ' ± ' || e WHEN 5 THEN q || '.5%' END AS number,
CASE form WHEN 0 THEN q + 0.5 WHEN 1 THEN q + 0.5 WHEN 2 THEN (q || 'e-' || e)::DOUBLE WHEN 3 THEN q WHEN 4 THEN q WHEN 5 THEN q + 0.5 END::DOUBLE AS value FROM d""")
def formula_numbers(spark, sf_dir):
    """Quantities and discounts as formulas: bold, with errors, powers of ten, subscripts, percentages; fractions are no numbers."""
    q, e = F.col("l_quantity").cast("int").cast("string"), F.round(F.col("l_discount").cast("double") * 100).cast("int").cast("string")
    say = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    forms = [
        say("\\mathbf{", q, ".5}"), say("\\bm{", q, ".5}{\\scriptstyle\\,\\bm{\\pm}\\,\\mathbf{0.", e, "}}"), say(q, "\\times 10^{-", e, "}"), say(q, "_{", e, "}"),
        say("\\mathbf{", q, "}_{{\\color[rgb]{0.45,0.45,0.45}\\scriptscriptstyle ", e, "}}"), say("\\underline{", q, ".5}\\%"), say("\\frac{", q, "}{", e, "}"),
    ]
    n = N.math_number(F.get(F.array(*forms), F.col("l_linenumber") % 7))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), n.alias("number"), N.cell_number(n).alias("value"))


@query("""SELECT l_orderkey AS k, l_linenumber AS n, (l_linenumber % 4 IN (0, 1) AND (l_quantity::INT * 2 + 1 <= 40)) OR (l_linenumber % 4 = 2 AND l_returnflag <> 'R' AND l_quantity::INT * 2 + 1 <= 40) AS scored FROM lineitem""")
def scored_sentences(spark, sf_dir):
    """A metric and a value at a distance of the quantity: before, behind, a share of data for some, and section numbers."""
    gap = F.concat(F.lit(" "), F.repeat(F.lit("x "), F.col("l_quantity").cast("int")))
    share = F.when(F.col("l_returnflag") == "R", " of the training samples").otherwise(" overall")
    forms = [F.concat(F.lit("accuracy"), gap, F.lit("71.5%")), F.concat(F.lit("71.5%"), gap, F.lit("F1")), F.concat(F.lit("SR"), gap, F.lit("12.5%"), share), F.concat(F.lit("accuracy is told in Section 4.2"), gap)]
    form = F.col("l_linenumber") % 4
    s = F.when(form == 0, forms[0]).when(form == 1, forms[1]).when(form == 2, forms[2]).when(form == 3, forms[3])  # only the one asked for is made
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), s.alias("s"))
    return d.select("k", "n", N.scored_value(F.col("s")).alias("scored"))
