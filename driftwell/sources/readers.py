"""Sources: landed feeds, logs, markdown and HTML tables as DataFrames with explicit schemas."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwell.functions.keys import cell_number, clean_id, collapse
from driftwell.functions.numbers import END_MATH, MATH, math_text
from driftwell.operators.graph import cut, running_sums
from driftwell.operators.tables import bands


def atom_feed(spark: SparkSession, path: str) -> DataFrame:
    """Atom entries: id, title, abstract, published, authors, categories."""
    kind = "id string, title string, summary string, published string, author array<struct<name:string>>, category array<struct<_term:string>>"
    e = spark.read.format("xml").option("rowTag", "entry").schema(kind).load(path)
    return e.select(clean_id(F.col("id")).alias("ident"), collapse(F.col("title")).alias("title"), collapse(F.col("summary")).alias("abstract"), "published", F.col("author.name").alias("authors"), F.col("category._term").alias("categories"))


def json_results(spark: SparkSession, path: str) -> DataFrame:
    """Nested search results as records: rows without a title go, a missing date stays null."""
    kind = "data array<struct<paperId:string,title:string,abstract:string,publicationDate:string,year:int,venue:string,citationCount:bigint,externalIds:struct<ArXiv:string,DOI:string>,openAccessPdf:struct<url:string>>>"
    r = spark.read.schema(kind).option("multiLine", True).json(path).select(F.explode("data").alias("r")).select("r.*").where("trim(title) <> ''")
    return r.select(
        F.col("externalIds.ArXiv").alias("ident"), F.col("externalIds.DOI").alias("doi"), "title", "abstract", F.coalesce("publicationDate", F.col("year").cast("string")).alias("published"),
        "venue", F.col("citationCount").alias("citation_count"), F.col("openAccessPdf.url").alias("pdf"),
    )


def islands(lines: DataFrame, group: str, order: list[str], start: Column) -> DataFrame:
    """Adds ``block``, the number of start lines of the line's group up to it (0 before the first).

    Starts are counted over ranges of the order of all lines (``running_sums``), so one very long log is many tasks.
    """
    by = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    counted = running_sums(lines.withColumn("_start", F.coalesce(start, F.lit(False)).cast("int")), by, {"_before": F.col("_start")})
    counted = cut(counted.withColumn("_count", F.col("_before") + F.col("_start")))
    base = counted.groupBy(F.col(group).alias("_g")).agg(F.min("_before").alias("_base"))  # a row a log
    return counted.join(base, F.col(group).eqNullSafe(F.col("_g"))).withColumn("block", (F.col("_count") - F.col("_base")).cast("int")).drop("_g", "_base", "_before", "_count", "_start")


def run_blocks(lines: DataFrame, group: str, order: list[str], start: Column, end: Column, line: str = "value", warning: str = "(?i)warn", skipped: Column | None = None) -> DataFrame:
    """Runs of a log: a start line opens one, the next end line closes it, lines outside belong to none.

    Per run: first and last line's ``order`` values (``ended`` null while it is open), lines, warnings, calls and exit code.
    ``skipped`` lines tell of runs that never began; they neither open nor close one and come as runs of their own, with
    block null.
    """
    skip = F.lit(False) if skipped is None else F.coalesce(skipped, F.lit(False))
    at = F.struct(*[F.col(c) for c in order])
    marked = lines.withColumn("_skip", skip).withColumn("_end", F.coalesce(end, F.lit(False)) & ~F.col("_skip"))
    b = cut(islands(marked, group, order, F.coalesce(start, F.lit(False)) & ~F.col("_skip")).withColumn("_at", at))
    closed = b.where("_end and block > 0").groupBy(F.col(group).alias("_g"), F.col("block").alias("_b")).agg(F.min("_at").alias("ended"))
    inside = b.where("block > 0 and not _skip").join(closed, F.col(group).eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b")), "left").where(F.col("ended").isNull() | (F.col("_at") <= F.col("ended")))
    runs = inside.groupBy(group, "block").agg(
        F.min("_at").alias("started"), F.max("ended").alias("ended"), F.count("*").alias("n_lines"), F.count_if(F.col(line).rlike(warning)).alias("warnings"),
        F.max_by(F.regexp_extract(line, r"calls=(\d+)", 1).try_cast("int"), F.when(F.col(line).rlike(r"calls=\d"), F.col("_at"))).alias("calls"), F.max(F.when(F.col("_end"), F.regexp_extract(line, r"exit[ =](-?\d+)", 1).try_cast("int"))).alias("exit_code"),
    )
    missed = b.where("_skip").select(group, F.lit(None).cast("int").alias("block"), F.col("_at").alias("started"), F.col("_at").alias("ended"), F.lit(1).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("warnings"), F.lit(None).cast("int").alias("calls"), F.lit(None).cast("int").alias("exit_code"))
    return runs.unionByName(missed)


def markdown_cells(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, table_id, caption, row, col, text): pipe tables; the last heading is the caption, short rows are padded.

    All of it is found inside a document's row, so no line is sorted or moved.
    """
    kind = lambda x: F.when(F.trim(x).rlike(r"^\|.*\|$"), F.when(F.trim(x).rlike(r"^\|[\s:|-]+\|$"), "rule").otherwise("row")).when(x.rlike("^#+ "), "head").otherwise("")
    l = docs.select(id_col, F.split(text_col, "\n").alias("lines")).withColumn("kinds", F.transform("lines", kind))
    is_row = lambda k: k.isin("row", "rule")
    mark = lambda k, i: F.when((k == "head") | is_row(k) & ~F.coalesce(is_row(F.get("kinds", i - 1)), F.lit(False)), i)
    l = l.withColumn("marks", F.filter(F.transform("kinds", mark), lambda i: i.isNotNull()))  # headings and the first lines of tables
    first = F.struct(F.lit(None).cast("string").alias("caption"), F.array().cast("array<struct<at:int,caption:string>>").alias("tables"))

    def step(s: Column, i: Column) -> Column:
        table = F.array(F.struct(i.alias("at"), s["caption"].alias("caption")))
        headed = F.struct(F.regexp_replace(F.get("lines", i), "^#+ ", "").alias("caption"), s["tables"].alias("tables"))
        return F.when(F.get("kinds", i) == "head", headed).otherwise(F.struct(s["caption"].alias("caption"), F.concat(s["tables"], table).alias("tables")))

    def cells(t: Column, j: Column) -> Column:
        upto = F.coalesce(F.get("tables", j + 1)["at"], F.size("lines"))
        rows = F.filter(F.slice("lines", t["at"] + 1, upto - t["at"]), lambda _, i: F.get("kinds", t["at"] + i) == "row")
        return F.struct(t["caption"].alias("caption"), F.transform(rows, lambda x: F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|")).alias("rows"))

    l = l.withColumn("tables", F.aggregate("marks", first, step, lambda s: s["tables"]))
    r = l.select(id_col, F.posexplode(F.transform("tables", cells)).alias("at", "t")).withColumn("width", F.array_max(F.transform("t.rows", F.size)))
    r = r.select(id_col, (F.col("at") + 1).cast("long").alias("table_id"), "t.caption", "width", F.posexplode("t.rows").alias("row", "cells"))
    r = r.select(id_col, "table_id", "caption", "row", F.posexplode(F.transform(F.sequence(F.lit(1), "width"), lambda i: F.trim(F.coalesce(F.get("cells", i - 1), F.lit(""))))).alias("col", "text"))
    return r.withColumn("value", cell_number(F.col("text")))


#: What stands inside a tag as most are written, attributes as one text: HTMLParser reads it alike. White space is that of HTML.
TAG = re.compile(r"""/([a-zA-Z][a-zA-Z0-9]*)|([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z][a-zA-Z-]*(?:=(?:"[^"<>&]*"|'[^'<>&]*'|[^ \t\n\r\f"'=<>`&/]+))?)*)[ \t\n\r\f]*""")
ATTRIBUTE = re.compile(r"""([a-zA-Z][a-zA-Z-]*)(?:=("[^"]*"|'[^']*'|[^ \t\n\r\f"'=<>`&/]+))?""")
#: Elements whose content is no markup.
TEXT_ONLY = frozenset("script style xmp iframe noembed noframes noscript textarea title plaintext".split())


class _Tables(HTMLParser):
    """Tables of a page: rows of cells with their spans, and captions. A table that can't be read as a grid is marked broken."""

    def __init__(self) -> None:
        super().__init__()
        self.tables: list[dict] = []
        self.open: list[dict] = []
        self.into: list | None = None
        self.formula = False

    def read(self, page: str) -> None:
        """The whole page: cut at once at its tags as long as they are written as most are, the rest by HTMLParser."""
        first, *pieces = page.split("<")
        at, row = len(first), None  # the cells of the row that is open, None if a tag has to look for it
        for piece in pieces:
            tag, end, said = piece.partition(">")
            if "&" in said:
                said = unescape(said)
            if row is not None and end and (tag == "td" or tag == "th"):  # most cells
                self.into = [said, 1, 1, tag == "th"]
                row.append(self.into)
            else:
                m = TAG.fullmatch(tag) if end else None
                name = m and (m[1] or m[2]).lower()
                if not m or name in TEXT_ONLY:
                    self.feed(page[at:])
                    break
                if m[1]:
                    self.handle_endtag(name)
                else:
                    self.handle_starttag(name, [(k.lower(), v[1:-1] if v[:1] in "\"'" else v) if v else (k.lower(), None) for k, v in ATTRIBUTE.findall(m[3])] if m[3] else ())
                if said:
                    self.handle_data(said)
                row = self.open[-1]["rows"][-1][2] if self.open and self.open[-1]["rows"] and not self.formula else None
            at += len(piece) + 1
        self.close()

    def updatepos(self, i, j):
        """Lines are not counted: nothing asks where a tag stands."""
        return j

    def handle_starttag(self, tag, attrs):
        if self.formula:
            return
        t = self.open[-1] if self.open else None
        a = dict(attrs)
        if tag == "table":
            if t:
                t["broken"] |= self.into is not None and self.into is not t["caption"]  # numbers of an inner table belong to no cell
            t = {"rows": [], "caption": ["", 1, 1, False], "part": ("", 0), "broken": False, "spread": set()}
            self.tables.append(t)
            self.open.append(t)
            self.into = None
        elif t is None:
            return
        elif tag in ("thead", "tbody", "tfoot"):
            t["part"] = (tag, t["part"][1] + 1)
        elif tag == "tr":
            t["rows"].append((*t["part"], []))
        elif tag in ("td", "th"):
            if not t["rows"]:
                t["rows"].append((*t["part"], []))
            kinds = (a.get("class") or "").split()
            column = a.get("scope") in ("col", "colgroup") or "ltx_th_column" in kinds
            heading = column or tag == "th" and a.get("scope") != "row" and "ltx_th_row" not in kinds
            spans = [(a.get(k) or "1").strip() for k in ("rowspan", "colspan")]
            t["broken"] |= not all(x.isascii() and x.isdigit() and len(x) < 5 for x in spans) or spans[1] == "0"
            self.into = ["", *(int(x) if x.isascii() and x.isdigit() else 1 for x in spans), heading]
            t["rows"][-1][2].append(self.into)
            if self.into[1:3] != [1, 1]:
                t["spread"].add(len(t["rows"]) - 1)
        elif tag == "caption":
            self.into = t["caption"]
        elif tag == "math" and self.into is not None and a.get("alttext"):
            self.into[0] += MATH + a["alttext"] + END_MATH
            self.formula = True
        elif tag in ("br", "p", "div") and self.into is not None:
            self.into[0] += " "

    def handle_endtag(self, tag):
        if tag == "math":
            self.formula = False
        if self.formula:
            return
        if tag == "table" and self.open:
            self.open.pop()
        if tag in ("thead", "tbody", "tfoot") and self.open:
            self.open[-1]["part"] = ("", self.open[-1]["part"][1] + 1)
        if tag in ("td", "th", "caption", "tr", "table"):
            self.into = None

    def handle_data(self, data):
        if self.into is not None and not self.formula:
            self.into[0] += data

    def parse_marked_section(self, i, report=1):
        """A marked section, whatever its name, is a comment up to the next >."""
        return self.parse_bogus_comment(i, report)


MAX_GRID = 1_000_000
#: From so many cells on a batch of rows goes out.
BATCH_CELLS = 20_000


def grids(html: str | None) -> list[tuple]:
    """(table, caption, row, cells, own, spans, heading) of a page's tables, with spans written out into every cell they cover.

    ``own`` and ``spans`` are the row's own cells and their widths; ``heading`` rows are the table's head or hold only column
    headings. Tables that spans make larger than MAX_GRID cells, that overlap or that are broken give nothing.
    """
    p, out = _Tables(), []
    p.read(html or "")
    for k, t in enumerate(p.tables):
        if t["broken"] or t in p.open:
            continue
        held: dict[int, dict[int, str]] = {}  # cells of rows that spans reach; the others are their own
        width, rows, broken, last = 0, t["rows"], False, 0
        owns = [[" ".join(x[0].split()) for x in cells] for _, _, cells in rows]
        for r, (_, part, cells) in enumerate(rows):
            c = 0
            if r not in t["spread"] and r not in held:
                c = len(cells)
                width = max(width, c)
            else:
                if last <= r:  # rows of one part lie together
                    last = r + 1
                    while last < len(rows) and rows[last][1] == part:
                        last += 1
                row = held.setdefault(r, {})
                for cell, own in zip(cells, owns[r], strict=True):
                    while c in row:
                        c += 1
                    down = min(cell[1] or last - r, last - r)
                    width = max(width, c + cell[2])
                    if len(rows) * width > MAX_GRID:
                        break
                    for i in range(r, r + down):
                        to = held.setdefault(i, {})
                        for j in range(c, c + cell[2]):
                            broken |= j in to
                            to[j] = own
                    c += cell[2]
            broken |= len(rows) * width > MAX_GRID
            if broken:
                break
        if broken or not width:
            continue
        caption = " ".join(t["caption"][0].split())
        for r, (section, _, cells) in enumerate(rows):
            heading = section == "thead" or bool(cells) and cells[0][3] and all(x[3] for x in cells)
            own = owns[r]
            whole = [held[r].get(c, "") for c in range(width)] if r in held else own if len(own) == width else own + [""] * (width - len(own))
            out.append((k, caption, r, whole, own, [x[2] for x in cells] if r in t["spread"] else [1] * len(own), heading))
    return out


def table_rows(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The rows of the tables of each page, as ``grids`` gives them; ``tables.bands`` tells headers from bodies.

    Pages are dealt out first, by a hash of the id so that Spark doesn't take an earlier dealing by the id, in fewer parts, as
    good enough: parsing costs far more than reading, and a small file of them would be one task.
    """
    fields = [("id", pa.int64()), ("table_id", pa.int32()), ("caption", pa.string()), ("row", pa.int32()), ("cells", pa.list_(pa.string())), ("own", pa.list_(pa.string())), ("spans", pa.list_(pa.int32())), ("heading", pa.bool_())]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])

    def run(batches):
        for b in batches:
            held, n = [], 0
            for i, h in zip(b.column(0), b.column(1), strict=True):  # small pages share a batch, a large one has its own
                rows = [(i.as_py(), *g) for g in grids(h.as_py())]
                held += rows
                n += sum(len(r[4]) for r in rows)
                if n >= BATCH_CELLS:
                    yield batch_of(held)
                    held, n = [], 0
            yield batch_of(held)

    kind = "id long, table_id int, caption string, row int, cells array<string>, own array<string>, spans array<int>, heading boolean"
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.select(F.col(id_col).cast("long"), html_col).repartition(n, F.xxhash64(id_col)).mapInArrow(run, kind)
    return rows.withColumn("caption", math_text(F.col("caption"))).withColumnRenamed("id", id_col)


def html_cells(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Long-form cells of the tables of each page: text, whether they lie in the header band or in a group row, and their number."""
    rows = bands(table_rows(pages, id_col, html_col), id_col)
    cells = rows.select(id_col, "table_id", "caption", "row", F.posexplode("cells").alias("col", "text"), "is_header", "is_group")
    return cells.withColumn("value", cell_number(F.col("text")))


def html_text(html: Column) -> Column:
    """All visible text of a page by regular expressions: scripts, styles, menus and tags out, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer|aside|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for k, v in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        t = F.replace(t, F.lit(k), F.lit(v))
    return collapse(t)
