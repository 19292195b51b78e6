"""Feeds that are asked page by page, newest first, as a stream that remembers what it has not read yet.

A feed's records have a key that sorts by publication, such as ``2024-01-05T10:00:00Z|id``. One run asks for the newest
records above what is known, page after page, until it meets the known ones; it stops after ``max_pages``. What lies
between the last page and the known records is then a hole. The offset of the stream holds the newest key and the holes,
so that a run that ended early (``partial``) neither loses nor repeats anything: the next one reads what is newer, then
goes on with the holes.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: ``fetch(before, after, size)`` gives at most ``size`` records, the newest first, with after < key < before; both may be None.
#: A feed whose pages may be too large to hold also has ``ends(before, after, size)``, the newest and oldest key and the number
#: of the same records (None without any), and ``rows(before, oldest, fields)``, an iterator of records with oldest <= key < before.
Fetch = Callable[[str | None, str | None, int], list[dict]]


class Page(InputPartition):
    def __init__(self, before: str, after: str | None) -> None:
        self.before, self.after = before, after


class PagedReader(DataSourceStreamReader):
    """Offsets are plans: ``pages`` are the bounds of the pages that the run up to this offset delivers."""

    def __init__(self, fetch: Fetch, fields: list[str], since: str | None, page_size: int, max_pages: int) -> None:
        self.fetch, self.fields, self.since, self.page_size, self.max_pages = fetch, fields, since, page_size, max_pages
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return {"run": 0, "head": self.since or "", "holes": "[]", "pages": "[]", "status": "done", "error": ""}

    def latestOffset(self) -> dict:
        start = self.at or self.initialOffset()
        pages, holes, head, error = [], [], start["head"], ""
        todo = [(None, start["head"] or None), *[tuple(h) for h in json.loads(start["holes"])]]
        for before, after in todo:
            full = True
            while full and len(pages) < self.max_pages and not error:
                try:
                    newest, oldest, n = self.ends(before, after) or (None, None, 0)
                except Exception as e:  # later pages may fail: what came before them counts
                    if not pages:
                        raise
                    error = f"page {len(pages) + 1}: {type(e).__name__}"
                    break
                if n:
                    head = max(head, newest)
                    pages.append((newest + "\0", oldest))
                    before = oldest
                full = n >= self.page_size
            if full and (before is not None or after is None and not pages):
                holes.append((before, after))
        if not pages:
            return start
        self.at = {"run": start["run"] + 1, "head": head, "holes": json.dumps(holes), "pages": json.dumps(pages), "status": "partial" if holes else "done", "error": error}
        return self.at

    def ends(self, before: str | None, after: str | None) -> tuple[str, str, int] | None:
        if hasattr(self.fetch, "ends"):
            return self.fetch.ends(before, after, self.page_size)
        keys = [r["key"] for r in self.fetch(before, after, self.page_size)]
        return (keys[0], keys[-1], len(keys)) if keys else None

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if self.at is None:  # after a restart Spark asks for the last planned run first
            self.at = end
        return [] if start == end else [Page(*p) for p in json.loads(end["pages"])]

    def read(self, partition: Page) -> Iterator[tuple]:
        if hasattr(self.fetch, "rows"):
            yield from self.fetch.rows(partition.before, partition.after, self.fields)
            return
        for r in self.fetch(partition.before, None, self.page_size):
            if r["key"] >= partition.after:
                yield tuple(r.get(f) for f in self.fields)

    def commit(self, end: dict) -> None:
        pass


def paged_feed(spark: SparkSession, fetch: Fetch, schema: str, name: str = "paged_feed", since: str | None = None, page_size: int = 50, max_pages: int = 10) -> DataFrame:
    """A stream of the feed's records (``schema`` with a string ``key``); with ``availableNow`` each start is one run.

    ``fetch`` is asked for keys on the driver and for records on the executors, a task a page; a page that fails later than
    the first ends the run as ``partial``, a failing first page fails it.
    """

    class Feed(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return shape

        def streamReader(self, schema) -> PagedReader:
            return PagedReader(fetch, schema.names, since, page_size, max_pages)

    shape = schema
    spark.dataSource.register(Feed)
    return spark.readStream.format(name).load()


def run_status(query) -> dict:
    """status, run, holes and error of a finished run of a paged feed; status is ``done`` where nothing new was found."""
    for progress in reversed(query.recentProgress):
        end = json.loads(progress.json)["sources"][0]["endOffset"]
        if end:
            return end
    return {"status": "done"}


class LandedPages:
    """``fetch`` over Parquet files with a ``key`` column, in any store that Arrow reads; footers prune what is out of range.

    A page is found by its keys alone and read a batch at a time, so no task holds a page.
    """

    BATCH = 20_000

    def __init__(self, path: str) -> None:
        self.path = path

    def _batches(self, before: str | None, keep, columns: list[str]) -> Iterator:
        """Batches of the records with key < before for which ``keep`` (an Arrow expression) holds; columns that no file has are left out."""
        import pyarrow.compute as pc
        import pyarrow.dataset as ds
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        files = sorted(f.path for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.path.endswith(".parquet"))
        if not files:
            return
        data = ds.dataset(files, filesystem=store, format="parquet")
        keep = keep if before is None else keep & (pc.field("key") < before)
        known = [c for c in columns if c in data.schema.names] if columns else data.schema.names
        yield from data.scanner(columns=known, filter=keep, batch_size=self.BATCH, batch_readahead=1, fragment_readahead=1).to_batches()

    def ends(self, before: str | None, after: str | None, size: int) -> tuple[str, str, int] | None:
        """Newest and oldest key and number of the page; at most two pages of keys are held."""
        import pyarrow as pa
        import pyarrow.compute as pc

        keep = pc.field("key").is_valid()
        keep = keep if after is None else keep & (pc.field("key") > after)
        first = lambda chunks: (lambda k: k.take(pc.sort_indices(k, sort_keys=[("", "descending")])[:size]))(pa.concat_arrays(chunks))
        held, n = [], 0
        for b in self._batches(before, keep, ["key"]):
            held.append(b.column(0))
            n += b.num_rows
            if n >= 2 * size:
                held, n = [first(held)], size
        keys = first(held) if n else []
        return (keys[0].as_py(), keys[-1].as_py(), len(keys)) if n else None

    def rows(self, before: str, oldest: str, fields: list[str]) -> Iterator[tuple]:
        import pyarrow.compute as pc

        for b in self._batches(before, pc.field("key") >= oldest, fields):
            at = {c: b.column(k).to_pylist() for k, c in enumerate(b.schema.names)}
            yield from zip(*[at.get(f, [None] * b.num_rows) for f in fields], strict=True)

    def __call__(self, before: str | None, after: str | None, size: int) -> list[dict]:
        import pyarrow.compute as pc

        ends = self.ends(before, after, size)
        rows = [] if ends is None else [r for b in self._batches(ends[0] + "\0", pc.field("key") >= ends[1], []) for r in b.to_pylist()]
        return sorted(rows, key=lambda r: r["key"], reverse=True)[:size]


def scan_pages(records: DataFrame, since: Column, page_size: int, max_pages: int, source: str = "source", page: str = "page", at: str = "published") -> tuple[DataFrame, DataFrame]:
    """(kept records, runs) of landed pages of many sources at once: newest first, page numbers from 0.

    A source's run ends with the first page that holds a record before ``since``, that is short, or that is missing
    (``done``), or after ``max_pages`` (``partial``: the cursor must stay). Records without a date are kept. Counts per page
    and per source are aggregates, so that a hot source is no single task; records meet their source's end by a join.
    """
    per = records.groupBy(source, page).agg(F.count("*").alias("_n"), F.count_if(F.col(at) < since).alias("_old"))
    stops = F.min(F.when((F.col("_old") > 0) | (F.col("_n") < page_size), F.col(page)))
    runs = per.groupBy(source).agg(stops.alias("_stop"), F.max(page).alias("_last"))
    ended = F.coalesce(F.col("_stop") + 1, F.col("_last") + 2)
    used = F.least(F.col("_stop") + 1, F.col("_last") + 1, F.lit(max_pages))
    runs = runs.select(source, F.when(ended <= max_pages, "done").otherwise("partial").alias("status"), used.cast("int").alias("pages_used"))
    kept = records.join(runs.select(source, "pages_used"), source).where((F.col(page) < F.col("pages_used")) & F.coalesce(F.col(at) >= since, F.lit(True))).drop("pages_used")
    return kept, runs
