"""Paged feeds: boundaries, runs that end early, failing pages and restarts; every record once."""

import json

import pytest
from pyspark.sql import functions as F

from driftwell.sources import paged

SCHEMA = "key string, v long"


class Folder:
    """A feed in a file that grows between runs; ``fail`` names a key whose page can't be had."""

    def __init__(self, path):
        self.path = str(path)

    def __call__(self, before, after, size):
        state = json.load(open(self.path))
        rows = [k for k in sorted(state["keys"], reverse=True) if (before is None or k < before) and (after is None or k > after)][:size]
        if state["fail"] and rows and rows[0] <= state["fail"]:
            raise OSError("no answer")
        return [{"key": k, "v": int(k[1:])} for k in rows]


def put(path, keys, fail=None):
    json.dump({"keys": [f"k{k:05}" for k in keys], "fail": fail}, open(path, "w"))


def run(spark, tmp_path, **kw):
    f = paged.paged_feed(spark, Folder(tmp_path / "feed"), SCHEMA, **kw)
    q = f.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return paged.run_status(q)


def got(spark, tmp_path):
    return sorted(r.v for r in spark.read.schema(SCHEMA).parquet(str(tmp_path / "out")).collect())


def test_runs_that_end_early_lose_and_repeat_nothing(spark, tmp_path):
    put(tmp_path / "feed", range(100, 150))
    kw = {"page_size": 7, "max_pages": 3}
    assert run(spark, tmp_path, **kw)["status"] == "partial" and got(spark, tmp_path) == list(range(129, 150))
    put(tmp_path / "feed", range(100, 180))  # the feed grows while a hole is open
    s = run(spark, tmp_path, **kw)
    assert s["status"] == "partial" and got(spark, tmp_path) == list(range(129, 150)) + list(range(159, 180)) and len(json.loads(s["holes"])) == 2
    n = 0
    while run(spark, tmp_path, **kw)["status"] != "done":
        n += 1
        assert n < 10
    assert got(spark, tmp_path) == list(range(100, 180))
    assert run(spark, tmp_path, **kw)["status"] == "done" and got(spark, tmp_path) == list(range(100, 180))
    put(tmp_path / "feed", range(100, 185))
    assert run(spark, tmp_path, **kw)["status"] == "done" and got(spark, tmp_path) == list(range(100, 185))


def test_a_failing_page_keeps_those_before_it(spark, tmp_path):
    put(tmp_path / "feed", range(40), fail="k00019")
    kw = {"page_size": 10, "max_pages": 9, "since": "k00004"}
    s = run(spark, tmp_path, **kw)
    assert s["status"] == "partial" and s["error"] == "page 3: OSError" and got(spark, tmp_path) == list(range(20, 40))
    put(tmp_path / "feed", range(40))
    assert run(spark, tmp_path, **kw)["status"] == "done" and got(spark, tmp_path) == list(range(5, 40))


def test_a_failing_first_page_fails_the_run(spark, tmp_path):
    put(tmp_path / "feed", range(9), fail="k00008")
    with pytest.raises(Exception, match="no answer"):
        run(spark, tmp_path)


@pytest.mark.parametrize(("n", "status", "used"), [(0, None, None), (4, "done", 1), (5, "done", 1), (25, "partial", 3), (14, "done", 3), (15, "partial", 3)])
def test_scan_pages(spark, n, status, used):
    d = spark.range(n).select(F.lit("s").alias("source"), F.floor(F.col("id") / 5).alias("page"), F.when(F.col("id") != 2, 1000 - F.col("id")).alias("published"), "id")
    kept, runs = paged.scan_pages(d, F.lit(0), 5, 3)
    assert [(r.status, r.pages_used) for r in runs.collect()] == ([] if status is None else [(status, used)]) and kept.count() == min(n, 15)
    kept, runs = paged.scan_pages(d, F.lit(993), 5, 3)  # the eighth record is older
    assert sorted(r.id for r in kept.collect()) == list(range(min(n, 8))) and all(r.status == "done" for r in runs.collect())
