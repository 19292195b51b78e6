"""The driver's contract."""

import __spark_entry__ as entry
from tests.conftest import SF


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_core_stands_alone(monkeypatch):
    monkeypatch.setattr(entry, "LLM", False)
    monkeypatch.setattr(entry, "PIPELINE", False)
    q = entry.queries()
    assert q and not any(k.startswith("op") or k == "pipeline" for k in q) and set(entry.oracle_sql()) <= set(q)


def test_partition_count_does_not_matter(spark):
    from driftwell.plans.queries import QUERIES

    old = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(tuple, QUERIES["profile_topk"](spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got[0] == got[1]
