"""Streams give what their batch forms give."""

from pyspark.sql import functions as F

from driftwell.operators import match
from driftwell.streaming import streams
from tests.conftest import SF

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def test_tumbling_equals_batch(spark):
    s = streams.read_files(spark, f"{SF}/events.parquet*", EVENTS)
    got = streams.run_to_table(streams.tumbling_counts(s, "ts", "event_type"))
    want = spark.read.parquet(f"{SF}/events.parquet").groupBy(F.window("ts", "7 days").alias("w"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted((r.w.start, r.event_type, r.n) for r in want.collect())


def test_upsert_sink_is_idempotent(spark, tmp_path):
    sink = streams.upsert_sink(str(tmp_path / "t"), ["k"], "at", overwrite=["v"])
    b = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k long, at long, v string")
    for epoch in (0, 0, 1):
        sink(b, epoch)
    assert [tuple(r) for r in streams.latest_version(spark, str(tmp_path / "t")).collect()] == [(1, "b", 2)]


def test_matched_stream_gives_a_keyword_once(spark, tmp_path):
    k = match.keyword_table(spark, [("p", "robot", "core", 1.0, None), ("p", "policy gradient", "core", 2.0, None), ("p", "battery", "exclude", None, None)])
    rows = [(1, "robot robots robotics robotic"), (2, "Policy-gradients for batteries"), (3, "nothing"), (4, None), (5, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = streams.run_to_table(streams.matched(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), k), "append")
    want = match.match_keywords(d, k)
    pairs = lambda t: sorted((r.doc_id, r.keyword) for r in t.collect())
    assert pairs(got) == pairs(want) == [(1, "robot"), (2, "battery"), (2, "policy gradient")]
