"""Cursors, seeds, lanes, peers and loads against rows worked out by hand or by a plain loop."""

import datetime as dt
import random

from pyspark.sql import functions as F

from driftwell.operators import cells, merge, signals, terms, text
from driftwell.sources.readers import grids


def test_cursor_starts_anew_on_changed_topics(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    rows = [("a", "x", "done", t(1), t(2), "s1", 1), ("a", "x", "partial", t(3), t(9), "s1", 2), ("b", "x", "done", t(1), t(12), "s1", 1), ("c", "x", "done", t(1), t(2), None, 1), ("d", "x", "done", t(1), t(30), "s1", 1)]
    runs = spark.createDataFrame(rows, "profile_id string, source string, status string, window_from timestamp, window_to timestamp, topic_signature string, started_at int")
    now = spark.createDataFrame([("a", "s1"), ("b", "s2"), ("c", "s2"), ("e", "s1")], "profile_id string, signature string")
    got = {r.profile_id: r.since for r in signals.next_cursor(runs, F.lit("2024-01-20").cast("timestamp"), signatures=now).collect()}
    assert got == {"a": t(3), "b": t(13), "c": t(2), "d": t(15), "e": t(13)}
    plain = {r.profile_id: r.since for r in signals.next_cursor(runs, F.lit("2024-01-20").cast("timestamp")).collect()}
    assert plain == {"a": t(3), "b": t(12), "c": t(2), "d": t(15)}


def test_lanes_against_a_loop(spark):
    rnd = random.Random(3)
    for n, top in ((0, 5), (2, 5), (40, 12)):
        rows = [(f"t{k}", s := rnd.randint(1, 6), rnd.randint(0, s) if k % 3 == 0 else 0, rnd.randint(0, 4), rnd.choice([None, 1, 2, 3])) for k in range(n)]
        found = spark.createDataFrame(rows, "term string, support int, domain_docs int, breadth int, newest int")
        lanes = [
            sorted(rows, key=lambda r: (-r[1], -r[2] / r[1], r[0])), sorted([r for r in rows if r[2]], key=lambda r: (-r[2] / r[1], -r[1], r[0])),
            sorted([r for r in rows if r[3] >= 2], key=lambda r: (-r[3], -(r[4] or 0), -r[1], r[0])),
        ]
        want, seen = [], set()
        for i in range(top):
            for lane in (i % 3, 0):
                free = [r[0] for r in lanes[lane] if r[0] not in seen]
                if free:
                    seen.add(free[0])
                    want.append((free[0], lane))
                    break
        got = terms.lanes(found, top).orderBy("place").collect()
        assert [(r.term, r.lane) for r in got] == want


def test_peers_leave_out_own_and_variants(spark):
    rows = [("Foo", True, 5.0, 1), ("foo-S", False, 9.0, 2), ("Bar", False, 4.0, 3), ("Bar w/ aug", False, 8.0, 4), ("Baz", False, 7.0, 5), ("Baz", False, 7.0, 6)]
    r = spark.createDataFrame([(1, str(n), m, o, v, "higher", n) for m, o, v, n in rows], "table_id int, locator string, model string, own boolean, value double, direction string, row_no int")
    mains = spark.createDataFrame([(1, "1", "Foo", 5.0), (2, "9", None, 1.0)], "table_id int, locator string, method string, value double")
    assert [(x.model, x.place) for x in cells.peers(r, mains, ["table_id"]).orderBy("place").collect()] == [("Baz", 1), ("Baz", 2), ("Bar", 3)]
    assert cells.own_siblings(r, mains, ["table_id"]).count() == 0


def test_loads_seeds_and_context(spark):
    f = spark.createDataFrame([(1, 1, "useful", None, "unassessed"), (1, 1, "useful", " ", "supported"), (1, 1, None, "c", "unassessed"), (2, 1, "known", "c", "unclear")], "profile_id int, paper_key int, usefulness string, claim string, support string")
    sent = spark.createDataFrame([(1, 1), (1, 1)], "profile_id int, paper_key int")
    got = sorted(str(r.reason) for r in merge.feedback_load(f, sent, ["useful", "known"], ["supported", "unclear"]).collect())
    assert got == ["None", "claim_missing", "not_delivered", "unknown_value"]
    one = lambda rows, kind: spark.createDataFrame(rows, kind)
    states = signals.seed_states(one([("a",), ("b",), ("c",), ("d",)], "seed string"), one([("a", "done"), ("b", "failed"), ("b", "done"), ("c", "failed")], "seed string, status string"), one([("a",), ("a",)], "seed string"))
    assert sorted(map(tuple, states.collect())) == [("a", "done", 2), ("b", "partial", 0), ("c", "failed", 0), ("d", "not_attempted", 0)]
    t = one([("x" * 9 + " go \n now " + "y" * 9,), ("none",), (None,)], "t string")
    assert [r[0] for r in t.select(text.around(F.col("t"), "now", 5)).collect()] == ["…go now y…", None, None]
    scans = one([(1, 5, None), (1, None, "deferred: a"), (1, None, "broken"), (1, None, ""), (1, None, None)], "profile_id int, observations int, observation_error string")
    assert tuple(signals.scan_health(scans).first()) == (1, 5, 1, 1, 2, 1)


def test_table_spans_end_with_the_table():
    wide = grids("<table><tr><td rowspan=1000 colspan=1000>a<td>b</table>")
    assert [(len(g[3]), g[2]) for g in wide] == [(1001, 0)]
    two = grids("<![odd[x]><table><tr><th rowspan=9>h<td>1<tr><td>2</table>")
    assert [g[3] for g in two] == [["h", "1"], ["h", "2"]]
    assert grids("<table><tr><td colspan=9999 rowspan=2>a<tr><td>b</table>")[0][3][9998] == "a" and grids("<table><tr><td colspan=99999>a</table>") == []
