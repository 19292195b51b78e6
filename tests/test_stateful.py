"""Streams with timers against their batch forms, over several batches and restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from driftwell.operators import asof, feedback
from driftwell.streaming import stateful, streams

T0 = dt.datetime(2024, 1, 1)
PRESS = "event_id string, tid string, action string, received_at timestamp"


def at(s):
    return T0 + dt.timedelta(seconds=s)


def batches(spark, path, rows, schema):
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{path}/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def test_press_states_are_those_of_the_batch_form(spark):
    rng = random.Random(6)
    rows, want = [], {}
    tokens = [(f"t{k}", at(-1000) if k % 3 else at(0), at(700)) for k in range(20)]
    for k in range(22):
        for e in range(rng.randint(1, 40)):
            rows.append((f"{k:02}-{e:03}", f"t{k}", rng.choice(["more", "useful", "out", "undo", "out", "more"]), at(rng.randint(0, 800) if k % 2 else rng.randint(0, 90))))
    e, t = spark.createDataFrame(rows, PRESS), spark.createDataFrame(tokens, "tid string, delivered_at timestamp, expires_at timestamp")
    got = {r.event_id: r.status for r in feedback.reaction_states(e, t).collect()}
    micros = lambda t: (t - T0) // dt.timedelta(microseconds=1)
    known = {i: (micros(d), micros(x)) for i, d, x in tokens}
    for tid in {r[1] for r in rows}:
        mains = {}
        for i, _, a, s in sorted(r for r in rows if r[1] == tid):
            want[i] = "duplicate"
            mains.setdefault((micros(s), a), i)
        keys = sorted(mains)
        for k, s in zip(keys, stateful.press_states(keys, *known.get(tid, (None, None))), strict=True):
            want[mains[k]] = s
    assert got == want and {"burst", "cancelled", "duplicate", "expired", "prefetch", "undo", "unknown", "valid"} == set(want.values())


def test_reaction_stream_over_batches_and_a_restart(spark, tmp_path):
    rng = random.Random(3)
    own = stateful.stateful_session(spark)
    tokens = spark.createDataFrame([(f"t{k}", at(0), at(900)) for k in range(6)], "tid string, delivered_at timestamp, expires_at timestamp")
    tokens.write.parquet(str(tmp_path / "tokens"))
    rows = [(f"{k:04}", f"t{rng.randint(0, 7)}", rng.choice(["more", "useful", "out", "undo"]), at(rng.randint(0, 1500))) for k in range(400)]
    rows.sort(key=lambda r: r[3] + dt.timedelta(seconds=rng.randint(-100, 100)))  # late by less than the allowance
    known = own.read.parquet(str(tmp_path / "tokens"))
    out = None
    for n in (2, 5):  # two batches, then three more after a restart from the checkpoint
        for k in range(n):
            path = tmp_path / "in" / str(k)
            if not path.exists():
                spark.createDataFrame(rows[80 * k : 80 * k + 80], PRESS).coalesce(1).write.parquet(str(path))
        s = own.readStream.schema(PRESS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        out = streams.run_to_table(stateful.reaction_stream(s, known), "update", at=str(tmp_path / "run"))
    got = {r.event_id: r.status for r in stateful.last_states(out, "event_id").collect()}
    want = {r.event_id: r.status for r in feedback.reaction_states(spark.createDataFrame(rows, PRESS), tokens).collect()}
    assert got == want


def test_state_leaves_after_expiry(spark, tmp_path):
    own = stateful.stateful_session(spark)
    tokens = own.createDataFrame([("a", at(0), at(100))], "tid string, delivered_at timestamp, expires_at timestamp")
    far = [("9", "b", "more", at(5000))]
    s = batches(own, tmp_path / "in", [[("1", "a", "more", at(50))], far, [("8", "b", "out", at(6000))], [("7", "b", "out", at(7000))]], PRESS)
    at_ = str(tmp_path / "run")
    streams.run_to_table(stateful.reaction_stream(s, tokens), "update", at=at_)
    left = own.read.format("statestore").option("path", f"{at_}/state").option("stateVarName", "seen").load()
    assert [r.key.tid for r in left.collect()] == ["b"]


KINDS = "user_id long, item long, kind string, at timestamp, axes map<string,string>"


@pytest.mark.parametrize("shuffled", [False, True])
def test_change_notices(spark, tmp_path, shuffled):
    own = stateful.stateful_session(spark)
    rng = random.Random(8)
    rows = [(rng.randint(1, 3), rng.randint(1, 8), rng.choice(["state", "state", "sent"]), at(7 * k), rng.choice([{"a": "0", "b": "x"}, {"a": "1", "b": "x"}, {"a": "1", "b": None}, {}])) for k in range(240)]
    if shuffled:
        rng.shuffle(rows)
    s = batches(own, tmp_path / "in", [rows[:100], rows[100:160], rows[160:]], KINDS)
    out = streams.run_to_table(stateful.change_notices(s, ["user_id", "item"], ["a", "b"]), "update")
    got = {(r.user_id, r.item): (list(r.changed), r["first"]) for r in stateful.last_states(out, ["user_id", "item"]).collect() if r.changed}
    d = spark.createDataFrame(rows, KINDS)
    want = {(r.user_id, r.item): (list(r.changed), r["first"]) for r in asof.pending_changes(d, ["user_id", "item"], ["a", "b"]).collect()}
    assert got == want and want


def test_a_notice_is_taken_back_when_acknowledged(spark, tmp_path):
    own = stateful.stateful_session(spark)
    new = {"a": "1"}
    s = batches(own, tmp_path / "in", [[(1, 1, "state", at(0), new)], [(1, 1, "sent", at(5), new)], [(1, 1, "state", at(9), {"a": "2"})]], KINDS)
    rows = streams.run_to_table(stateful.change_notices(s, ["user_id", "item"], ["a"]), "update").orderBy("_epoch").collect()
    assert [(r.changed, r["first"]) for r in rows] == [(["a"], True), ([], False), (["a"], False)]


def test_changed_since_sent(spark):
    now = spark.createDataFrame([("p", k, k % 2, "x") for k in range(6)] + [("q", 1, None, "x")], "reader string, paper_key long, retraction long, repro string")
    sent = spark.createDataFrame([("p", 0, 0, "x"), ("p", 1, 0, "x"), ("p", 2, 1, "y"), ("q", 1, None, "x")], "reader string, paper_key long, retraction long, repro string")
    out = asof.changed_since_sent(now, sent, ["reader", "paper_key"], ["retraction", "repro"], limit=3, urgent=F.col("retraction") == 1).collect()
    assert [(r.reader, r.paper_key, r.changed) for r in sorted(out, key=lambda r: r.place)] == [("p", 1, ["retraction"]), ("p", 3, ["retraction", "repro"]), ("p", 5, ["retraction", "repro"])]
