"""Evidence, issues and replay on rows that tables do not hold: nulls, ties, empty inputs."""

import datetime as dt

from pyspark.sql import functions as F

from driftwell.operators import evidence, match, text


def test_accept_items(spark):
    items = spark.createDataFrame([(1, "a", "gain of 42 points", ["e1"]), (2, "a", "gain of 43 points", ["e1"]), (3, "a", "x", None), (4, "b", "x", ["e1"]), (5, "a", "no numbers", ["e1", "e1"])], "item_id long, owner string, text string, evidence array<string>")
    ex = spark.createDataFrame([("a", "e1", "a gain of 42 points"), ("a", "e2", "43")], "owner string, evidence_id string, excerpt string")
    got = {r.item_id: r.reason for r in evidence.accept_items(items, ex).collect()}
    assert got == {1: None, 2: "ungrounded_number", 3: "no_evidence", 4: "foreign_evidence", 5: None}


def test_newest_of_aliases_hides_older_acceptance(spark):
    rows = [(1, 10, ["a"]), (2, 20, ["a", "b"]), (3, 30, ["b"]), (4, 5, None), (5, 30, ["c"]), (6, 30, ["c"])]
    d = spark.createDataFrame(rows, "k long, at long, aliases array<string>")
    assert sorted(r.k for r in evidence.newest_of_aliases(d, "k", "at").collect()) == [3, 4, 6]
    assert evidence.newest_of_aliases(d.limit(0), "k", "at").count() == 0


def test_title_fallback_needs_a_long_word(spark):
    items = spark.createDataFrame([(1, None, "A Robot, Walking!"), (2, None, "A to B"), (3, "k9", "other"), (4, None, None)], "i long, k string, title string")
    seen = spark.createDataFrame([("k1", "a robot walking", 1), ("k2", "A ROBOT WALKING", 2), ("k3", "a to b", 1), ("k9", "nothing", 1)], "k string, title string, at int")
    got = {r.i: (r.matched, r.how) for r in evidence.by_id_or_title(items, seen, "i", "k", "title", "at").collect()}
    assert got == {1: ("k2", "title"), 2: (None, None), 3: ("k9", "id"), 4: (None, None)}


def test_replay_without_scan_has_no_rows(spark):
    at = dt.datetime
    obs = spark.createDataFrame([("p", at(2024, 1, 1), 1), ("p", at(2024, 3, 1), 2)], "paper_key string, observed_at timestamp, scan_id long")
    scans = spark.createDataFrame([(at(2024, 1, 5), 1, "old")], "started_at timestamp, scan_id long, policy string")
    score = lambda papers, scan: papers.withColumn("rank_pos", F.lit(1))
    cut = lambda d: F.lit(d).cast("timestamp")
    r = evidence.replay(obs, scans, cut("2024-02-01"), score, "new", 5).collect()
    assert [tuple(x) for x in r] == [("p", 1, "old", "new", False)]
    assert evidence.replay(obs, scans, cut("2024-01-02"), score, "new", 5).count() == 0


def test_subsumed_core_hits_count_once(spark):
    docs = spark.createDataFrame([(1, "micro defect detections in steel"), (2, "defect detection and micro defect detection"), (3, "defect detection")], "doc_id long, text string")
    kw = match.keyword_table(spark, [("p", "defect detection", "core", 1.0, None), ("p", "micro defect detection", "core", 0.5, None), ("q", "defect detection", "core", 2.0, None)])
    got = {(r.profile_id, r.doc_id): (r.core_hits, r.weight_sum, r.weight_max, r.primary_keyword) for r in match.judge(docs, match.match_keywords(docs, kw)).collect()}
    assert got["p", 1] == got["p", 2] == (["micro defect detection"], 0.5, 0.5, "micro defect detection")
    assert got["p", 3] == (["defect detection"], 1.0, 1.0, "defect detection") and got["q", 1][1] == 2.0


def test_segment_folds_and_keeps_abbreviations():
    assert text.segment("See Fig. 3 and J. Doe et al. here. Yes. It is so! e.g. this? Ok") == ["See Fig. 3 and J. Doe et al. here.", "Yes. It is so!", "e.g. this?", "Ok"]
    long = text.segment("x" * 1300 + " " + "word " * 300)
    assert "".join(long).replace(" ", "") == "x" * 1300 + "word" * 300 and max(map(len, long)) <= text.MAX_SENTENCE
    packed = text.pack(["aa", "bb", "cccccc"], 6)
    assert [(c["chunk"], c["n_sentences"], c["text"]) for c in packed] == [(0, 2, "aa\nbb"), (1, 1, "cccccc")]
    assert text.pack([], 5) == []
