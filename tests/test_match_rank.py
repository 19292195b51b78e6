"""Contract rows of matching and ranking."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from driftwell.functions import keys as K
from driftwell.operators import match, rank


@pytest.mark.parametrize(
    ("keyword", "text", "hit"),
    [
        ("robot policy", "Learning robot policies at scale", True), ("AI", "domain", False), ("digital twin", "two digital-twins", True),
        ("vision language model", "vision--language (models", True), ("vision language model", "vision and language model", False), ("key", "two keys", True), ("box", "boxes", True),
    ],
)
def test_keyword_match(spark, keyword, text, hit):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    kw = match.keyword_table(spark, [("p", keyword, "core", 1.0, None)])
    assert match.match_keywords(docs, kw).count() == int(hit)


def test_guard_and_exclusion(spark):
    docs = spark.createDataFrame([(1, "A planner for medical diagnosis"), (2, "a planner"), (3, "a planner that plans"), (4, None), (5, "")], "doc_id long, text string")
    kw = match.keyword_table(spark, [("p", "planner", "core", 1.0, "(?i)plans|medical"), ("p", "medical", "exclude", None, None)])
    j = {r.doc_id: r for r in match.judge(docs, match.match_keywords(docs, kw), profiles=kw).collect()}
    assert (j[1].filter_reason, j[1].exclude_hits) == ("excluded", ["medical"])
    assert {k: j[k].filter_reason for k in (2, 3, 4, 5)} == {2: "no_core_hit", 3: None, 4: "no_core_hit", 5: "no_core_hit"}


def test_equi_join_not_cartesian(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = match.match_keywords(docs, match.keyword_table(spark, [("p", "x", "core", 1.0, None)]))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def _judged(spark, rows):
    """(doc_id, day, weight_max, core hits, domain hits)"""
    s = "doc_id long, day date, weight_max double, core_hits array<string>, domain_hits array<string>"
    return spark.createDataFrame(rows, s).withColumn("eligible", F.lit(True)).withColumn("profile_id", F.lit("p"))


def _order(spark, rows):
    kw = match.keyword_table(spark, [("p", "a", "core", 1.0, None), ("p", "b", "core", 0.5, None)])
    return [r.doc_id for r in rank.ranked(_judged(spark, rows), kw).orderBy("rank_pos").collect()]


def test_rank_contract(spark):
    d = lambda k: dt.date(2026, 9, k)
    assert _order(spark, [(1, d(4), 1.0, ["a"], []), (2, d(10), 0.5, ["b"], ["x", "y"])]) == [1, 2]
    assert _order(spark, [(1, d(5), 1.0, ["a"], ["x", "y"]), (2, d(10), 1.0, ["a"], [])]) == [2, 1]
    rows = [(k, d(1 + k % 5) if k % 4 else None, [1.0, 0.5][k % 2], ["a", "b"][: 1 + k % 2], ["x"] * (k % 3)) for k in range(12)]
    assert _order(spark, rows) == _order(spark, rows[::-1])


def test_band_anchor(spark):
    def anchor(days):
        return rank.band_anchor(_judged(spark, [(k, dt.date(2026, 9, x), 1.0, ["a"], []) for k, x in enumerate(days)])).first().anchor.day

    assert anchor([20, 19, 18, 18, 18, 18] + [17] * 68) == 18
    assert anchor([20, 11]) == 20
    assert anchor([20, 11, 10]) == 20


def test_scalar_rules(spark):
    r = spark.createDataFrame([("2026-09-10T00:00:00Z",), ("2026-09-10",), ("2026",), ("x",), (None,)], "s string").select(K.partial_date(F.col("s")).alias("d")).collect()
    assert [x.d.precision for x in r] == ["day", "day", "year", "invalid", "missing"]
    assert r[0].d.day == dt.date(2026, 9, 10) and r[2].d.day is None
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(K.weight_band(F.lit(0.3))) == 0.3 and one(K.concept_breadth(F.array(F.lit("robotic arm"), F.lit("robot-arm")))) == 1
    assert one(K.cell_number(F.lit("−1,234.5 (3)"))) == -1234.5 and one(K.cell_number(F.lit("3/4"))) is None
    assert one(K.venue_hit(F.lit(None).cast("string"), F.array(F.lit("cvpr")))) is None and one(K.venue_hit(F.lit("CVPR 2026"), F.array(F.lit("cvpr")))) is True
    assert one(K.retraction_code(F.lit(None).cast("boolean"), F.lit(True))) == 1
    assert one(K.title_match(F.lit("A Big Model"), F.lit("a big model!"))) is True
    assert one(K.operating_day(F.lit("2024-01-01 19:59:00").cast("timestamp"))) == dt.date(2024, 1, 1)
    assert one(K.paper_key(F.lit(None), F.lit("s2:1"), F.lit("10.1/X"), F.lit("t"))) == "doi:10.1/x"
    assert one(K.secret_like(F.lit("api_key = abcdefgh1"))) is True
    assert re.search(match.keyword_pattern("a b").replace(r"\p{L}\p{N}", r"\w").replace(r"\x{2010}-\x{2015}", "‐-―"), "x A-Bs y")


def test_subsumed(spark):
    r = spark.range(1).select(match.drop_subsumed(F.array(*map(F.lit, ("language model", "large language model", "planner")))).alias("x")).first().x
    assert r == ["large language model", "planner"]
