"""The pipeline's stages on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k % 5000}x" for k in range(30_000))
NEAR = " ".join(f"v{k}" for k in range(60))
ROWS = [
    (1, None, "en", "a", None), (2, "", None, "a", 0), (None, "a text without an id that says little", "en", "a", 37), (3, NEAR, "en", "a", 1), (3, NEAR, "en", "a", 1), (4, NEAR + " more", "en", None, 1), (5, LONG, "en", "b", 1), (6, "write to jo@x.org now, please do", None, None, None), (None, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    for c in ("score", "leaks", "spans", "work", "plan", "_copy", "component_id", "size"):
        d = d.withColumn(c, F.lit("kept"))
    return d.cache()


KEPT = {"toxicity": len(ROWS), "near_duplicates": len(ROWS) - 2, "decontamination": len(ROWS), "pii": len(ROWS)}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, SF)
    assert out.columns == [*docs.columns, "__copy"] if name == "mixing" else out.columns == docs.columns
    rows = out.collect()
    assert all(r.score == r.leaks == r.spans == r.work == r.plan == r["_copy"] == r.component_id == r.size == "kept" for r in rows)
    texts = [r.text for r in rows]
    if name != "mixing":
        assert len(rows) == KEPT[name] and texts.count(None) == 2 and "" in texts and LONG in texts
    if name == "near_duplicates":
        assert texts.count(NEAR) == 1 and NEAR + " more" not in texts
    if name == "pii":
        assert {(r.doc_id, r.text, r.n_chars) for r in rows if r.doc_id in (1, 6)} == {(1, None, None), (6, "write to [EMAIL] now, please do", 31)}
    if name == "mixing":
        assert set(texts) <= {t for _, t, *_ in ROWS} and all(r["__copy"] in (1, 2) for r in rows)
    empty = stage(spark, docs.limit(0), SF)
    assert empty.columns == out.columns and empty.count() == 0
