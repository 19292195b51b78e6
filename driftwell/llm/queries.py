"""The registered queries of this subpackage: thin forms of its operators over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm import decontaminate, filter_audit, html_content, jaccard_join, manifest, mixing, nearest, pii, preferences, sharding, suffix_dedup, token_counts, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_html(spark, sf_dir):
    out = html_content.main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_nearest(spark, sf_dir):
    return nearest.nearest(table(spark, sf_dir, "embeddings"))


def op4_mix(spark, sf_dir):
    return mixing.plan_mix(table(spark, sf_dir, "documents")).drop("copies")


def op5_token_counts(spark, sf_dir):
    return token_counts.histogram(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark, sf_dir):
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_jaccard(spark, sf_dir):
    return jaccard_join.components(table(spark, sf_dir, "documents"))


def op8_suffix(spark, sf_dir):
    return suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents"), digest_only=True)


def op9_preferences(spark, sf_dir):
    return preferences.digest(table(spark, sf_dir, "conversations"))


def op10_pii(spark, sf_dir):
    return pii.digest(table(spark, sf_dir, "documents"))


def op11_manifest(spark, sf_dir):
    return manifest.drill(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op1_toxicity": op1_toxicity, "op2_html": op2_html, "op3_nearest": op3_nearest, "op4_mix": op4_mix, "op5_token_counts": op5_token_counts, "op6_decontaminate": op6_decontaminate, "op7_jaccard": op7_jaccard, "op8_suffix": op8_suffix, "op9_preferences": op9_preferences, "op10_pii": op10_pii, "op11_manifest": op11_manifest, "op12_filter_audit": op12_filter_audit, "op13_sharding": op13_sharding}
ORACLES = {"op4_mix": mixing.ORACLE, "op7_jaccard": jaccard_join.ORACLE, "op9_preferences": preferences.ORACLE, "op10_pii": pii.ORACLE, "op11_manifest": manifest.ORACLE, "op12_filter_audit": filter_audit.ORACLE, "op13_sharding": sharding.ORACLE}
