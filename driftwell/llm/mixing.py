"""Mixing sources to target weights (operator 4), in DataFrame functions only.

Tokens are summed per source; targets are filled by weight up to a cap of ``max_repeats`` times the source; the
repetition rate of a source is target / size, and a document is emitted floor(rate) times plus one copy where a hash of
its id falls below the fraction.

Defined cases: null text has size 0; a null source is a source of its own, last in order; documents of size 0 get the
copies of their source but take no words; an empty table gives no rows; repeated rows decide alike and each counts; a
source of size 0 has rate 0. Extra columns, whatever their names, pass through ``mix_documents`` untouched; a null id
decides by its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.llm.places import small
from driftwell.llm.tokens import unused
from driftwell.operators.graph import cut, running_sums

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Maximal runs of characters outside space and \\x09-\\x0D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(key: Column, seed: str) -> Column:
    """A double in [0, 1) from the first 52 bits of md5(seed:key)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def source_targets(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, max_repeats: int = 2, size: str = "size") -> DataFrame:
    """(source, source_size, target) for a table with ``source`` and ``size``.

    A target is least(max_repeats * size, level * weight), and level is the one at which targets sum to share * total.
    Sources are taken in order of cap / weight; the level after k capped sources is (share * total - their caps) /
    (weights of the rest), and the first k whose next source is not above its cap holds.
    """
    sums = docs.groupBy("source").agg(F.sum(size).cast("long").alias("source_size"))
    order = [F.col("source").asc_nulls_last()]
    ranked = running_sums(sums, order, {"position": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    ranked = cut(ranked.select("source", "source_size", weight.cast("long").alias("w")))
    cap = (F.col("source_size") * max_repeats).alias("cap")
    by_ratio = [(F.col("cap").cast("double") / F.col("w")).asc(), F.col("source").asc_nulls_last()]
    filled = cut(running_sums(ranked.withColumn("cap", cap), by_ratio, {"capped": F.col("cap"), "weighed": F.col("w")}))
    total = filled.agg(F.sum("source_size").cast("double").alias("t"), F.sum("w").alias("all_w"))
    level = (F.lit(share) * F.col("t") - F.col("capped")) / (F.col("all_w") - F.col("weighed"))
    free = filled.crossJoin(F.broadcast(total)).select("*", level.alias("level"))  # one row of totals
    first = free.where(F.col("level") * F.col("w") <= F.col("cap")).agg(F.min_by("level", F.struct("capped", "weighed")).alias("level"))
    return filled.crossJoin(F.broadcast(first)).select(
        "source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("w"), F.col("cap").cast("double"))).alias("target")
    )


def copies(rate: Column, key: Column, seed: str) -> Column:
    """floor(rate) copies and one more with probability rate - floor(rate), decided by the hash of the key."""
    return (F.floor(rate) + F.when(unit_hash(key, seed) < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def row_key(id_col: str, text_col: str = "text") -> Column:
    """What decides for a row: its id, or its text where the id is null."""
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text_col, F.lit("")))))


def _planned(docs: DataFrame, name: str, seed: str, id_col: str, targets: dict) -> DataFrame:
    """Adds the struct ``name`` with size, source_size, target and copies of every row."""
    side = f"{name}_source"
    sized = docs.withColumn(name, F.struct(word_count(F.col("text")).alias("size"), row_key(id_col).alias("key")))
    t = source_targets(sized.select("source", F.col(name)["size"].alias("size")), **targets)
    t = t.select(F.col("source").alias(side), F.struct("source_size", "target").alias(f"{name}_of"))
    of, size = F.col(f"{name}_of"), F.col(name)["size"]
    rate = F.when(of["source_size"] > 0, of["target"] / of["source_size"]).otherwise(0.0)
    t = small(t, t.count())  # one row a source
    joined = sized.join(t, F.col("source").eqNullSafe(F.col(side)), "left")
    plan = F.struct(size.alias("size"), of["source_size"].alias("source_size"), of["target"].alias("target"), copies(rate, F.col(name)["key"], seed).alias("copies"))
    return joined.withColumn(name, plan).select(*docs.columns, name)


def plan_mix(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", **targets) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for every document."""
    out = _planned(docs.select(id_col, "source", "text"), unused(docs, "plan"), seed, id_col, targets)
    plan = F.col(out.columns[-1])
    return out.select(id_col, plan["size"].alias("size"), plan["source_size"].alias("source_size"), plan["target"].alias("target"), (plan["copies"] * plan["size"]).alias("taken"), plan["copies"].alias("copies"))


def mix_documents(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", **targets) -> DataFrame:
    """The mixed corpus itself: every row of ``docs`` repeated as its copies say, with their number from 1 in ``_copy``.

    If ``docs`` has a column of that name already, the number's column gets as many more underscores as it takes.
    """
    name = unused(docs, "plan")
    out = _planned(docs, name, seed, id_col, targets)
    n = F.col(name)["copies"].cast("int")
    each = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return out.select(*docs.columns, F.explode(each).alias(unused(docs, "_copy")))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) AS key, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 2 * source_size AS cap FROM s),
c AS (SELECT *, coalesce(sum(cap) OVER o, 0)::DOUBLE AS capped, coalesce(sum(w) OVER o, 0)::DOUBLE AS weighed FROM r
      WINDOW o AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE - capped) / ((SELECT sum(w) FROM r)::DOUBLE - weighed) AS level FROM c),
f AS (SELECT arg_min(level, weighed) AS level FROM l WHERE level * w <= cap),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM f) * w, cap::DOUBLE)) AS target FROM r),
x AS (SELECT doc_id, key, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((floor(rate) + CASE WHEN ('0x' || substr(md5('mix:' || key), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0
         < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM x
"""
