"""Preference formatting (operator 9): a shared prompt once, and the two completions with their loss masks.

The longest common prefix of turns (same role, same text) of a chosen and a rejected conversation is the prompt; the
rest of each is its completion. A completion carries ``mask``, the [start, end) code point ranges on which to train: the
text of assistant turns, its end mark included.

Conversations are compared turn by turn in DataFrame functions; a conversation is one record and is put together from
its own turns only.

Defined cases: a null role is the empty role, a null text the empty text; turns are ordered by (turn, role, text) and rows that repeat
all three count once; a null conv_id takes no part; a conversation without a partner has null rejected columns, an
empty prompt and all its turns as its completion; equal conversations share all turns as prompt and have empty
completions; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.operators.graph import cut, running_sums

START, SEP, END = "<|", "|>\n", "\n<|end|>\n"
TRAINED_ROLE = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns array of (turn, role, text)) in order."""
    clean = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return clean.groupBy("conv_id").agg(F.array_distinct(F.array_sort(F.collect_list(F.struct("turn", "role", "text")))).alias("turns"))


def pair_up(convs: DataFrame) -> DataFrame:
    """(pair_id, chosen_id, chosen, rejected_id, rejected): conversations in order of their first turn, two by two.

    Conversations with the same first turn pair with each other as far as they go; the last of an odd number stands after
    all whole pairs, where such odd ones pair in order of their first turn and at most one stays alone. The lower id of a
    pair is the chosen one. Positions come from range partitions, not from one window over all.
    """
    convs = cut(convs)  # read once for the pairing and twice for the pairs
    first = convs.select("conv_id", F.md5(F.element_at("turns", 1)["text"]).alias("key"))
    odd = first.groupBy("key").agg(F.max("conv_id").alias("conv_id"), F.count("*").alias("n")).where("n % 2 = 1").select("conv_id", F.lit(True).alias("odd"))
    first = first.join(odd, "conv_id", "left").withColumn("odd", F.coalesce("odd", F.lit(False)))
    placed = running_sums(first, ["odd", "key", "conv_id"], {"position": F.lit(1)}).select("conv_id", F.floor(F.col("position") / 2).alias("pair_id"))
    ids = placed.groupBy("pair_id").agg(F.min("conv_id").alias("chosen_id"), F.max("conv_id").alias("rejected_id"))
    ids = ids.withColumn("rejected_id", F.when(F.col("rejected_id") != F.col("chosen_id"), F.col("rejected_id")))
    a = convs.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen"))
    b = convs.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("rejected"))
    return ids.join(a, "chosen_id").join(b, "rejected_id", "left")


def _shown(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit(SEP), turn["text"], F.lit(END))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _shown), "")


def _mask(turns: Column) -> Column:
    """Ranges of the trained turns' text and end mark in the rendered turns."""
    shape = "struct<at:int,spans:array<struct<start:int,end:int>>>"

    def step(acc, t):
        lo = acc["at"] + F.length(t["role"]) + len(START) + len(SEP)
        hi = lo + F.length(t["text"]) + len(END)
        one = F.array(F.struct(lo.alias("start"), hi.alias("end")))
        spans = F.when(t["role"] == TRAINED_ROLE, F.concat(acc["spans"], one)).otherwise(acc["spans"])
        return F.struct(hi.alias("at"), spans.alias("spans")).cast(shape)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")).cast(shape)
    return F.aggregate(turns, start, step)["spans"]


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pair_id, ids, n_prompt_turns, prompt, chosen and rejected completions and their masks."""
    same = F.zip_with("chosen", "rejected", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    miss = F.array_position(same, False).cast("int")
    n = F.when(F.col("rejected").isNull(), 0).when(miss > 0, miss - 1).otherwise(F.size(same))
    p = pairs.withColumn("n_prompt_turns", n)
    rest = lambda c: F.slice(c, F.col("n_prompt_turns") + 1, F.greatest(F.size(c) - F.col("n_prompt_turns"), F.lit(0)))
    p = p.withColumn("_c", rest("chosen")).withColumn("_r", rest("rejected"))
    return p.select(
        "pair_id", "chosen_id", "rejected_id", "n_prompt_turns", _rendered(F.slice("chosen", F.lit(1), F.col("n_prompt_turns"))).alias("prompt"),
        _rendered(F.col("_c")).alias("chosen"), _rendered(F.col("_r")).alias("rejected"), _mask(F.col("_c")).alias("chosen_mask"), _mask(F.col("_r")).alias("rejected_mask"),
    )


def digest(turns: DataFrame) -> DataFrame:
    """The formatted pairs with their masks as text, start-end joined by commas."""
    out = format_pairs(pair_up(conversations(turns)))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.withColumn("chosen_mask", text("chosen_mask")).withColumn("rejected_mask", text("rejected_mask"))


_SQL_TEXT = "list_transform({0}, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || chr(10) || '<|end|>' || chr(10))"
_SQL_MASK = (
    "array_to_string(list_transform(list_filter(range(1, len({0}) + 1), lambda i: ({0})[i].role = 'assistant'), lambda i: "
    "(coalesce(list_sum(list_transform(({0})[1:i - 1], lambda t: length(t.role) + length(t.text) + 14)), 0) + length(({0})[i].role) + 5)::BIGINT || '-' || "
    "(coalesce(list_sum(list_transform(({0})[1:i], lambda t: length(t.role) + length(t.text) + 14)), 0))::BIGINT), ',')"
)
ORACLE = f"""
WITH c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn, role, text) AS turns FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
g AS (SELECT *, md5(turns[1].text) AS key FROM c),
h AS (SELECT *, count(*) OVER (PARTITION BY key) % 2 = 1 AND conv_id = max(conv_id) OVER (PARTITION BY key) AS odd FROM g),
o AS (SELECT *, (row_number() OVER (ORDER BY odd, key, conv_id) - 1) // 2 AS pair_id FROM h),
i AS (SELECT pair_id, min(conv_id) AS a, nullif(max(conv_id), min(conv_id)) AS b FROM o GROUP BY pair_id),
p AS (SELECT i.pair_id, i.a, i.b, x.turns AS x, y.turns AS y FROM i JOIN c x ON x.conv_id = i.a LEFT JOIN c y ON y.conv_id = i.b),
n AS (SELECT *, CASE WHEN y IS NULL THEN 0 ELSE coalesce(list_min(list_filter(range(1, greatest(len(x), len(y)) + 1), lambda k: k > len(x) OR k > len(y) OR x[k].role <> y[k].role OR x[k].text <> y[k].text)) - 1, len(x)) END::INT AS k FROM p),
s AS (SELECT *, x[1:k] AS u, x[k + 1:] AS v, y[k + 1:] AS w FROM n)
SELECT pair_id, a AS chosen_id, b AS rejected_id, k AS n_prompt_turns, array_to_string({_SQL_TEXT.format("u")}, '') AS prompt, array_to_string({_SQL_TEXT.format("v")}, '') AS chosen,
  array_to_string({_SQL_TEXT.format("w")}, '') AS rejected, {_SQL_MASK.format("v")} AS chosen_mask, {_SQL_MASK.format("w")} AS rejected_mask FROM s
"""
