r"""What filters do to each other in every order of application (operator 12).

A document's failures make a bit mask; documents are counted by part and mask, once. For one mask, the step at which an
order removes the document depends on the order's first letters alone, and the orders with the same first letters are
neighbours in lexicographic order: an interval of Lehmer ranks. So each mask adds its counts at the start of its
intervals and takes them away behind their ends; sums over the ranks give every measure of all orders.

Failures of the query: A under 50 words; B fewer than 65 % distinct words; C more than 5 % of A-Z; D one of #$%&*|; E the
text of a smaller doc_id.

Defined cases: null text is empty; a null part is the empty string, one part with it; a row without id has no label
and is neither a copy nor an original of others; rows that repeat an id and its text count each and fail E alike; of several labels of an
id the largest counts; a label of no document counts nowhere; an empty table gives no rows. Only the columns named are
read, so other columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_rules() -> dict[str, Callable[[Column], Column]]:
    """The failure conditions of one text, by letter."""
    words = lambda t: F.array_remove(F.split(t, BLANKS), "")
    return {
        "A": lambda t: F.size(words(t)) < 50,
        "B": lambda t: F.size(F.array_distinct(words(t))) * 100 < F.size(words(t)) * 65,
        "C": lambda t: F.length(F.regexp_replace(t, "[^A-Z]+", "")) * 100 > F.length(t) * 5,
        "D": lambda t: t.rlike("[#$%&*|]"),
    }


def mask_counts(docs: DataFrame, labels: DataFrame, rules: dict | None = None, part: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): rows by part and failures; the bit after those of ``rules`` marks copies.

    Texts stay where they are read: only a digest and the mask go on. Rows meet their labels by id; then rows of one
    text fold into one a part and label before the smallest id of the text is sought.
    """
    rules = rules or text_rules()
    text = F.coalesce(F.col(text_col), F.lit(""))
    bits = sum(((fails(text)).cast("int") * (1 << k) for k, fails in enumerate(rules.values())), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), bits.alias("mask"))
    flag = lambda c: F.max((F.col(c) == 1).cast("int"))
    known = labels.groupBy(F.col(id_col).alias("id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    rows = rows.join(known, "id", "left").select("id", "part", "digest", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    rows = rows.groupBy("id", "part", "digest", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    of_text = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("id").alias("id"), F.min_by("n", "id").alias("n_first"), F.sum(F.when(F.col("id").isNull(), F.col("n"))).alias("n_none")
    )
    least = F.min("id").over(Window.partitionBy("digest"))  # a row a part, mask and label
    first = F.coalesce("n_none", F.lit(0)) + F.when(F.col("id") == F.col("least"), F.col("n_first")).otherwise(0)
    of_text = of_text.withColumn("least", least).withColumn("first", first)
    copy = F.lit(1 << len(rules))
    each = F.array(F.struct(F.col("mask").alias("mask"), F.col("first").alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - F.col("first")).alias("n")))
    each = of_text.select("part", "good", "toxic", F.explode(each).alias("x")).where("x.n > 0")
    n = F.col("x.n")
    return each.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def steps_of(filters: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """(mask, step, rank, kept, removed, redundant, unique): differences along the ranks of the orders of so many filters.

    The orders that begin with one prefix of length s are an interval of (filters - s)! ranks. A prefix keeps a mask that
    holds none of it, removes one that holds its last filter alone, and finds one redundant that holds the last and an
    earlier one. Intervals that meet cancel at the seam.
    """
    out = []
    for mask in range(1 << filters):
        for step in range(1, filters + 1):
            width = factorial(filters - step)
            change: dict[int, list[int]] = {}
            for k, prefix in enumerate(permutations(range(filters), step)):
                fails, early = mask >> prefix[-1] & 1, any(mask >> f & 1 for f in prefix[:-1])
                marks = (not fails and not early, fails and not early, fails and early, mask == 1 << prefix[-1])
                for rank, sign in ((k * width, 1), ((k + 1) * width, -1)):
                    at = change.setdefault(rank, [0] * 4)
                    for m, mark in enumerate(marks):
                        at[m] += sign * int(mark)
            out += [(mask, step, rank, *at) for rank, at in sorted(change.items()) if any(at) and rank < factorial(filters)]
    return out


def every_order(counts: DataFrame, letters: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from ``mask_counts``.

    Of each part come the steps of all orders, zeros included: factorial(n) * n rows, for at most 7 filters.
    """
    if not 1 <= len(letters) <= 7:
        raise ValueError("every order is reported for 1 to 7 filters")
    spark, orders = counts.sparkSession, ["".join(p) for p in permutations(letters)]
    steps = spark.createDataFrame(steps_of(len(letters)), "mask int, step int, rank int, kept long, removed long, redundant long, unique_fails long")
    n, removed = F.col("n"), F.col("removed")
    values = {m: F.col(m) * n for m in MEASURES[:4]} | {"good_lost": removed * F.col("good"), "toxic_lost": removed * F.col("toxic")}
    changes = counts.join(F.broadcast(steps), "mask").select("part", "step", "rank", *[v.alias(m) for m, v in values.items()])  # a list of fixed size
    grid = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    grid = grid.select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1))).alias("rank"), *[F.lit(0).cast("long").alias(m) for m in MEASURES])
    changes = changes.unionByName(grid).groupBy("part", "step", "rank").agg(*[F.sum(m).alias(m) for m in MEASURES])
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    order = F.element_at(F.array(*map(F.lit, orders)), F.col("rank") + 1)
    out = changes.select("part", order.alias("filter_order"), "step", *[F.sum(m).over(along).alias(m) for m in MEASURES])
    letter = F.substr("filter_order", F.col("step"), F.lit(1))
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", letter)))


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """The report of the five filters A to E over whole texts."""
    return every_order(mask_counts(docs, labels, part=part), "ABCDE")


ORACLE = r"""
WITH l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
      FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x(k, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT p.k || q.k || r.k || s.k || t.k AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits FROM x p, x q, x r, x s, x t WHERE p.b + q.b + r.b + s.b + t.b = 31 AND (p.b | q.b | r.b | s.b | t.b) = 31),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS b, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS early FROM o, range(1, 6) AS g(step)),
m AS (SELECT part, filter_order, step, b,
        sum(n) FILTER (mask & (b | early) = 0) AS kept, sum(n) FILTER (mask & b > 0 AND mask & early = 0) AS removed, sum(n) FILTER (mask & b > 0 AND mask & early > 0) AS redundant,
        sum(n) FILTER (mask = b) AS unique_fails, sum(good) FILTER (mask & b > 0 AND mask & early = 0) AS good_lost, sum(toxic) FILTER (mask & b > 0 AND mask & early = 0) AS toxic_lost
      FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, b), 0)::BIGINT AS shapley FROM m
"""
