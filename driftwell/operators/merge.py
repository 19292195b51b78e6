"""Union, duplicate merging and keyed writes: tables in, the table's next version out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions.keys import norm_title
from driftwell.operators.graph import connected_components


def _empty(c: Column, kind: str) -> Column:
    if kind.startswith("array"):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull() | (F.trim(c) == "") if kind == "string" else c.isNull()


def duplicate_groups(rows: DataFrame, key: str = "row_id", ident: str = "ident", title: str = "title") -> DataFrame:
    """(row_id, group_id): rows that share an id or a normalised title, directly or through others.

    Every row is tied to the smallest row of its id and to that of its title, never to all rows that share them.
    """
    t = rows.select(key, F.nullif(F.trim(ident), F.lit("")).alias("i"), F.nullif(norm_title(F.col(title)), F.lit("")).alias("t"))
    ties = None
    for c in ("i", "t"):
        known = t.where(F.col(c).isNotNull())
        part = known.join(known.groupBy(c).agg(F.min(key).alias("least")), c).select("least", key)
        ties = part if ties is None else ties.unionByName(part)
    groups = connected_components(ties, "least", key)
    return rows.select(key).join(groups.withColumnRenamed("node", key), key, "left").select(key, F.coalesce("component", key).alias("group_id"))


def merge_group(rows: DataFrame, group: str, order: list[str], unions: tuple[str, ...] = (), earliest: str | None = None) -> DataFrame:
    """One row a group: the first non-empty value in ``order`` for each column, unions for array columns, the earliest date.

    A number 0 is a value, null is none. ``min_by`` keeps one value a group, so hot groups aggregate on the map side.
    """
    rank = F.struct(*order)
    aggs = []
    for name, kind in rows.dtypes:
        c = F.col(name)
        if name == group:
            continue
        if name in unions:
            aggs.append(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(name))
        elif name == earliest:
            aggs.append(F.min(c).alias(name))
        else:
            aggs.append(F.min_by(F.when(~_empty(c, kind), c), F.when(~_empty(c, kind), rank)).alias(name))
    return rows.groupBy(group).agg(*aggs)


def dedupe_merge(rows: DataFrame, order: list[str], key: str = "row_id", **kw) -> DataFrame:
    groups = duplicate_groups(rows, key)
    return merge_group(rows.join(groups, key), "group_id", order, **kw)


def seeds_of(rows: DataFrame, key: str, seed: str) -> DataFrame:
    """Results of many queries as one row a key with the sorted set of queries that returned it."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(seed)).alias("seeds"))


def keyed_upsert(old: DataFrame, new: DataFrame, keys: list[str], overwrite=(), keep_non_null=(), keep_first=(), keep_least=(), at: str = "updated_at") -> DataFrame:
    """The table after ``new`` is written over ``old``: the latest row by ``at`` wins each key.

    ``overwrite`` columns come from the latest row, ``keep_non_null`` from the latest row that has a value, ``keep_first``
    from the earliest row, ``keep_least`` is the minimum. All are aggregates, one shuffle on the keys.
    """
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    when = F.struct(F.col(at), F.col("_new"))
    aggs = [F.max_by(c, when).alias(c) for c in overwrite]
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), when)).alias(c) for c in keep_non_null]
    aggs += [F.min_by(c, when).alias(c) for c in keep_first] + [F.min(c).alias(c) for c in keep_least]
    return both.groupBy(*keys).agg(*aggs, F.max(at).alias(at))


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old, keys, "left_anti"))


def append_once(old: DataFrame, new: DataFrame, keys: list[str] = ("scan_id", "paper_key")) -> DataFrame:
    """Appends a scan's rows; writing the same scan again changes nothing."""
    return insert_if_absent(old, new, list(keys))


def replace_entity(old: DataFrame, new: DataFrame, touched: DataFrame, key: str) -> DataFrame:
    """All rows of the touched entities are replaced by the new ones; an entity with no new row is cleared."""
    return old.join(touched.select(key).distinct(), key, "left_anti").unionByName(new.join(touched.select(key).distinct(), key, "left_semi"))


def close_run(open_run: DataFrame, closing: DataFrame, key: str = "scan_id") -> DataFrame:
    """Fills only the fields of a run that are still missing."""
    b = closing.select(key, *[F.col(c).alias(f"_{c}") for c in closing.columns if c != key])
    out = open_run.join(b, key, "left")
    return out.select(*[F.coalesce(c, f"_{c}").alias(c) if c != key and f"_{c}" in b.columns else F.col(c) for c in open_run.columns])


def validated_load(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, rejected with errors): a row is rejected by every rule that does not hold for it."""
    errors = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    marked = rows.withColumn("errors", errors)
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)


def all_or_nothing(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rows if every one of them passes; raises with up to five errors otherwise."""
    good, bad = validated_load(rows, rules)
    first = bad.limit(5).collect()
    if first:
        raise ValueError(f"rejected: {[r.asDict() for r in first]}")
    return good


def delivered_only(feedback: DataFrame, delivered: DataFrame, key: str = "paper_key") -> DataFrame:
    return feedback.join(delivered.select(key).distinct(), key, "left_semi")


def feedback_load(feedback: DataFrame, delivered: DataFrame, usefulness: list[str], support: list[str], keys: tuple[str, ...] = ("profile_id", "paper_key")) -> DataFrame:
    """Feedback rows with the ``reason`` they are rejected for, null if they load.

    Usefulness and support must be known values, a judged support needs a claim, and the entity must have been delivered
    to the profile. ``unassessed`` is the support that judges nothing.
    """
    known = F.col("usefulness").isin(usefulness) & F.col("support").isin([*support, "unassessed"])
    unclaimed = (F.col("support") != "unassessed") & (F.trim(F.coalesce("claim", F.lit(""))) == "")
    j = feedback.join(delivered.select(*keys).distinct().withColumn("_d", F.lit(True)), list(keys), "left")
    reason = F.when(~F.coalesce(known, F.lit(False)), "unknown_value").when(unclaimed, "claim_missing").when(F.col("_d").isNull(), "not_delivered")
    return j.withColumn("reason", reason).drop("_d")


def recent(rows: DataFrame, day: str, before: Column, days: int, limit: int | None = None, then: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the ``days`` days before a day, that day left out, newest first, then by ``then``."""
    out = rows.where((F.col(day) >= F.date_sub(before, days)) & (F.col(day) < before)).orderBy(F.desc(day), *then)
    return out if limit is None else out.limit(limit)


def not_delivered(papers: DataFrame, delivered: DataFrame, key: str = "paper_key") -> DataFrame:
    return papers.join(delivered.select(key).distinct(), key, "left_anti")


def backfill_delivered(old: DataFrame, summaries: DataFrame) -> DataFrame:
    """Delivered keys from summaries, under the id and the doi of each."""
    new = summaries.select(F.explode(F.array_compact(F.array(F.col("ident"), F.concat(F.lit("doi:"), F.lower("doi"))))).alias("paper_key"))
    return insert_if_absent(old.select("paper_key"), new, ["paper_key"])


def missing_today(wanted: DataFrame, have: DataFrame, key: str = "paper_key", day: str = "collected_on") -> DataFrame:
    """Entities without a snapshot of the day."""
    return wanted.join(have, [key, day], "left_anti")


def backlog(df: DataFrame, status: str, order: list, limit: int) -> DataFrame:
    """Rows never resolved, oldest first."""
    return df.where(F.col(status).isNull()).orderBy(*order).limit(limit)


def retention_plan(rows: DataFrame, day: str, as_of: Column, ttl_days: int, key: str, protected: DataFrame, holders: DataFrame | None = None) -> DataFrame:
    """Rows with ``action``: delete if older than the limit and neither protected nor a text that others refer to.

    Rows whose day can't be read stay.
    """
    old = F.coalesce(F.datediff(as_of, F.col(day)) > ttl_days, F.lit(False))
    out = rows.join(protected.select(F.col(key)).distinct().withColumn("_p", F.lit(True)), key, "left")
    if holders is not None:
        out = out.join(holders.select(F.col(key)).distinct().withColumn("_h", F.lit(True)), key, "left")
    else:
        out = out.withColumn("_h", F.lit(None).cast("boolean"))
    action = F.when(~old, "keep_recent").when(F.col("_p"), "keep_protected").when(F.col("_h"), "keep_holder").otherwise("delete")
    return out.withColumn("action", action).drop("_p", "_h")


def identify(items: DataFrame, official: DataFrame, second: DataFrame) -> DataFrame:
    """Items joined to an official record by id where titles agree, the second source for the rest."""
    from driftwell.functions.keys import title_match

    a = official.select("ident", F.col("title").alias("t1"))
    b = second.select("ident", F.col("title").alias("t2"))
    j = items.join(a, "ident", "left").join(b, "ident", "left")
    first, other = title_match(F.col("title"), F.col("t1")), title_match(F.col("title"), F.col("t2"))
    return j.withColumn("verified_by", F.when(first, "first").when(other, "second")).drop("t1", "t2")


def latest_state_as_rows(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
