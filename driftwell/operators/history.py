"""Append-only history: text kept once and restored point-in-time, keyword revisions, events and generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions.keys import sha_prefix


def store_text_once(obs: DataFrame, keys: list[str], scan: str, ts: str, text: str = "text") -> DataFrame:
    """Observations with ``text_sha``, ``text`` only where the hash is new for the entity, else ``text_ref`` to its first holder."""
    w = Window.partitionBy(*keys, "text_sha").orderBy(ts, scan)
    o = obs.withColumn("text_sha", sha_prefix(F.col(text)))
    holder = F.first(scan).over(w)
    has = F.col(text).isNotNull() & (F.col(text) != "")
    return o.withColumn("text_ref", F.when(has & (holder != F.col(scan)), holder)).withColumn(text, F.when(has & (holder == F.col(scan)), F.col(text)))


def restore_text(obs: DataFrame, holders: DataFrame, keys: list[str], scan: str, ts: str, cutoff: Column) -> DataFrame:
    """``text`` and ``text_state``: stored, restored, empty, corrupt (hash differs) or future_ref (held only later than the cutoff)."""
    h = holders.where(F.col("text").isNotNull()).select(*keys, F.col(scan).alias("text_ref"), F.col("text").alias("_t"), F.col(ts).alias("_at"))
    j = obs.join(h, [*keys, "text_ref"], "left")
    state = (
        F.when(F.col("text").isNotNull(), F.when(sha_prefix(F.col("text")) == F.col("text_sha"), "stored").otherwise("corrupt"))
        .when(F.col("text_ref").isNull(), "empty").when(F.col("_t").isNull(), "corrupt").when(F.col("_at") >= cutoff, "future_ref")
        .when(sha_prefix(F.col("_t")) != F.col("text_sha"), "corrupt").otherwise("restored")
    )
    j = j.withColumn("text_state", state)
    return j.withColumn("text", F.when(F.col("text_state") == "stored", F.col("text")).when(F.col("text_state") == "restored", F.col("_t"))).drop("_t", "_at")


def revision_changes(revisions: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows with the value of the revision before and the size of the change."""
    w = Window.partitionBy(*keys).orderBy(order)
    return revisions.withColumn("before", F.lag(value).over(w)).withColumn("delta", F.col(value) - F.col("before"))


def last_direct_change(revisions: DataFrame, keys: list[str], order: str, value: str, origin: str = "origin") -> DataFrame:
    """The last change that did not come from feedback, against the revision just before it whatever its origin."""
    d = revision_changes(revisions, keys, order, value).where((F.col(origin) != "feedback") & (F.col("before").isNull() | (F.abs("delta") >= 0.005)))
    return d.groupBy(*keys).agg(F.max_by(value, order).alias("base"), F.max(order).alias("changed_at"))


def generations(events: DataFrame, keys: list[str], order: list[str], change: str = "change") -> DataFrame:
    """Each event with its generation (how often the key was added so far)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("generation", F.count_if(F.col(change) == "added").over(w))


def active(events: DataFrame, keys: list[str], order: list[str], change: str = "change") -> DataFrame:
    """Keys whose last event added them, with their generation."""
    last = events.groupBy(*keys).agg(F.max_by(change, F.struct(*order)).alias("last"), F.count_if(F.col(change) == "added").alias("generation"))
    return last.where("last = 'added'").drop("last")


def first_provenance(events: DataFrame, keys: list[str], ts: str, fields: list[str]) -> DataFrame:
    return events.groupBy(*keys).agg(F.min_by(F.struct(*fields), ts).alias("p")).select(*keys, "p.*")


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], value: str, least: float = 0.005) -> DataFrame:
    """added, removed and changed keys between two snapshots; changes under ``least`` do not count."""
    a = before.select(*keys, F.col(value).alias("before"), F.lit(True).alias("_a"))
    b = after.select(*keys, F.col(value).alias("after"), F.lit(True).alias("_b"))
    j = a.join(b, keys, "full_outer")
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.abs(F.col("after") - F.col("before")) >= least, "changed")
    return j.withColumn("change", kind).where("change is not null").drop("_a", "_b")


def snapshot_hash(rows: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """An order-free change detector of a set of rows: xor of row hashes and the count. No cryptographic id."""
    return rows.groupBy(*by).agg(F.bit_xor(F.xxhash64(*fields)).alias("content_hash"), F.count("*").alias("n"))


def small_snapshot_sha(rows: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """SHA-256 of the sorted rows of each group, for groups of bounded size such as a profile's keywords."""
    return rows.groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct(*fields)))), "\n"), 256).alias("content_sha"))


def apply_changes(keywords: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """A keyword set after (change: add, remove or set; weight) rows; weights are clamped to 0.35-2.0."""
    c = changes.select(*keys, "change", F.col("weight").alias("_w"))
    j = keywords.join(c, keys, "full_outer").where("change is null or change <> 'remove'")
    return j.withColumn("weight", F.when(F.col("_w").isNotNull(), F.least(F.greatest("_w", F.lit(0.35)), F.lit(2.0))).otherwise(F.col("weight"))).drop("_w", "change")


def next_revision(revisions: DataFrame, new: DataFrame, profile: str, expected: int | None) -> DataFrame:
    """``new`` as the next revision; raises if the table has moved past ``expected``."""
    now = revisions.where(F.col("profile_id") == profile).agg(F.coalesce(F.max("revision"), F.lit(0))).first()[0]
    if expected is not None and expected != now:
        raise ValueError(f"revision is {now}, expected {expected}")
    return revisions.unionByName(new.withColumn("revision", F.lit(now + 1).cast("int")), allowMissingColumns=True)


def rollback(revisions: DataFrame, profile: str, to: int) -> DataFrame:
    """An old state written as a new revision; history stays."""
    old = revisions.where((F.col("profile_id") == profile) & (F.col("revision") == to)).withColumn("origin", F.lit("rollback"))
    return next_revision(revisions, old.drop("revision"), profile, None)


def reconcile(active_now: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Events that make the event log agree with the current set."""
    a, c = active_now.select(*keys).withColumn("_a", F.lit(1)), current.select(*keys).distinct().withColumn("_c", F.lit(1))
    j = a.join(c, keys, "full_outer").where("_a is null or _c is null")
    return j.withColumn("change", F.when(F.col("_a").isNull(), "added").otherwise("removed")).drop("_a", "_c")
