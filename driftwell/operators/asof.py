"""Point-in-time joins: the latest row before, or up to, a moment; nothing that was observed later is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], unions: tuple[str, ...] = ()) -> DataFrame:
    """The row with the largest ``order`` of each key; ``unions`` array columns hold the union over all rows of the key.

    An aggregate, not a sort: hot keys combine on the map side.
    """
    rest = [c for c in df.columns if c not in keys]
    agg = [F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")]
    agg += [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(f"_u{c}") for c in unions]
    out = df.groupBy(*keys).agg(*agg)
    return out.select(*keys, *[F.col(f"_u{c}").alias(c) if c in unions else F.col(f"_r.{c}").alias(c) for c in rest])


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, value: Column, name: str, tie: str, strict: bool = True) -> DataFrame:
    """Adds ``name``: ``value`` of the right row with the latest time before (``strict``) or up to the left row's time.

    Both sides are laid together in one sort by key and time, and each left row takes the last right value above it; no
    pair of rows is formed. Ties in time go to the larger ``tie``; left rows without a match keep a null.
    """
    side = 0 if strict else 2  # a left row stands above (strict) or below equal right times
    r = right.select(*keys, F.col(right_ts).alias("_ts"), F.lit(1).alias("_side"), F.col(tie).alias("_tie"), value.alias("_v"), F.lit(True).alias("_has"))
    l = left.withColumn("_ts", F.col(left_ts)).withColumn("_side", F.lit(side)).withColumn("_tie", F.lit(None).cast(right.schema[tie].dataType))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_ts", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn(name, F.last(F.when(F.col("_has"), F.struct(F.col("_v"))), ignorenulls=True).over(w)["_v"])
    return got.where(F.col("_side") == side).select(*left.columns, name)


def value_with_fallback(asof: Column, earliest: Column) -> Column:
    """A snapshot before the window, else the earliest there is."""
    return F.coalesce(asof, earliest)


def previous_different(df: DataFrame, keys: list[str], ts: str, state: str) -> DataFrame:
    """For each row the last state of its key that differs from its own."""
    w = Window.partitionBy(*keys).orderBy(ts)
    changed = df.withColumn("_c", F.coalesce((F.lag(state).over(w) != F.col(state)).cast("int"), F.lit(0)))
    runs = changed.withColumn("_run", F.sum("_c").over(w))
    firsts = runs.groupBy(*keys, "_run").agg(F.first(state).alias("_s"))
    before = firsts.select(*keys, (F.col("_run") + 1).alias("_run"), F.col("_s").alias("previous_state"))
    return runs.join(before, [*keys, "_run"], "left").drop("_c", "_run")


def burst_flags(events: DataFrame, keys: list[str], ts: str, action: str, seconds: int, actions: int) -> DataFrame:
    """``burst``: within ``seconds`` around the event all of ``actions`` different actions of the key were seen."""
    w = Window.partitionBy(*keys).orderBy(F.unix_micros(F.col(ts).cast("timestamp")))
    back, ahead = -seconds * 1_000_000, seconds * 1_000_000
    kinds = F.size(F.collect_set(action).over(w.rangeBetween(back, 0)))
    closing = events.withColumn("_closes", kinds >= actions)
    return closing.withColumn("burst", F.max("_closes").over(w.rangeBetween(0, ahead))).drop("_closes")


def priority_lookup(items: DataFrame, table: DataFrame, by: list[tuple[str, str]], value: str) -> DataFrame:
    """The value by the first of several keys that finds one; a key that is not unique in the table does not count."""
    out, found = items, []
    for k, (mine, theirs) in enumerate(by):
        one = table.where(F.col(theirs).isNotNull()).groupBy(F.col(theirs).alias(mine)).agg(F.count("*").alias("_n"), F.first(value).alias(f"_v{k}")).where("_n = 1").drop("_n")
        out = out.join(one, mine, "left")
        found.append(F.col(f"_v{k}"))
    return out.withColumn(value, F.coalesce(*found)).drop(*[f"_v{k}" for k in range(len(by))])


def attach_dates(rows: DataFrame, seen: DataFrame, summarised: DataFrame, key: str = "paper_key") -> DataFrame:
    return rows.join(seen.groupBy(key).agg(F.min("seen_at").alias("first_seen")), key, "left").join(summarised.groupBy(key).agg(F.min("at").alias("summarised_at")), key, "left")


def changed_since_sent(now: DataFrame, sent: DataFrame, keys: list[str], axes: list[str], limit: int = 10, order: str = "paper_key", urgent: Column | None = None) -> DataFrame:
    """Entities whose state differs from the last one sent to a reader, with the axes that changed and their place.

    An entity that was never sent has changed in all axes. Of a reader's changes the ``urgent`` ones come first, then those
    of entities sent before, then by ``order``; the first ``limit`` are kept.
    """
    s = sent.select(*keys, *[F.col(a).alias(f"_{a}") for a in axes], F.lit(True).alias("_sent"))
    j = now.join(s, keys, "left")
    new = F.col("_sent").isNull()
    diff = F.array_compact(F.array(*[F.when(new | ~F.col(a).eqNullSafe(F.col(f"_{a}")), F.lit(a)) for a in axes]))
    by = [] if urgent is None else [F.coalesce(urgent, F.lit(False)).desc()]
    w = Window.partitionBy([k for k in keys if k != order]).orderBy(*by, new.asc(), F.col(order).asc())
    out = j.withColumn("changed", diff).where(F.size("changed") > 0).withColumn("place", F.row_number().over(w))
    return out.where(F.col("place") <= limit).drop("_sent", *[f"_{a}" for a in axes])


def pending_changes(rows: DataFrame, keys: list[str], axes: list[str], at: str = "at") -> DataFrame:
    """(keys, changed, first) from rows of kind ``state`` and ``sent`` with a map of axes: what each reader has not seen yet.

    Of each kind the newest row counts, of two at one time the one whose sorted values are larger; see ``change_notices``.
    """
    order = F.struct(F.col(at), F.transform(F.array_sort(F.map_entries(F.coalesce("axes", F.create_map().cast("map<string,string>")))), lambda e: F.struct(e["key"], F.coalesce(F.concat(F.lit("'"), e["value"]), F.lit("")))))
    newest = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("axes")), F.when(F.col("kind") == kind, order))
    g = rows.groupBy(*keys).agg(newest("state").alias("_now"), newest("sent").alias("_sent"), F.count_if(F.col("kind") == "state").alias("_n"), F.count_if(F.col("kind") == "sent").alias("_m"))
    first = F.col("_m") == 0
    diff = F.array_compact(F.array(*[F.when(first | ~F.col("_now")[a].eqNullSafe(F.col("_sent")[a]), F.lit(a)) for a in axes]))
    return g.where("_n > 0").select(*keys, diff.alias("changed"), first.alias("first")).where(F.size("changed") > 0)
