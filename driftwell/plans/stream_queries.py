"""Registered queries that run as streams, each beside the DuckDB SQL of what it leaves behind."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftwell.operators.graph import checkpoint_dir
from driftwell.plans.queries import EVENTS, query, table
from driftwell.sources import paged
from driftwell.streaming import stateful, streams

_BASE = "2024-01-01 00:00:00"
_PRESSES = {"view": "more", "click": "useful", "purchase": "out", "signup": "undo", "error": "useful"}


@query(f"""WITH d AS (SELECT event_id, user_id AS tid, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _PRESSES.items())} END AS action,
  make_timestamp(epoch_us(TIMESTAMP '{_BASE}') + (epoch_us(ts) - epoch_us(TIMESTAMP '{_BASE}')) // 2000) AS tm FROM events),
k AS (SELECT c_custkey AS tid, TIMESTAMP '{_BASE}' + INTERVAL 1 MINUTE * (c_custkey % 5) AS delivered FROM customer WHERE c_custkey % 10 > 0),
f AS (SELECT d.*, delivered, delivered + INTERVAL 15 MINUTE AS expires, row_number() OVER (PARTITION BY tid, action, tm ORDER BY lpad(event_id::VARCHAR, 20, '0')) > 1 AS dup FROM d LEFT JOIN k USING (tid)),
s AS (SELECT *, CASE WHEN dup THEN 'duplicate' WHEN delivered IS NULL THEN 'unknown' WHEN tm > expires THEN 'expired' WHEN action = 'undo' THEN 'undo' WHEN tm >= delivered AND tm < delivered + INTERVAL 2 MINUTE THEN 'prefetch' ELSE 'valid' END AS first FROM f),
c AS (SELECT a.event_id, a.tid, a.tm FROM s a JOIN s b ON a.tid = b.tid AND b.first IN ('valid', 'prefetch') AND b.tm <= a.tm AND b.tm >= a.tm - INTERVAL 30 SECOND WHERE a.first = 'valid' GROUP BY ALL HAVING count(DISTINCT b.action) >= 3),
u AS (SELECT tid, max(tm) AS undone FROM s WHERE first = 'undo' GROUP BY tid)
SELECT event_id, CASE WHEN first IN ('valid', 'prefetch') AND EXISTS (SELECT 1 FROM c WHERE c.tid = s.tid AND c.tm >= s.tm AND c.tm <= s.tm + INTERVAL 30 SECOND) THEN 'burst' WHEN first = 'valid' AND undone >= tm THEN 'cancelled' ELSE first END AS status FROM s LEFT JOIN u USING (tid)""")
def stream_reaction_states(spark, sf_dir):
    """The events as presses of tokens, the month told in 22 minutes so that presses come close together."""
    own = stateful.stateful_session(spark)
    base, minutes = F.lit(_BASE).cast("timestamp"), lambda n: F.make_dt_interval(mins=n.cast("int"))
    e = streams.read_files(own, f"{sf_dir}/events.parquet*", EVENTS)
    at = F.timestamp_micros(F.unix_micros(base) + F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(base)) / 2000))
    action = F.create_map(*[F.lit(x) for kv in _PRESSES.items() for x in kv])[F.col("event_type")]
    e = e.select(F.lpad(F.col("event_id").cast("string"), 20, "0").alias("event_id"), F.col("user_id").alias("tid"), action.alias("action"), at.alias("received_at"))
    t = table(own, sf_dir, "customer").where("c_custkey % 10 > 0").select(F.col("c_custkey").alias("tid"), (base + minutes(F.col("c_custkey") % 5)).alias("delivered_at"))
    t = t.withColumn("expires_at", F.col("delivered_at") + F.expr("interval 15 minutes"))
    out = streams.run_to_table(stateful.reaction_stream(e, t, "1 day"), "update")
    return stateful.last_states(out, "event_id").select(F.col("event_id").cast("long").alias("event_id"), "status")


@query("""WITH d AS (SELECT user_id, (props->>'$.k')::INT % 5 AS item, event_type = 'signup' AS sent, ts, {'k': ((props->>'$.k')::INT // 20)::VARCHAR, 'band': floor(value / 10)::BIGINT::VARCHAR} AS axes FROM events),
g AS (SELECT user_id, item, arg_max(axes, ts) FILTER (NOT sent) AS now, arg_max(axes, ts) FILTER (sent) AS told FROM d GROUP BY ALL)
SELECT user_id, item, concat_ws(',', CASE WHEN told IS NULL OR now.k <> told.k THEN 'k' END, CASE WHEN told IS NULL OR now.band <> told.band THEN 'band' END) AS changed, told IS NULL AS first
FROM g WHERE now IS NOT NULL AND (told IS NULL OR now.k <> told.k OR now.band <> told.band)""")
def stream_change_notices(spark, sf_dir):
    """What each user has not acknowledged of the items' states; signups acknowledge what they carry."""
    own = stateful.stateful_session(spark)
    k = F.get_json_object("props", "$.k").cast("int")
    axes = F.create_map(F.lit("k"), F.floor(k / 20).cast("string"), F.lit("band"), F.floor(F.col("value") / 10).cast("string"))
    e = streams.read_files(own, f"{sf_dir}/events.parquet*", EVENTS)
    e = e.select("user_id", (k % 5).alias("item"), F.when(F.col("event_type") == "signup", "sent").otherwise("state").alias("kind"), F.col("ts").cast("timestamp").alias("at"), axes.alias("axes"))
    out = streams.run_to_table(stateful.change_notices(e, ["user_id", "item"], ["k", "band"]), "update")
    out = stateful.last_states(out, ["user_id", "item"]).where(F.size("changed") > 0)
    return out.select("user_id", "item", F.array_join("changed", ",").alias("changed"), "first")


@query("SELECT event_id, 1 AS times FROM events")
def paged_scan(spark, sf_dir):
    """The events as a feed of pages: a first run on the older two thirds ends early, later ones find newer and skipped ones."""
    events = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("_at"), "event_id")
    events = events.select(F.concat_ws("|", "_at", F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("key"), "event_id")
    at = f"{checkpoint_dir(spark)}/feed-{uuid.uuid4().hex}"
    size = max(1, -(-events.count() // 12))
    old = F.col("key") < "2024-01-20"
    land = lambda part: part.repartitionByRange(4, "key").sortWithinPartitions("key").write.mode("append").parquet(f"{at}/pages")

    def run() -> str:
        feed = paged.paged_feed(spark, paged.LandedPages(f"{at}/pages"), "key string, event_id long", page_size=size, max_pages=5)
        q = feed.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return paged.run_status(q)["status"]

    land(events.where(old))
    run()
    land(events.where(~old))
    while run() != "done":
        pass
    return spark.read.parquet(f"{at}/out").groupBy("event_id").agg(F.count("*").cast("int").alias("times"))


@query("""WITH p AS (SELECT event_type AS source, event_id, CASE WHEN event_id % 50 > 0 THEN ts END AS published, (row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) - 1) // 40 AS page FROM events),
g AS (SELECT source, page, count(*) AS n, count(*) FILTER (published < TIMESTAMP '2024-01-26') AS old FROM p GROUP BY ALL), s AS (SELECT source, min(page) FILTER (old > 0 OR n < 40) AS stop, max(page) AS last FROM g GROUP BY source),
r AS (SELECT source, CASE WHEN coalesce(stop + 1, last + 2) <= 9 THEN 'done' ELSE 'partial' END AS status, least(coalesce(stop + 1, last + 1), 9)::INT AS pages_used FROM s)
SELECT source, status, pages_used, count(event_id) AS kept, min(published) AS oldest FROM r LEFT JOIN p USING (source) WHERE page < pages_used AND coalesce(published >= TIMESTAMP '2024-01-26', true) GROUP BY ALL""")
def page_scans(spark, sf_dir):
    """Pages of 40 events a type, newest first, back to the 26th in at most nine pages; every fiftieth event is undated."""
    e = table(spark, sf_dir, "events")
    page = F.floor((F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("ts"), "event_id")) - 1) / 40)
    records = e.select(F.col("event_type").alias("source"), "event_id", F.when(F.col("event_id") % 50 > 0, F.col("ts")).alias("published"), page.alias("page"))
    kept, runs = paged.scan_pages(records, F.lit("2024-01-26").cast("timestamp"), 40, 9)
    n = kept.groupBy("source").agg(F.count("*").alias("kept"), F.min("published").alias("oldest"))
    return runs.join(n, "source").select("source", "status", "pages_used", "kept", "oldest")
