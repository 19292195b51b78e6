"""The stateful forms of the library's operators as Structured Streaming.

Streams take late rows up to a watermark, drop repeats within it, and write through ``foreachBatch`` with writes that may
be repeated: a batch that runs again leaves the table as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.operators.graph import checkpoint_dir
from driftwell.operators.match import match_keywords
from driftwell.operators.merge import keyed_upsert


def read_files(spark: SparkSession, path: str, schema: str, per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    return r.parquet(path)


def deduplicated(stream: DataFrame, ts: str, key: str, lateness: str = "5 days") -> DataFrame:
    """Rows once for each key, however often the lagging source repeats them within the lateness."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def tumbling_counts(stream: DataFrame, ts: str, key: str, size: str = "7 days", lateness: str = "5 days") -> DataFrame:
    w = stream.withWatermark(ts, lateness).groupBy(F.window(ts, size), key).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("window_start"), key, "n")


def sliding_counts(stream: DataFrame, ts: str, key: str, size: str = "28 days", step: str = "1 day", lateness: str = "5 days") -> DataFrame:
    w = stream.withWatermark(ts, lateness).groupBy(F.window(ts, size, step), key).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("window_start"), key, "n")


def sessions(stream: DataFrame, ts: str, key: str, gap: str = "1 hour", lateness: str = "5 days") -> DataFrame:
    w = stream.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return w.select(F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), key, "n")


def matched(stream: DataFrame, keywords: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """New documents against the current keyword table; one row a document and keyword, as ``match_keywords`` finds them.

    Stateless: the keywords, a profile's short list, travel with each document as one array; the beginning of a keyword's
    first word is looked for before its regex, and what is found is exploded. No shuffle and no state.
    """
    fields = ["profile_id", "keyword", "kind", "weight", "pattern", "guard"]
    start = F.element_at(F.filter(F.split(F.lower("keyword"), r"[^\p{L}\p{N}]+"), lambda x: x != ""), 1)
    short = F.substr(start, F.lit(1), F.greatest(F.length(start) - 1, F.lit(1)))  # plurals may change the last letter
    lists = keywords.select(F.struct(*fields, short.alias("start")).alias("k")).agg(F.collect_set("k").alias("_keywords"))
    text = F.col(text_col)

    def hit(k):
        ok = F.contains(F.lower(text), k["start"]) & F.regexp_like(text, k["pattern"])
        return ok & (k["guard"].isNull() | F.regexp_like(text, k["guard"]))

    rows = stream.select(id_col, text_col).crossJoin(F.broadcast(lists))  # one row
    return rows.select(id_col, F.explode(F.filter("_keywords", hit)).alias("k")).select(id_col, *[f"k.{c}" for c in fields[:4]])


def upsert_sink(path: str, keys: list[str], at: str, **policy):
    """A ``foreachBatch`` function that keeps one row a key in the table at ``path``; versions make repeats harmless."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        done = [int(v) for v in _versions(spark, path)]
        if epoch in done:
            return
        old = spark.read.parquet(f"{path}/{max(done)}") if done else batch.limit(0).select(*keys, *sum((list(v) for v in policy.values()), []), at)
        keyed_upsert(old, batch, keys, at=at, **policy).write.parquet(f"{path}/{epoch}")

    return write


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _versions(spark: SparkSession, path: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return [n for n in names if n.isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{max(int(v) for v in _versions(spark, path))}")


def once_a_day_sink(path: str, keys: list[str]):
    """A ``foreachBatch`` function that appends a batch's rows for keys (such as profile and operating day) not yet written."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys)
        if _exists(spark, f"{path}/_SUCCESS"):
            new = new.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
        new.write.mode("append").parquet(path)

    return write


def run_to_table(stream: DataFrame, mode: str = "complete", at: str | None = None) -> DataFrame:
    """Runs a stream over what is there (availableNow) and returns the table it leaves in the shared folder.

    In ``update`` mode the rows carry the batch that wrote them in ``_epoch``, so that the newest of a key can be told.
    ``at`` names the stream's folder, where a later call goes on from its checkpoint; without it each call begins anew.
    """
    spark = stream.sparkSession
    at = at or f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        (batch.withColumn("_epoch", F.lit(epoch)) if mode == "update" else batch).write.mode("overwrite").parquet(f"{at}/table/{epoch}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return latest_version(spark, f"{at}/table") if mode == "complete" else spark.read.parquet(f"{at}/table/*")


def observe_sink(path: str, keywords: DataFrame):
    """A ``foreachBatch`` function that writes a batch's matches as the observations of its epoch, by the batch equi-join."""

    def write(batch: DataFrame, epoch: int) -> None:
        match_keywords(batch, keywords).write.mode("overwrite").parquet(f"{path}/{epoch}")

    return write
