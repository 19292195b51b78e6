"""Token counts for every context limit from one exact length histogram (operator 5).

Documents are encoded with a given byte-level BPE vocabulary and aggregated by encoded length. Sums over all longer
lengths then answer every question about a limit L exactly: documents that exceed it, tokens of all texts, tokens left
when texts are cut to L, and quantiles of the length.

The vocabulary's path is a parameter (``vocabulary``); it is read where the driver runs and sent to the executors, its
size does not depend on the corpus.

Defined cases: null and empty texts have length 0 and are counted; texts of any length are encoded whole; repeated rows
each count; an empty table gives an empty histogram, and its totals are 0 or null; other columns do not matter.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.operators.graph import cut, running_sums

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's rule for cutting text into pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_vocabulary(path: str) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}


def token_lengths(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds ``n_tokens``; a column of that name is replaced."""
    docs = docs.drop("n_tokens")
    ranks = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={})
        for b in batches:
            counts = [len(coder.encode_ordinary(t)) if t else 0 for t in b.column(names.index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(counts, pa.int64())], names=[*names, "n_tokens"])

    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType())])
    return docs.mapInArrow(run, schema)


def histogram(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row a length: n_tokens, n_docs, docs_above, tokens_above, tokens_total and truncated_total.

    ``truncated_total`` is what remains of the corpus when texts are cut to n_tokens. Limits between two lengths follow
    from the next shorter row, as ``at_limits`` does.
    """
    lengths = token_lengths(docs.select(F.col(text_col).cast("string").alias("text")), "text", vocabulary)
    counts = cut(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")))
    sums = {"docs_above": F.col("n_docs"), "tokens_above": F.col("n_docs") * F.col("n_tokens")}
    summed = running_sums(counts, [F.col("n_tokens").desc()], sums)
    total = counts.agg(F.sum(F.col("n_docs") * F.col("n_tokens")).alias("tokens_total"))
    out = summed.crossJoin(F.broadcast(total))  # one row
    return out.withColumn("truncated_total", F.col("tokens_total") - F.col("tokens_above") + F.col("n_tokens") * F.col("docs_above"))


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """For each limit: documents over it, tokens of all texts and tokens left when texts are cut to it."""
    spark = hist.sparkSession
    want = spark.createDataFrame([(int(x),) for x in limits], "context long")
    over = hist.join(F.broadcast(want), F.col("n_tokens") > F.col("context"))
    over = over.groupBy("context").agg(F.sum("n_docs").alias("docs_over"), F.sum(F.col("n_docs") * (F.col("n_tokens") - F.col("context"))).alias("lost"))
    total = hist.agg(F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")), F.lit(0)).alias("tokens_total"))
    out = want.join(over, "context", "left").crossJoin(F.broadcast(total))
    return out.select("context", F.coalesce("docs_over", F.lit(0)).alias("docs_over"), "tokens_total", (F.col("tokens_total") - F.coalesce("lost", F.lit(0))).alias("truncated_total"))


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """The smallest length that at least ``share`` of the documents do not exceed, for each share."""
    want = hist.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    n = hist.agg(F.sum("n_docs").alias("n"))
    up_to = hist.crossJoin(F.broadcast(n)).select("n_tokens", "n", (F.col("n") - F.col("docs_above")).alias("up_to"))
    return want.join(up_to, F.col("up_to") >= F.col("share") * F.col("n"), "left").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
