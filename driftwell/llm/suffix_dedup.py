"""Removal of repeated 200-byte strings by a difference-cover suffix order (operator 8).

The textbook algorithm sorts the suffixes at a difference-cover sample of positions by short tuples, names the tuples,
recurses on names, sorts the remaining suffixes by a few characters and the name of the sampled suffix behind them, and
compares neighbours. Here only the order up to 200 bytes matters, so recursion ends early, and only equality of
neighbours matters, so a name may be a fingerprint instead of a rank: the name of a tuple of names is their polynomial
sum, taken for every position from one running sum over the text, and needs no sort of its own. What stays global:

1. Sample: positions whose offset in their text, modulo 133, lies in a perfect difference set of 12 residues. For any two
   positions i and j there is a d < 133 with i + d and j + d both in the sample, so two equal 200-byte strings hold equal
   68-byte strings at sampled positions. Sampled names are sorted by range over the cluster and neighbours compared.
2. Remaining: the positions whose next sampled positions include one with an equal neighbour, and no others, can start a
   repeated string. Their names of 200 bytes are sorted by range over the cluster and neighbours compared.

Texts are written once as chunks with fixed ids, so the answer to a chunk is one bit for each key it sent, in order, and
positions never travel. Equal keys of one map task are sent once with their count, so a passage that a third of all
documents hold costs one key a task.

Names have 64 bits: among n compared positions, n^2 / 2^65 pairs of different strings are expected to be taken for equal
(0.001 at 2e8 positions).

Defined cases: null text is empty: 0 bytes, nothing removed, hash of nothing; texts under 200 bytes keep all; a repeat
inside one text counts, overlapping or not; rows that repeat a doc_id or a text are texts of their own, so whole copies
of 200 bytes or more are removed entirely; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.blobs import bucket_edges, pack_small, pack_sorted, rows_by_key, squeeze, unpack_small, unpack_sorted, unsqueeze
from driftwell.llm.tokens import mix
from driftwell.operators.graph import cut, release

LENGTH = 200
PERIOD = 133
TUPLE = LENGTH - PERIOD + 1
#: A perfect difference set modulo 133; every residue but 0 is the difference of exactly one pair.
COVER = np.array([0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109])
CHUNK_BYTES = 4_000_000
SAMPLE_BITS = 40
_U = np.uint64
_BYTE = np.random.default_rng(11).integers(1, 2**63, 256).astype(_U) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15


def names(run: np.ndarray, length: int) -> np.ndarray:
    """The 64-bit name of the ``length`` bytes from every position that has as many behind it."""
    n = len(run)
    if n < length:
        return np.zeros(0, _U)
    up = np.cumprod(np.concatenate([[_U(1)], np.full(n - 1, _BASE, _U)]))
    down = np.cumprod(np.concatenate([[_U(1)], np.full(n - length, pow(_BASE, -1, 2**64), _U)]))
    sums = np.concatenate([[_U(0)], np.cumsum(_BYTE[run] * up)])
    return mix((sums[length:] - sums[:-length]) * down)


def _chunks(docs: DataFrame) -> DataFrame:
    """(chunk, ids, lengths, bytes): runs of documents with ids of their own, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def flush():
            data = squeeze(b"".join(texts))
            cols = [pa.array([(task << 32) | k], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["chunk", "ids", "lengths", "data"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = (t or "").encode("utf-8", "surrogatepass")
                if ids and size + len(t) > CHUNK_BYTES:
                    yield flush()
                    ids, texts, size, k = [], [], 0, k + 1
                ids.append(i)
                texts.append(t)
                size += len(t)
        if ids:
            yield flush()

    return docs.mapInArrow(run, "chunk long, ids array<long>, lengths array<long>, data binary")


def _starts_in_text(lengths: np.ndarray, span: int, total: int) -> np.ndarray:
    """True where ``span`` bytes fit between a position and the end of its text."""
    ends = np.repeat(np.cumsum(lengths), lengths)
    return ends - np.arange(total) >= span


def _sample_keys(data: np.ndarray, lengths: np.ndarray, residues: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, names) of the sampled positions."""
    first = np.cumsum(lengths) - lengths
    chosen = np.zeros(PERIOD, bool)
    chosen[residues] = True
    offset = np.arange(len(data)) - np.repeat(first, lengths)
    at = np.flatnonzero(chosen[offset % PERIOD] & _starts_in_text(lengths, TUPLE, len(data)))
    return at, names(data, TUPLE)[at] >> _U(64 - SAMPLE_BITS) if len(at) else np.zeros(0, _U)


def _remaining_keys(data: np.ndarray, lengths: np.ndarray, sample: np.ndarray, equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, names) of the positions within PERIOD before a sampled position with an equal neighbour."""
    near = np.zeros(len(data) + 1, np.int32)
    hits = sample[equal]
    np.add.at(near, np.maximum(hits - PERIOD + 1, 0), 1)
    np.add.at(near, hits + 1, -1)
    at = np.flatnonzero((np.cumsum(near)[:-1] > 0) & _starts_in_text(lengths, LENGTH, len(data)))
    return at, names(data, LENGTH)[at] if len(at) else np.zeros(0, _U)


def _mark(chunks: DataFrame, keys_of, columns: list[str], bits: int) -> DataFrame:
    """(chunk, bits): for the keys that ``keys_of`` gives for a chunk, whether another position anywhere has the same key."""
    nb = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def send(batches):
        for b in batches:
            for row in b.to_pylist():
                keys, counts = np.unique(keys_of(row)[1], return_counts=True)
                edges = bucket_edges(keys, nb, bits)
                full = [k for k in range(nb) if edges[k + 1] > edges[k]]
                if full:
                    parts = [slice(edges[k], edges[k + 1]) for k in full]
                    cols = [pa.array(full, pa.int32()), pa.array([row["chunk"]] * len(full), pa.int64()), pa.array([pack_sorted(keys[p]) for p in parts], pa.binary()), pa.array([pack_small(np.minimum(counts[p], 2)) for p in parts], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["bucket", "chunk", "keys", "counts"])

    def compare(batches):
        for k, parts in rows_by_key(batches):
            owners = [p[0] for p in parts]
            keys = [unpack_sorted(p[1]) for p in parts]
            sizes = [len(x) for x in keys]
            keys, counts = np.concatenate(keys), np.concatenate([unpack_small(p[2]) for p in parts])
            order = np.argsort(keys, kind="stable")
            ranked = keys[order]
            same = ranked[1:] == ranked[:-1]
            repeated = counts[order] > 1
            repeated[1:] |= same
            repeated[:-1] |= same
            back = np.empty(len(keys), bool)
            back[order] = repeated
            out = [np.packbits(x).tobytes() for x in np.split(back, np.cumsum(sizes)[:-1])]
            for lo in range(0, len(out), 256):
                hi = min(lo + 256, len(out))
                yield pa.RecordBatch.from_arrays([pa.array(owners[lo:hi], pa.int64()), pa.array([k] * (hi - lo), pa.int32()), pa.array(out[lo:hi], pa.binary())], names=["chunk", "bucket", "bits"])

    sent = chunks.select("chunk", *columns).mapInArrow(send, "bucket int, chunk long, keys binary, counts binary")
    back = sent.repartition(nb, "bucket").sortWithinPartitions("bucket").mapInArrow(compare, "chunk long, bucket int, bits binary")
    return back.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "bits"))).alias("answers"))


def _flags(keys: np.ndarray, answers: list, buckets: int, bits: int) -> np.ndarray:
    """The answers of all buckets, back in the order of ``keys``."""
    uniq, inverse = np.unique(keys, return_inverse=True)
    edges = bucket_edges(uniq, buckets, bits)
    flags = np.zeros(len(uniq), bool)
    for a in answers or []:
        lo, hi = edges[a["bucket"]], edges[a["bucket"] + 1]
        flags[lo:hi] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=hi - lo).astype(bool)
    return flags[inverse]


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_only: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, unless ``digest_only``, kept (the bytes that stay)."""
    spark = docs.sparkSession
    nb, residues = int(spark.conf.get("spark.sql.shuffle.partitions")), COVER
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # dealt by chunk and written once; from here on only keys and answers move
    chunks = cut(_chunks(texts).repartition(nb, "chunk"), fresh=True, placed=True)

    def opened(row):
        return np.frombuffer(unsqueeze(row["data"]), np.uint8), np.array(row["lengths"], np.int64)

    def sampled(row):
        return _sample_keys(*opened(row), residues)

    def remaining(row):
        data, lengths = opened(row)
        at, keys = _sample_keys(data, lengths, residues)
        return _remaining_keys(data, lengths, at, _flags(keys, row["answers"], nb, SAMPLE_BITS))

    first = cut(_mark(chunks, sampled, ["lengths", "data"], SAMPLE_BITS), fresh=True)
    chunks = chunks.join(first.hint("shuffle_hash"), "chunk", "left")
    second = cut(_mark(chunks, remaining, ["lengths", "data", "answers"], 64), fresh=True).withColumnRenamed("answers", "final")
    release(spark)

    def finish(batches):
        for b in batches:
            for row in b.to_pylist():
                data, lengths = opened(row)
                at, keys = remaining(row)
                starts = at[_flags(keys, row["final"], nb, 64)] if len(at) else at
                cover = np.zeros(len(data) + 1, np.int32)
                cover[starts] += 1
                np.add.at(cover, starts + LENGTH, -1)
                gone = np.cumsum(cover)[:-1] > 0
                out, lo = [], 0
                for i, n in zip(row["ids"], lengths.tolist(), strict=True):
                    g, d = gone[lo : lo + n], data[lo : lo + n]
                    kept = d[~g].tobytes()
                    out.append((i, n, int(g.sum()), int(np.count_nonzero(np.diff(g.astype(np.int8), prepend=0) == 1)), hashlib.sha256(kept).hexdigest(), None if digest_only else kept))
                    lo += n
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = chunks.join(second.hint("shuffle_hash"), "chunk", "left").mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done.drop("kept") if digest_only else done
