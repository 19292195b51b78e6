"""Approximate nearest neighbours by multiprobe p-stable hashing (operator 3).

Inner product is searched as Euclidean distance: vectors get one more coordinate that makes all norms equal, queries get
a zero there. A table hashes a vector by its projections on Gaussian (2-stable) directions, cut into steps of some width.
A query visits, over all tables, the perturbed buckets that are likeliest to hold its neighbours: a step of -1 or +1 in
some projections costs the squared distances from the query to the boundaries it crosses, and perturbations of all tables
are visited in order of that cost. Candidates of all tables are merged and reranked by the exact inner product in double
precision.

The number of projections, the width and the number of probes are fitted on a bounded sample of ``SAMPLE`` vectors (those
with the smallest id hashes): of ``SETTINGS``, each with the first number of probes that reaches ``TARGET`` recall against
brute force there, the one with the least work a query is taken. If none reaches it, every bucket is visited, as it is for
a query whose probes meet no more than k rows of a shard, so that each query gets its k.

Every row is indexed. Rows are dealt to shards of at most about ``SHARD_ROWS`` by the hash of their id, one task a shard,
so no bucket, however many vectors share it, makes a task larger; a vector moves once and a query once a shard. A shard
keeps the ``k + 1`` smallest ids of vectors that are equal in every component: with ties to the smaller id no other of
them can be among a query's k nearest, so nothing is lost.

Defined cases: vectors that are null, zero, or hold a null or a component that is not finite, and rows with a null id,
take no part, nor do vectors of another dimension than most of the sample (they have no inner product with the others);
with fewer than k candidates all are returned; ties go to the smaller id; rows that repeat an id count once (the smallest
vector of the id); empty tables give no rows.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.operators.graph import cut

TABLES = 4
#: (projections a table, width of a step for vectors of norm 1)
SETTINGS = ((4, 0.5), (4, 1.0), (4, 1.5), (4, 3.0), (6, 0.75), (6, 1.5))
SAMPLE = 6000
SAMPLE_QUERIES = 150
TARGET = 0.96
SHARD_ROWS = 200_000
#: Shards are not made smaller than this for the sake of more tasks.
LEAST_ROWS = 2000
#: A shard of so few rows is one bucket.
ONE_BUCKET = 256
#: What hashing one probe costs, in scores of one row.
PROBE_COST = 4
SCORES_AT_ONCE = 8_000_000


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v) of the vectors that take part."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kept = v if vectors.select(v).schema[0].dataType.simpleString() == "array<float>" else v.cast("array<double>")
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull()).where(fine)
    return rows.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(kept).alias("v"))


def lifted(x: np.ndarray, norm: float, query: bool) -> np.ndarray:
    """Vectors in units of ``norm`` with one more coordinate: zero for queries, which are scaled to 1, what is missing to 1
    for the others."""
    if query:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return np.concatenate([x, np.zeros((len(x), 1))], 1)
    x = x / (norm or 1.0)
    return np.concatenate([x, np.sqrt(np.maximum(1 - (x**2).sum(1), 0))[:, None]], 1)


def projections(x: np.ndarray, norm: float, query: bool, hashes: int, width: float, seed: int = 17) -> np.ndarray:
    """(rows, TABLES, hashes) projections in steps of ``width``."""
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(TABLES * hashes, x.shape[1] + 1)), rng.uniform(size=(TABLES, hashes))
    return (lifted(x, norm, query) @ a.T).reshape(-1, TABLES, hashes) / width + b


def bucket_ids(steps: np.ndarray) -> np.ndarray:
    """(rows, TABLES, moves) 64-bit numbers from integer steps (rows, TABLES, moves, hashes)."""
    h = np.arange(1, TABLES + 1, dtype=np.uint64)[None, :, None] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(steps.shape[-1]):
        h = (h ^ steps[..., k].astype(np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def own_buckets(p: np.ndarray) -> np.ndarray:
    """(rows, TABLES) bucket ids of projections."""
    return bucket_ids(np.floor(p)[:, :, None, :])[:, :, 0]


def probes(p: np.ndarray, count: int) -> np.ndarray:
    """(rows, count) bucket ids, likeliest first, from a query's projections (rows, TABLES, hashes)."""
    moves = np.array(list(product((0, 1, -1), repeat=p.shape[-1])))
    low = p - np.floor(p)
    price = np.stack([np.zeros_like(low), (1 - low) ** 2, low**2], -1)  # a move of -1 takes the last
    cost = sum(price[:, :, k, :][:, :, moves[:, k]] for k in range(p.shape[-1])).reshape(len(p), -1)
    ids = bucket_ids(np.floor(p)[:, :, None, :] + moves).reshape(len(p), -1)
    return np.take_along_axis(ids, np.argsort(cost, axis=1, kind="stable")[:, :count], 1)


def fit(sample: np.ndarray, queries: np.ndarray, norm: float, k: int, shard_rows: float) -> tuple[int, float, int] | None:
    """(hashes, width, probes) that reach TARGET recall on the sample with the least work, None if no setting does."""
    true = np.argsort(-(queries @ sample.T), axis=1, kind="stable")[:, : k + 1]
    best = None
    for hashes, width in SETTINGS:
        own = own_buckets(projections(sample, norm, False, hashes, width))
        want = probes(projections(queries, norm, True, hashes, width), TABLES * 3**hashes)
        place = np.empty((len(queries), len(sample)), np.int32)
        for q, ids in enumerate(want):
            order = np.argsort(ids, kind="stable")
            at = order[np.minimum(np.searchsorted(ids[order], own), len(ids) - 1)]
            place[q] = np.where(ids[at] == own, at, len(ids)).min(1)
        met = np.sort(np.take_along_axis(place, true, 1).ravel())
        last = met[int(np.ceil(TARGET * met.size)) - 1]
        if last == want.shape[1]:
            continue
        work = (place <= last).mean() * shard_rows + PROBE_COST * want.shape[1]
        if best is None or work < best[0]:
            best = work, (hashes, width, int(last) + 1)
    return best and best[1]


class Shard:
    """The buckets of a shard's vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, norm: float, k: int, fitted):
        same = np.unique(np.ascontiguousarray(x).view(f"V{x.shape[1] * x.itemsize}").ravel(), return_inverse=True)[1].ravel()
        order = np.lexsort((ids, same))
        new = np.flatnonzero(np.diff(same[order], prepend=-1))
        nth = np.arange(len(order)) - np.repeat(new, np.diff(new, append=len(order)))
        keep = order[nth <= k]  # of equal vectors the k + 1 smallest ids
        self.ids, self.x, self.norm, self.k = ids[keep], x[keep].astype(float), norm, k
        self.fitted = fitted if len(ids) > ONE_BUCKET else None
        if self.fitted:
            own = own_buckets(projections(self.x, norm, False, *fitted[:2]))
            self.buckets, inverse = np.unique(own, return_inverse=True)
            self.bucket_of = inverse.reshape(own.shape)
            self.rows = np.argsort(self.bucket_of, axis=None, kind="stable") // TABLES
            self.sizes = np.bincount(self.bucket_of.ravel())
            self.start = np.cumsum(self.sizes) - self.sizes
        self.at_once = int(max(8, min(256, SCORES_AT_ONCE // len(self.ids))))

    def nearest(self, qid: np.ndarray, q: np.ndarray):
        """(query_id, ids, scores) of each query's k best candidates, equal scores by id."""
        for lo in range(0, len(qid), self.at_once):
            yield from self._nearest(qid[lo : lo + self.at_once], q[lo : lo + self.at_once])

    def _nearest(self, qid: np.ndarray, q: np.ndarray):
        every = np.arange(len(self.ids))
        seen = np.ones((len(q), len(every)), bool)
        if self.fitted:
            want = probes(projections(q, self.norm, True, *self.fitted[:2]), self.fitted[2])
            at = np.minimum(np.searchsorted(self.buckets, want), len(self.buckets) - 1)
            met = self.buckets[at] == want
            # where queries visit much of a shard, one product of all is cheaper than gathering each query's rows
            if (self.sizes[at] * met).sum() * 8 > seen.size:
                visited = np.zeros((len(q), len(self.buckets)), bool)
                visited[np.nonzero(met)[0], at[met]] = True
                seen = np.logical_or.reduce([visited[:, self.bucket_of[:, t]] for t in range(TABLES)])
            else:
                for i in range(len(q)):
                    parts = [self.rows[lo : lo + n] for lo, n in zip(self.start[at[i][met[i]]], self.sizes[at[i][met[i]]], strict=True)]
                    rows = np.unique(np.concatenate(parts)) if parts else every[:0]
                    rows = rows if len(rows) > self.k else every
                    yield from self._best(qid[i], q[i], rows, self.x[rows] @ q[i])
                return
        seen[seen.sum(1) <= self.k] = True
        scores = q @ self.x.T
        for i in range(len(q)):
            yield from self._best(qid[i], q[i], every[seen[i]], scores[i][seen[i]])

    def _best(self, qid: int, q: np.ndarray, rows: np.ndarray, s: np.ndarray):
        other = self.ids[rows] != qid
        rows, s = rows[other], s[other]
        if len(rows):
            least = np.partition(s, -self.k)[-self.k] if len(s) > self.k else s.min()
            near = rows[s >= least - 1e-9 * (1 + abs(least))]
            exact = (self.x[near] * q).sum(1)
            order = np.lexsort((self.ids[near], -exact))[: self.k]
            yield int(qid), self.ids[near[order]], exact[order]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of ``vectors`` found for each of ``queries``, both (id, v)."""
    spark = vectors.sparkSession
    few = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas().v
    some = queries.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_QUERIES).select("v").toPandas().v
    if not len(few) or not len(some):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = int(np.bincount([len(v) for v in few]).argmax())
    vectors, queries = vectors.where(F.size("v") == dim), queries.where(F.size("v") == dim)
    stats = vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("m"), F.count("*").alias("n")).first()
    norm = float(np.sqrt(stats.m or 0.0))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-stats.n // SHARD_ROWS), min(tasks, stats.n // LEAST_ROWS))
    stack = lambda s: np.array([v for v in s if len(v) == dim], float).reshape(-1, dim)
    asked = stack(some)
    fitted = fit(stack(few), asked, norm, k, stats.n / shards) if len(asked) else None

    def find(batches):
        """One shard: its vectors come first, then the queries."""
        held, shard = [], None
        for b in batches:
            ids, side = b.column(1).to_numpy(), b.column(0).to_numpy()
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            if (side == 0).any():
                held.append((ids[side == 0], x[side == 0]))
            if held and shard is None and (side == 1).any():
                shard, held = Shard(*(np.concatenate(c) for c in zip(*held, strict=True)), norm, k, fitted), []
            if shard is not None:
                ids, x = ids[side == 1], x[side == 1].astype(float)
                rows = list(shard.nearest(ids, x))
                cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["query_id", "ids", "scores"])

    index = vectors.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("side"), "id", "v")
    every = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("side"), "id", "v")
    dealt = index.unionByName(every).repartitionById(shards, "shard").sortWithinPartitions("side").select("side", "id", "v")
    found = dealt.mapInArrow(find, "query_id long, ids array<long>, scores array<double>")

    def merge(batches):
        for b in batches:
            out = []
            for q, lists in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                score = {i: s for x in lists for i, s in zip(x["ids"], x["scores"], strict=True)}
                out += [(q, r + 1, i, s) for r, (i, s) in enumerate(sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k])]
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "rank", "vec_id", "score"])

    lists = found.groupBy("query_id").agg(F.collect_list(F.struct("ids", "scores")).alias("lists"))  # one short list a shard
    return lists.mapInArrow(merge, "query_id long, rank int, vec_id long, score double")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """Queries are the rows whose id is divisible by ``every``; candidates all rows but the query's own."""
    rows = cut(usable(vectors))
    return search(rows, rows.where(F.col("id") % every == 0), k)
