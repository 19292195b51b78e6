"""Benchmark decontamination by CGK embedding, bit sampling and exact edit verification (operator 6).

A document leaks an item if some run of its words is within ``MAX_EDITS`` (20 %) word edits of the item's words, case of
A-Z aside; items of fewer than ``MIN_WORDS`` words must be met exactly.

1. Embedding: the random walk of Chakraborty, Goldenberg and Koucky reads a window word by word and, at every step, stays
   or moves on by a bit that depends on the word it stands on. Two windows a few edits apart fall back into step, so their
   walks differ in few places. Every window of a text and of an item is walked, one from each word; a walk does not
   depend on how long its window is, so one walk serves items of all sizes.
2. Bit sampling: a key is what the walk shows at ``SAMPLED`` of its ``STEPS`` steps; keys whose walk has moved on less than
   ``SAMPLED`` - 1 words say too little and are left out on both sides. ``REPEATS`` independent walks are sampled. Since an
   item is walked from each of its words, a leak has many windows to meet; sampling far into an item-sized window instead
   would need hundreds of repeats at 20 % edits.
3. A window of a text that meets an item's key votes for where the item would start. Places within the edit budget of each
   other are one candidate; it needs ``votes(n)`` votes. ``repeats_for`` gives the repeats that a target recall takes.
4. Exact verification: all starts that a candidate allows are aligned with the item at once. Every row reported is exact;
   only a leak that no candidate proposes is missed (recall is stated in the README and tested at the full edit budget).

Items are a stated query set: they go to the executors in blocks of at most ``BLOCK`` items and ``BLOCK_CHARS`` characters,
each block against all documents.

Defined cases: null or empty texts and items match nothing; texts are read whole; repeated rows each report; a null
doc_id is reported as null; several leaks of one item in one document count as its best one; empty tables give no rows;
other columns, whatever their names, pass through ``drop_leaks`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.llm.tokens import mix, sub_batches, unused, words

MAX_EDITS = 0.2
MIN_WORDS = 8
STEPS = 5
SAMPLED = 3
REPEATS = 4
BLOCK = 20_000
BLOCK_CHARS = 16_000_000
_U = np.uint64
_TABLE_BITS = 20
_ANSWER = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start_word", T.LongType()), T.StructField("edits", T.IntegerType())]))

#: One block of items ready for lookups: ids, seqs, table, keys, key_item, key_at, key_walk, short.
Items = SimpleNamespace


def allowed(n: int) -> int:
    return int(MAX_EDITS * n) if n >= MIN_WORDS else 0


def votes(n: int) -> int:
    """The votes that a candidate for an item of n words needs: far fewer than leaks at the full edit budget have."""
    return 1 if n < MIN_WORDS else max(2, n * REPEATS // 24)


def repeats_for(target: float, one: float) -> int:
    """How many independent walks find a leak with probability ``target`` if one finds it with probability ``one``."""
    return max(1, ceil(log(1 - target) / log(1 - one))) if one < 1 else 1


def sampled_steps(walk: int) -> list[int]:
    """The steps that a walk shows: the first, the last and others between them."""
    between = np.random.default_rng(walk + 1).permutation(np.arange(1, STEPS - 1))[: SAMPLED - 2]
    return sorted({0, STEPS - 1, *between.tolist()})


def embed(h: np.ndarray, walk: int, steps: int = STEPS) -> np.ndarray:
    """(steps, len(h)) positions of the CGK walk that starts at each word of ``h``; past the end it stands still."""
    bits = np.append(mix(h ^ mix(np.array([walk + 1], _U))), _U(0))
    at = np.empty((steps, len(h)), np.int64)
    at[0] = np.arange(len(h))
    for j in range(1, steps):
        at[j] = at[j - 1] + ((bits[at[j - 1]] >> _U(j)) & _U(1)).astype(np.int64)
    return at


def walk_keys(h: np.ndarray, walk: int) -> np.ndarray:
    """The sampled key of the window at each word, 0 where the walk leaves the words or says too little."""
    at, shown = embed(h, walk), np.append(h, _U(0))
    key = np.full(len(h), walk + 1, _U)
    for j in sampled_steps(walk):
        key = (key ^ shown[at[j]]) * _U(0x9E3779B97F4A7C15)
        key ^= key >> _U(29)
    return np.where((at[-1] - at[0] >= SAMPLED - 1) & (at[-1] < len(h)), mix(key), _U(0))


def whole_keys(h: np.ndarray, n: int) -> np.ndarray:
    """For items under MIN_WORDS words, which allow no edits: the key of all n words at each place that has as many."""
    key = np.full(max(0, len(h) - n + 1), n, _U)
    for j in range(n if len(key) else 0):
        key = (key ^ h[j : len(h) - n + 1 + j]) * _U(0xD6E8FEB86659FD93)
        key ^= key >> _U(31)
    return mix(key)


def edits_within(item: np.ndarray, text: np.ndarray, k: int) -> int:
    """Fewest word edits from the item to any beginning of ``text``, or k + 1 if more than k."""
    n = len(item)
    row = np.arange(len(text) + 1)
    for i in range(1, n + 1):
        lower = np.minimum(row[:-1] + (text != item[i - 1]), row[1:] + 1)
        new = np.concatenate([[i], lower])
        new = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
        row = new
        if row.min() > k:
            return k + 1
    return int(min(row.min(), k + 1))


def edits_by_start(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For every start in ``text``, its end included, the fewest word edits from the item to any run of words from there."""
    item, text = item[::-1], text[::-1]
    row, at = np.zeros(len(text) + 1, np.int64), np.arange(len(text) + 1)
    for i in range(1, len(item) + 1):
        new = np.concatenate([[i], np.minimum(row[:-1] + (text != item[i - 1]), row[1:] + 1)])
        row = np.minimum.accumulate(new - at) + at
    return row[::-1]


def prepare(ids: list, texts: list) -> Items:
    seqs = []
    for _, part in sub_batches(texts):
        w = words(part)
        seqs += [w.hashes[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    parts = []
    for k, s in enumerate(seqs):
        for walk in range(REPEATS) if len(s) >= MIN_WORDS else [-1] if len(s) else []:
            key = walk_keys(s, walk) if walk >= 0 else whole_keys(s, len(s))
            at = np.flatnonzero(key)
            parts.append((key[at], np.full(len(at), k), at, np.full(len(at), walk)))
    keys, item, at, walk = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, _U), *(np.zeros(0, np.int64) for _ in range(3)))
    order = np.argsort(keys, kind="stable")
    keys, item, at, walk = keys[order], item[order], at[order], walk[order]
    table = np.zeros(1 << _TABLE_BITS, bool)
    table[(keys >> _U(64 - _TABLE_BITS)).astype(np.int64)] = True
    n = np.array([len(s) for s in seqs], np.int64)
    return Items(ids=ids, seqs=seqs, n=n, budget=np.array([allowed(x) for x in n.tolist()], np.int64), votes=np.array([votes(x) for x in n.tolist()], np.int64), short=sorted({x for x in n.tolist() if 0 < x < MIN_WORDS}), table=table, keys=keys, key_item=item, key_at=at, key_walk=walk)


def _votes(h: np.ndarray, items: Items) -> tuple[np.ndarray, ...]:
    """(word position, item, place in the item, walk) wherever a window of the text shows a key of an item."""
    out = []
    for walk in [*range(REPEATS), *(-n for n in items.short)]:
        key = walk_keys(h, walk) if walk >= 0 else whole_keys(h, -walk)
        pos = np.flatnonzero(items.table[(key >> _U(64 - _TABLE_BITS)).astype(np.int64)] & (key != 0))
        lo, hi = np.searchsorted(items.keys, key[pos], "left"), np.searchsorted(items.keys, key[pos], "right")
        many = hi - lo
        take = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        out.append((np.repeat(pos, many), items.key_item[take], items.key_at[take], items.key_walk[take]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def candidates(h: np.ndarray, first: np.ndarray, items: Items) -> list[tuple[int, int, int, int]]:
    """(text, item, lowest start, highest start) with enough votes; text k owns the words first[k]:first[k + 1] of ``h``."""
    pos, item, at, walk = _votes(h, items)
    text = np.searchsorted(first, pos, "right") - 1
    start = pos - at
    order = np.lexsort((start, item, text))
    text, item, start, code = text[order], item[order], start[order], (at * (REPEATS + 1) + walk + 1)[order]
    if not len(text):
        return []
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > 2 * items.budget[item[1:]])
    group = np.cumsum(new) - 1
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(text)) - 1
    # votes of one key of the item count once
    order = np.lexsort((code, group))
    g, c = group[order], code[order]
    once = np.ones(len(g), bool)
    once[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
    enough = np.bincount(g[once], minlength=len(lo)) >= items.votes[item[lo]]
    return list(zip(text[lo][enough].tolist(), item[lo][enough].tolist(), start[lo][enough].tolist(), start[hi][enough].tolist(), strict=True))


def verify(h: np.ndarray, s: np.ndarray, low: int, high: int) -> tuple[int, int] | None:
    """(edits, start) of the best run of ``h`` within the budget that starts between ``low`` and ``high``, give or take the budget."""
    n, few = len(s), allowed(len(s))
    low, high = max(0, low - few), min(high + few, len(h) - n + few)
    if high < low:
        return None
    near = h[low : high + n + few]
    if n - np.isin(s, near).sum() > few:  # each of the item's words that is not there costs an edit
        return None
    e = edits_by_start(s, near)[: high - low + 1]
    k = int(e.argmin())
    return (int(e[k]), low + k) if e[k] <= few else None


def leaks(h: np.ndarray, first: np.ndarray, items: Items) -> list[list[tuple]]:
    """For each text its (item_id, start_word, edits), one for each item it leaks."""
    best: list[dict] = [{} for _ in first[1:]]
    for text, item, low, high in candidates(h, first, items):
        a = int(first[text])
        found = verify(h[a : first[text + 1]], items.seqs[item], low - a, high - a)
        if found and found < best[text].get(item, (1 << 30, 0)):
            best[text][item] = found
    rows = ([(items.ids[k], start, e) for k, (e, start) in x.items()] for x in best)
    return [sorted(x, key=lambda y: (y[0] is None, y)) for x in rows]


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The items, ``BLOCK`` and ``BLOCK_CHARS`` at most at a time."""
    ids, texts, size = [], [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        if ids and (len(ids) == BLOCK or size + len(r.text) > BLOCK_CHARS):
            yield prepare(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        size += len(r.text)
    if ids:
        yield prepare(ids, texts)


def mark_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", name: str = "leaks") -> DataFrame:
    """Adds ``name``: array of (item_id, start_word, edits) of the items that each whole text leaks."""
    out = docs.withColumn(name, F.array().cast(_ANSWER))
    for items in _blocks(benchmark):
        out = _mark_block(out, docs.sparkSession.sparkContext.broadcast(items), text_col, name)
    return out


def _mark_block(docs: DataFrame, cast, text_col: str, name: str) -> DataFrame:
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = cast.value
        for b in batches:
            old, new = b.column(names.index(name)).to_pylist(), []
            for _, part in sub_batches(b.column(names.index(text_col)).to_pylist(), 500_000):
                w = words(part)
                new += leaks(w.hashes, w.first, items)
            both = [[*x, *[{"item_id": i, "start_word": s, "edits": e} for i, s, e in y]] for x, y in zip(old, new, strict=True)]
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start_word", pa.int64()), ("edits", pa.int32())]))
            cols = list(b.columns)
            cols[names.index(name)] = pa.array(both, kind)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, docs.schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, item_id, start_word, edits: one row for each document and item it leaks."""
    marked = mark_leaks(docs.select(id_col, "text"), benchmark).where(F.size("leaks") > 0)
    return marked.select(id_col, F.explode("leaks").alias("leak")).select(id_col, "leak.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, columns as they were."""
    name = unused(docs, "leaks")
    return mark_leaks(docs, benchmark, name=name).where(F.size(name) == 0).select(*docs.columns)
