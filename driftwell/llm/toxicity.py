"""Toxicity (operator 1): subword bags averaged into a linear softmax, embeddings and classifier trained jointly in numpy.

A window of words is a bag of the hashes of its words and of their character 3- to 6-grams (with marks for the word's
ends), so a misspelling shares most vectors with the word it stands for. The bag's mean vector goes to a two-class
softmax. A document's score is that of its likeliest window, so a long text does not dilute a short passage; training
takes the same window: for a document of either class, the one that now looks most toxic.

Training runs on a bounded sample of labelled rows (``MAX_PER_CLASS`` of each class, those with the smallest hashes of
their ids); scoring reads every whole text. Since everything after the hashes is linear, a trained model is one number
for each hash slot, 1 MB whatever the corpus.

Defined cases: a null or empty text scores as an empty bag (the bias alone); very long texts are cut into windows and
read whole; repeated rows score alike; an empty table gives no rows; with labels of one class only, every score is that
class's share; labels with a null id or null label are ignored. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.llm.tokens import mix, sub_batches, unused, words

SLOTS = 1 << 18
DIM = 8
MAX_PER_CLASS = 700
WINDOW = 4
GAIN = 10.0
MIN_DOCS = 3
NGRAMS = (3, 4, 5, 6)
THRESHOLD = 0.7
_VALUE = np.random.default_rng(7).integers(1, 2**63, 256).astype(np.uint64) | np.uint64(1)


def features(run: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot of each feature, window it belongs to, first window of each text and the count of windows)."""
    w = words(run)
    counts = np.diff(w.first)
    n_windows = np.maximum(1, -(-counts // WINDOW))
    first = np.concatenate([[0], np.cumsum(n_windows)])
    if not len(w.start):
        return np.zeros(0, np.int32), np.zeros(0, np.int64), first
    in_text = np.arange(len(w.start)) - np.repeat(w.first[:-1], counts)
    window = np.repeat(first[:-1], counts) + in_text // WINDOW
    # the space before a word and the one after it serve as the marks of its ends
    text = np.concatenate([[np.uint8(32)], w.buffer])
    text = np.where((text >= 9) & (text <= 13), np.uint8(32), text)
    value = _VALUE[text]
    length = w.end - w.start + 2
    slots, at = [(w.hashes >> np.uint64(46)).astype(np.int32) & (SLOTS - 1)], [window]
    for n in NGRAMS:
        many = np.maximum(length - n + 1, 0)
        pos = np.repeat(w.start, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        h = np.full(len(pos), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + value[pos + k]
        slots.append((mix(h) >> np.uint64(46)).astype(np.int32) & (SLOTS - 1))
        at.append(np.repeat(window, many))
    return np.concatenate(slots), np.concatenate(at), first


def _bags(texts: list) -> list[list[np.ndarray]]:
    """For every text its windows, each the slots of its features."""
    out = []
    for _, run in sub_batches(texts, 300_000):
        slot, at, first = features(run)
        order = np.argsort(at, kind="stable")
        edges = np.searchsorted(at[order], np.arange(first[-1] + 1))
        slot = slot[order]
        parts = [slot[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        out += [parts[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    return out


def train(texts: list, toxic: list, epochs: int = 18, rate: float = 0.3, seed: int = 3) -> tuple[np.ndarray, float]:
    """(logit of each slot, bias).

    Embeddings start on the softmax's axis at the smoothed log-odds of a slot's document counts, slots of fewer than
    ``MIN_DOCS`` documents at zero and fixed. Each epoch picks every document's most toxic window under the model so
    far, then takes adaptive gradient steps on embeddings and softmax together.
    """
    y = np.asarray(toxic, np.float64)
    share = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
    if not len(y) or y.min() == y.max():
        return np.zeros(SLOTS, np.float32), float(np.log(share / (1 - share)))
    bags = _bags(texts)
    rng = np.random.default_rng(seed)
    seen = np.zeros((2, SLOTS), np.float32)
    for b, label in zip(bags, y, strict=True):
        seen[int(label), np.unique(np.concatenate(b))] += 1
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
    live = seen.sum(0) >= MIN_DOCS
    axis = np.full(DIM, DIM**-0.5, np.float32)
    emb = (np.clip(odds, -3, 4) * live)[:, None].astype(np.float32) * axis
    emb += rng.normal(0, 0.02, (SLOTS, DIM)).astype(np.float32) * live[:, None]
    out = np.stack([-axis / 2, axis / 2], 1)
    bias = np.array([1.5, -1.5], np.float32)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    flat = np.concatenate([p for b in bags for p in b])
    edges = np.concatenate([[0], np.cumsum([len(p) for b in bags for p in b])])
    width = np.diff(edges)
    doc_first = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    del bags
    squares, out_squares, bias_squares = np.full(SLOTS, 1e-8, np.float32), np.full_like(out, 1e-2), np.full(2, 1e-2, np.float32)
    for _ in range(epochs):
        s = np.append((emb @ (out[:, 1] - out[:, 0]))[flat], np.float32(0))
        mean = np.where(width > 0, np.add.reduceat(s, edges[:-1]) / np.maximum(width, 1), 0)
        chosen = [flat[edges[p] : edges[p + 1]] for p in (lo + int(np.argmax(mean[lo:hi])) for lo, hi in zip(doc_first[:-1], doc_first[1:], strict=True))]
        for block in np.array_split(rng.permutation(len(y)), max(1, len(y) // 32)):
            ids = [chosen[k] for k in block]
            n = np.array([max(1, len(i)) for i in ids], np.float32)
            bag = GAIN * np.stack([emb[i].sum(0) for i in ids]) / n[:, None]
            logit = bag @ out + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            grad = p - np.stack([1 - y[block], y[block]], 1)
            grad = (grad * weight[block, None] / len(block)).astype(np.float32)
            back = GAIN * (grad @ out.T) / n[:, None]
            g_out, g_bias = bag.T @ grad, grad.sum(0)
            out_squares += g_out**2
            bias_squares += g_bias**2
            out -= 0.1 * rate * g_out / np.sqrt(out_squares)
            bias -= rate * g_bias / np.sqrt(bias_squares)
            uniq, inverse = np.unique(np.concatenate(ids), return_inverse=True)
            many = np.repeat(back, [len(i) for i in ids], axis=0)
            g = np.stack([np.bincount(inverse, many[:, d], len(uniq)) for d in range(DIM)], 1).astype(np.float32) * live[uniq, None]
            squares[uniq] += (g * g).sum(1)
            emb[uniq] -= rate * g / np.sqrt(squares[uniq])[:, None]
    return (GAIN * (emb @ (out[:, 1] - out[:, 0]))).astype(np.float32), float(bias[1] - bias[0])


def window_logits(run: list[bytes], slots: np.ndarray, bias: float) -> np.ndarray:
    """The largest window logit of each text."""
    slot, at, first = features(run)
    n = np.bincount(at, minlength=first[-1])
    s = np.bincount(at, weights=slots[slot], minlength=first[-1])
    logit = s / np.maximum(n, 1) + bias
    return np.maximum.reduceat(logit, first[:-1]) if len(first) > 1 else np.zeros(0)


def training_rows(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> DataFrame:
    """(text, toxic): of each class the labelled documents with the smallest id hashes, ``max_per_class`` at most."""
    lab = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few = None
    for c in (0, 1):
        part = lab.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class)
        few = part if few is None else few.unionByName(part)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, **kw) -> tuple[np.ndarray, float]:
    rows = training_rows(docs, labels).orderBy("toxic", "text").toPandas()
    return train(rows.text.tolist(), rows.toxic.tolist(), **kw)


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", name: str = "score") -> DataFrame:
    """Adds ``name`` (0 to 1) for every whole text; no column of ``docs`` may have that name."""
    cast = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, bias = cast.value
        for b in batches:
            texts = b.column(names.index(text_col)).to_pylist()
            logit = [window_logits(r, slots, bias) for _, r in sub_batches(texts)]
            p = 1 / (1 + np.exp(-np.clip(np.concatenate(logit) if logit else np.zeros(0), -50, 50)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=[*names, name])

    names = docs.columns
    return docs.mapInArrow(run, schema)


def held_out(doc_id) -> Column:
    """True for the documents whose labels are not learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document, trained on labels outside the held-out third."""
    learn = labels.where(~held_out(F.col("doc_id")))
    model = fit(docs, learn)
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score under THRESHOLD, columns as they were."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    name = unused(docs, "score")
    return score(docs, model, name=name).where(F.col(name) < THRESHOLD).select(*docs.columns)
