"""Words of many texts at once, as numpy arrays: the shared first step of the operators on word shingles.

Texts of a batch are lower-cased (A-Z only), encoded as UTF-8 and laid end to end with a space between them. A word is a
maximal run of bytes outside space and \\x09-\\x0D; its 64-bit hash is a polynomial over random values of its bytes,
then mixed. Nothing here depends on the process, so hashes agree between executors and runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

SUB_BATCH_BYTES = 2_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = np.uint64(0x9E3779B97F4A7C15)


def unused(df, name: str) -> str:
    """``name``, with as many underscores before it as it takes to differ from all columns of ``df``, case aside."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of a run of texts: ``hashes``; byte ``start`` and ``end`` in ``buffer``; text k owns first[k]:first[k + 1]."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    buffer: np.ndarray
    offsets: np.ndarray


def sub_batches(texts: list, limit: int = SUB_BATCH_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, encoded lower-case texts) in runs of about ``limit`` bytes; null texts are empty."""
    at, run, size = 0, [], 0
    for k, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass").translate(_LOWER)
        if run and size + len(b) > limit:
            yield at, run
            at, run, size = k, [], 0
        run.append(b)
        size += len(b) + 1
    if run:
        yield at, run


def words(run: list[bytes]) -> Words:
    a = np.frombuffer(b" ".join(run) + b" ", np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(b) + 1 for b in run])])
    inside = ~_SPACE[a]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    start = np.flatnonzero(edge == 1)
    end = np.flatnonzero(edge == -1)
    first = np.searchsorted(start, offsets)
    if not len(start):
        return Words(np.zeros(0, np.uint64), start, end, first, a, offsets)
    value = np.where(inside, _BYTE[a], np.uint64(0))[start[0] :]
    gap = np.diff(np.append(start, len(a)))
    place = np.arange(len(value)) - np.repeat(start - start[0], gap)
    powers = np.cumprod(np.full(int(gap.max()), _POWER, np.uint64))
    h = np.add.reduceat(value * powers[place], start - start[0])
    return Words(mix(h ^ (end - start).astype(np.uint64)), start, end, first, a, offsets)


def shingles(w: Words, n: int = 5) -> list[np.ndarray]:
    """Per text, the sorted distinct hashes of its n-word shingles; a shorter text gives its whole sequence as one."""
    out, h = [], w.hashes
    whole = np.zeros(0, np.uint64)
    if len(h) >= n:
        whole = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            whole = (whole ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9FB21C651E98DF25) + np.uint64(k + 1)
            whole ^= whole >> np.uint64(32)
        whole = mix(whole)
    for lo, hi in zip(w.first[:-1], w.first[1:], strict=True):
        if hi - lo >= n:
            out.append(np.unique(whole[lo : hi - n + 1]))
        elif hi > lo:
            x = np.uint64(hi - lo)
            for v in h[lo:hi]:
                x = mix(np.array([x], np.uint64) * np.uint64(0xD6E8FEB86659FD93) + v)[0]
            out.append(np.array([x], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
