"""Sorted 64-bit keys as compressed bytes, and dealing them to buckets by their leading bits.

Operators that count or match very many hashes ship them as one row for each map task and bucket, not one row a hash:
keys sorted, cut to ``bits`` leading bits, stored as byte planes of their differences and compressed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys, as compressed byte planes of their differences."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    top = int(gaps.max()).bit_length() if len(gaps) else 0
    planes = np.ascontiguousarray(gaps).view(np.uint8).reshape(-1, 8).T[: max(1, -(-top // 8))]
    return squeeze(len(gaps).to_bytes(8, "little") + np.ascontiguousarray(planes).tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    raw = unsqueeze(data)
    n = int.from_bytes(raw[:8], "little")
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(raw, np.uint8, offset=8).reshape(-1, n)
    full = np.zeros((n, 8), np.uint8)
    full[:, : len(planes)] = planes.T
    return np.cumsum(full.view(np.uint64).ravel(), dtype=np.uint64)


def pack_small(values: np.ndarray) -> bytes:
    """Non-negative integers in as many bytes as the largest needs, as compressed byte planes."""
    v = values.astype(np.uint64)
    top = max(1, -(-int(v.max()).bit_length() // 8)) if len(v) else 1
    planes = np.ascontiguousarray(v).view(np.uint8).reshape(-1, 8).T[:top]
    return squeeze(len(v).to_bytes(8, "little") + np.ascontiguousarray(planes).tobytes())


def unpack_small(data: bytes) -> np.ndarray:
    raw = unsqueeze(data)
    n = int.from_bytes(raw[:8], "little")
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(raw, np.uint8, offset=8).reshape(-1, n)
    full = np.zeros((n, 8), np.uint8)
    full[:, : len(planes)] = planes.T
    return full.view(np.uint64).ravel().astype(np.int64)


def bucket_edges(sorted_keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Positions at which sorted keys of ``bits`` bits pass from one equal range of key space to the next."""
    marks = [(b << bits) // buckets for b in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(sorted_keys, np.array(marks, np.uint64)), [len(sorted_keys)]])


def rows_by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list]]]:
    """(key, the rest of its rows) from batches sorted by their first column; one key's rows are held at a time."""
    key, rows = None, []
    for b in batches:
        for k, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if k != key:
                if rows:
                    yield key, rows
                key, rows = k, []
            rows.append(rest)
    if rows:
        yield key, rows
