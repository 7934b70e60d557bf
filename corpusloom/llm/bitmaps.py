"""Compressed bitmaps of 64-bit numbers: chunks of 2**16 numbers, each a short list or a bit field."""

from __future__ import annotations

import numpy as np

_LIST = 4096  # up to so many numbers of a chunk are a list of 16-bit numbers


def encode(ids: np.ndarray) -> bytes:
    """The bitmap of any numbers; order and repetitions don't matter."""
    ids = np.unique(np.ascontiguousarray(ids, dtype=np.int64).view(np.uint64))
    chunk = ids >> np.uint64(16)
    first = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])) if len(ids) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([first, [len(ids)]])).astype("<u4")
    low = (ids & np.uint64(0xFFFF)).astype("<u2")
    parts = [np.array([len(first)], dtype="<u4").tobytes(), chunk[first].astype("<u8").tobytes(), size.tobytes()]
    for a, n in zip(first.tolist(), size.tolist()):
        own = low[a : a + n]
        if n <= _LIST:
            parts.append(own.tobytes())
        else:
            bits = np.zeros(1 << 16, dtype=np.uint8)
            bits[own] = 1
            parts.append(np.packbits(bits, bitorder="little").tobytes())
    return b"".join(parts)


def _chunks(data: bytes):
    n = int(np.frombuffer(data, "<u4", 1)[0])
    keys, size, at = np.frombuffer(data, "<u8", n, 4), np.frombuffer(data, "<u4", n, 4 + 8 * n), 4 + 12 * n
    for k, m in zip(keys, size.tolist()):
        if m <= _LIST:
            yield k, np.frombuffer(data, "<u2", m, at)
            at += 2 * m
        else:
            yield k, np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, 8192, at), bitorder="little")).astype("<u2")
            at += 8192


def decode(data: bytes) -> np.ndarray:
    parts = [(np.uint64(k) << np.uint64(16)) | low.astype(np.uint64) for k, low in _chunks(data)]
    return np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)


def cardinality(data: bytes) -> int:
    """How many numbers, from the header alone."""
    n = int(np.frombuffer(data, "<u4", 1)[0])
    return int(np.frombuffer(data, "<u4", n, 4 + 8 * n).sum())


def union(maps: list[bytes]) -> bytes:
    """Chunk by chunk, in bit fields where a chunk is in several maps."""
    by: dict[int, list[np.ndarray]] = {}
    for m in maps:
        for k, low in _chunks(m):
            by.setdefault(int(k), []).append(low)
    ids = []
    for k, lows in by.items():
        if len(lows) > 1:
            bits = np.zeros(1 << 16, dtype=bool)
            for low in lows:
                bits[low] = True
            low = np.flatnonzero(bits)
        else:
            low = lows[0]
        ids.append((np.uint64(k) << np.uint64(16)) | low.astype(np.uint64))
    return encode(np.concatenate(ids).view(np.int64)) if ids else encode(np.zeros(0, np.int64))


def contains(data: bytes, ids: np.ndarray) -> np.ndarray:
    return np.isin(ids, decode(data))
