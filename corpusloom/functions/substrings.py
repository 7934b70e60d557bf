"""Hashes of substrings of Arrow strings, and a bitmap that tells which substrings can be one of very many names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are processed at once, and slots of a name in the bitmap.
SLICE_BYTES, SLOTS = 1_000_000, 3
_STEP = 0x5851F42D4C957F2D  # odd, so invertible modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on a uint64 array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch, the bytes of their texts (column number text, without nulls) and the offsets of each text."""
    if not batch.num_rows:
        return
    group = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False), dtype=np.int64) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        part = batch.slice(a, b - a)
        col = part.column(text).cast(pa.large_binary())
        off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        buf = col.buffers()[2]
        yield part, np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None and buf.size else np.zeros(0, np.uint8), off - off[0]


class Hashes:
    """Hashes of any substrings of some bytes; the same for equal substrings of any bytes."""

    def __init__(self, data: np.ndarray):
        up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(data), base, np.uint64)])) for base in (_STEP, pow(_STEP, -1, 1 << 64)))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
        self.down = down

    def of(self, start: np.ndarray, end: np.ndarray, seed: np.ndarray) -> np.ndarray:
        """seed: a uint64 for each substring, hashed with it."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start] ^ mix(seed))


def slot(h: np.ndarray, i: int, bits: int) -> np.ndarray:
    """The i-th of a hash's slots."""
    return ((h + np.uint64(i) * (mix(h) | np.uint64(1))) >> np.uint64(64 - bits)).astype(np.int64)


def word_starts(data: np.ndarray, off: np.ndarray, after: str) -> tuple[np.ndarray, np.ndarray]:
    """(text, byte): the beginning of each text and each place behind a character of after, in order."""
    places = [np.zeros(0, np.int64)]
    for c in after:
        code = c.encode()
        at = np.flatnonzero(data == code[-1])
        at = at[at >= len(code) - 1]
        for back, b in enumerate(reversed(code)):
            at = at[data[at - back] == b]
        places.append(at)
    at = np.sort(np.concatenate(places))
    text = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, at, "right") - 1])
    start = np.concatenate([off[:-1], at + 1])
    order = np.lexsort((start, text))
    return text[order], start[order]


def candidates(data: np.ndarray, off: np.ndarray, seed: np.ndarray, after: str, lengths: list[int], bitmap: np.ndarray, bits: int) -> tuple[list[int], list[int], list[bytes]]:
    """(text, place in characters, substring): those of the given lengths in bytes that begin at a word start and can be a name.

    Each substring of a text comes once, at its first place.  Of what is no name little is left; no name is lost.
    """
    text, start = word_starts(data, off, after)
    hashes, padded, most = Hashes(data), np.append(data, np.uint8(0)), off[text + 1] - start
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for n in lengths:
        k = np.flatnonzero(most >= n)
        if not len(k):
            break
        k = k[(padded[start[k] + n] & 0xC0) != 0x80]  # whole characters
        h = hashes.of(start[k], start[k] + n, seed[text[k]])
        for i in range(SLOTS):
            s = slot(h, i, bits)
            stays = (bitmap[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1
            k, h = k[stays], h[stays]
        found.append((k, np.full(len(k), n)))
    k, n = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    raw, first = data.tobytes(), {}
    for t, s, e in zip(text[k].tolist(), start[k].tolist(), (start[k] + n).tolist()):
        first.setdefault((t, raw[s:e]), s)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    texts = [t for t, _ in first]
    return texts, (chars[np.array([*first.values()], np.int64)] - chars[off[np.array(texts, np.int64)]]).tolist(), [x for _, x in first]
