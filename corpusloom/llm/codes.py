"""Columnar text kernels: Arrow string columns to NumPy code arrays, words, hashes and n-grams.

All kernels work on a *slice* of an Arrow batch (bounded by ``SLICE_BYTES`` of text, or one single
document if that is larger), so a worker's memory follows the slice and not the batch.  A null text
is an empty document.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 6_000_000
_MUL = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0x5851F42D4C957F2D  # odd, so invertible modulo 2**64
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on a uint64 array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _code_hash() -> np.ndarray:
    return mix(np.arange(1, 0x110002, dtype=np.uint64) * _MUL)


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse modulo 2**64, at least n of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        out = []
        for base in (_STEP, pow(_STEP, -1, 1 << 64)):
            p = np.ones(size, dtype=np.uint64)
            filled, factor = 1, base
            while filled < size:
                p[filled : 2 * filled] = p[:filled] * np.uint64(factor)
                filled, factor = 2 * filled, factor * factor & _MASK
            out.append(p)
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES):
    """Yield zero-copy slices of the batch whose text column holds about max_bytes each."""
    n = batch.num_rows
    if n == 0:
        return
    col = batch.column(batch.schema.get_field_index(column))
    size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(size, dtype=np.int64) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string column, and each document's offsets (length n + 1)."""
    col = pc.fill_null(col, "").cast(pa.string())
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    off = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8)[off[0] : off[-1]] if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data, off - off[0]


def codepoints(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points (uint32) of all texts, and each document's offsets."""
    data, _ = utf8(col)
    size = pc.utf8_length(pc.fill_null(col, "")).to_numpy(zero_copy_only=False)
    cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    return cps, np.concatenate([[0], np.cumsum(size, dtype=np.int64)])


def from_strings(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    joined = "".join(texts)
    cps = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    return cps, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


_NUKTA, _VIRAMA, _TABLED = 0x93C, 0x94D, 0x30000


@lru_cache(maxsize=1)
def _unstable() -> np.ndarray:
    """True for code points that may make a text differ from its NFKC form.

    Nukta and virama are left out: they stand in nearly every Devanagari text and are checked by
    their neighbours instead.
    """
    flag = np.zeros(0x110000, dtype=bool)
    flag[_TABLED:] = True
    for c in range(0x80, _TABLED):
        ch = chr(c)
        parts = unicodedata.decomposition(ch)
        if parts and not unicodedata.is_normalized("NFKC", ch):
            flag[c] = True
        if parts and parts[0] != "<" and len(parts.split()) == 2:
            flag[int(parts.split()[1], 16)] = True
        if unicodedata.combining(ch):
            flag[c] = True
    flag[0x1100:0x1200] = True
    flag[[_NUKTA, _VIRAMA]] = False
    return flag


def _docs_of(positions: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.unique(np.searchsorted(off, positions, side="right") - 1)


def nfkc(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points with each document in NFKC; only documents that may change are rewritten."""
    hit = _unstable()[cps]
    nukta = cps == _NUKTA
    if nukta.any():
        before = np.concatenate([[np.uint32(0)], cps[:-1]])
        hit |= nukta & np.isin(before, np.array([0x928, 0x930, 0x933, _VIRAMA, _NUKTA], dtype=np.uint32))
    where = np.flatnonzero(hit)
    if not len(where):
        return cps, off
    parts, sizes, last = [], np.diff(off).copy(), 0
    for d in _docs_of(where, off).tolist():
        text = cps[off[d] : off[d + 1]].tobytes().decode("utf-32-le")
        new = np.frombuffer(unicodedata.normalize("NFKC", text).encode("utf-32-le"), dtype=np.uint32)
        parts += [cps[last : off[d]], new]
        sizes[d], last = len(new), off[d + 1]
    parts.append(cps[last:])
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])


def select(cps: np.ndarray, off: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only the code points where keep is true, with the offsets moved."""
    if keep.all():
        return cps, off
    upto = np.concatenate([[0], np.cumsum(keep)])
    return cps[keep], upto[off]


WORD, GAP, DROP, DIGIT = 0, 1, 2, 3


@lru_cache(maxsize=1)
def char_class() -> np.ndarray:
    """WORD for letters and marks, DIGIT for numbers, DROP for characters without a shape, GAP else."""
    cls = np.full(0x110000, GAP, dtype=np.uint8)
    for c in range(_TABLED):
        kind = unicodedata.category(chr(c))
        if kind[0] in "LM":
            cls[c] = WORD
        elif kind[0] == "N":
            cls[c] = DIGIT
        elif kind == "Cf":
            cls[c] = DROP
    cls[_TABLED:0xE0000] = WORD
    cls[0xE0000:0xE0080] = DROP
    cls[0xFE00:0xFE10] = DROP  # variation selectors
    cls[0xE0100:0xE01F0] = DROP
    cls[0x34F] = DROP  # grapheme joiner
    return cls


@lru_cache(maxsize=1)
def digit_fold() -> np.ndarray:
    """Each decimal digit of any script as its ASCII digit, all other code points as they are."""
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x80, _TABLED):
        d = unicodedata.decimal(chr(c), None)
        if d is not None:
            table[c] = 0x30 + d
    return table


class Words:
    """Words of the documents of a slice: start and end in the codes, document, and hash."""

    __slots__ = ("start", "end", "doc", "hash", "n_docs")

    def __init__(self, start, end, doc, hashes, n_docs):
        self.start, self.end, self.doc, self.hash, self.n_docs = start, end, doc, hashes, n_docs

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)


def words(codes: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> Words:
    """Maximal runs of word codes; a run never passes a document's end."""
    n_docs = len(off) - 1
    n = len(codes)
    if n == 0 or not is_word.any():
        z = np.zeros(0, dtype=np.int64)
        return Words(z, z, z, np.zeros(0, np.uint64), n_docs)
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    edge = off[1:-1]
    edge = edge[edge < n]
    first[edge] = is_word[edge]
    start = np.flatnonzero(first)
    last = is_word.copy()
    last[:-1] &= ~is_word[1:]
    before = edge[edge > 0] - 1
    last[before] = is_word[before]
    end = np.flatnonzero(last) + 1
    power, inverse = _powers(n)
    value = _code_hash()[codes] * power[:n]
    value[~is_word] = 0
    h = mix(np.add.reduceat(value, start) * inverse[start])
    doc = np.searchsorted(off, start, side="right") - 1
    return Words(start, end, doc, h, n_docs)


def ngrams(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n consecutive words of one document, and the index of their first word."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    g = np.zeros(len(at), dtype=np.uint64)
    for j in range(n):
        g = g * np.uint64(_STEP) + hashes[at + j]
    return mix(g), at


def plain_words(col: pa.Array) -> Words:
    """Words as stored: stretches without space, tab or newline."""
    data, off = utf8(col)
    return words(data, off, (data != 0x20) & (data != 0x09) & (data != 0x0A))


def folded(col: pa.Array, digits: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points in NFKC without invisible characters and with ASCII digits, offsets, and which are word codes.

    With digits=False digits separate words as punctuation does.
    """
    cps, off = nfkc(*codepoints(col))
    cls = char_class()[cps]
    keep = cls != DROP
    cps, off = select(cps, off, keep)
    cls = cls[keep]
    if digits:
        return digit_fold()[cps], off, (cls == WORD) | (cls == DIGIT)
    return cps, off, cls == WORD


def folded_words(col: pa.Array, digits: bool = True) -> Words:
    return words(*folded(col, digits))
