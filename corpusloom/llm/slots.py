"""Counts of very many things in a table of fixed size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import codes
from ._spark import batches, spread

SLOT_BITS = 24
SEGMENTS = 16
_COUNTS = pa.schema([("segment", pa.int32()), ("counts", pa.binary())])
_DDL = "segment int, counts binary"


def slot(hashes: np.ndarray, bits: int = SLOT_BITS) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def log_counts(df: DataFrame, text: str, things: Callable[[pa.RecordBatch], np.ndarray], bits: int = SLOT_BITS, most: int = 255) -> tuple[np.ndarray, int]:
    """Eight times the binary logarithm of one more than how often things occur, and the number of all of them.

    things gives the hashes of a slice's things; all rows count.  Things that share a slot are counted
    together, and one task counts up to ``most`` of a slot.  2**bits bytes reach the driver, whatever the input.
    """
    size = 1 << bits
    kind = np.uint8 if most < 256 else np.uint32

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=kind)
        n = 0
        for batch in rows:
            for part in codes.slices(batch, text):
                h = things(part)
                u, c = np.unique(slot(h, bits), return_counts=True)
                total[u] = np.minimum(total[u] + c, most)
                n += len(h)
        pieces = total.reshape(SEGMENTS, -1)
        yield batches(_COUNTS, segment=list(range(SEGMENTS)), counts=[np.int64(0 if i else n).tobytes() + p.tobytes() for i, p in enumerate(pieces)])

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        n: dict[int, int] = {}
        for batch in rows:
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n[s] = n.get(s, 0) + int(np.frombuffer(c, np.int64, 1)[0])
                if s not in sums:
                    sums[s] = np.zeros(size // SEGMENTS, dtype=np.uint32)
                sums[s] += np.frombuffer(c, kind, offset=8)
        for s, c in sums.items():
            log = np.minimum(np.round(8 * np.log2(1 + c)), 255).astype(np.uint8)
            yield batches(_COUNTS, segment=[s], counts=[np.int64(n[s]).tobytes() + log.tobytes()])

    parts = spread(df.mapInArrow(count, _DDL), SEGMENTS, "segment").mapInArrow(add, _DDL)
    table, n = np.zeros((SEGMENTS, size // SEGMENTS), dtype=np.uint8), 0
    for row in parts.collect():
        table[row["segment"]] = np.frombuffer(row["counts"], np.uint8, offset=8)
        n += int(np.frombuffer(row["counts"], np.int64, 1)[0])
    return table.reshape(-1), n
