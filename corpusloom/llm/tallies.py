"""Exact counts of very many things: summed in each task, exchanged as packed arrays by bucket, summed again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import codes
from ._spark import batches, spread

#: Entries of a task that are summed at once, and from which on it sends what it has and begins anew.
MERGE, FLUSH = 2_000_000, 4_000_000
_BLOB = pa.schema([("bucket", pa.int32()), ("entries", pa.binary())])


def summed(parts: list[np.ndarray], by: tuple[str, ...]) -> np.ndarray:
    """One entry for each value of the fields ``by``; all other fields are added up."""
    x = np.concatenate(parts)
    if not len(x):
        return x
    x = x[np.lexsort([x[f] for f in reversed(by)])]
    new = np.ones(len(x), dtype=bool)
    new[1:] = np.logical_or.reduce([x[f][1:] != x[f][:-1] for f in by])
    first = np.flatnonzero(new)
    out = x[first]
    for f in x.dtype.names:
        if f not in by:
            out[f] = np.add.reduceat(x[f], first)
    return out


def tallied(df: DataFrame, text: str, things: Callable[[pa.RecordBatch], np.ndarray], by: tuple[str, ...], none: np.ndarray, n_buckets: int, choose: Callable[[np.ndarray], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """What ``choose`` makes of the sums of each bucket, of which an entry's first field ``by`` decides.

    things gives a slice's entries, ``none`` is an empty array of them.  A task holds at most FLUSH entries, and
    a thing that all rows have arrives once from each flush, so no bucket grows with a hot thing.
    """

    def packed(parts: list[np.ndarray]) -> pa.RecordBatch:
        e = summed(parts, by)
        bucket = (codes.mix(e[by[0]].astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
        e = e[np.argsort(bucket, kind="stable")]
        cut = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=n_buckets))])
        some = np.flatnonzero(np.diff(cut)).tolist()
        return batches(_BLOB, bucket=some, entries=[e[cut[b] : cut[b + 1]].tobytes() for b in some])

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, pending = [none], 0
        for batch in rows:
            for part in codes.slices(batch, text):
                parts.append(summed([things(part)], by))
                pending += len(parts[-1])
                if pending > MERGE:
                    parts, pending = [summed(parts, by)], 0
                    if len(parts[0]) > FLUSH:
                        yield packed(parts)
                        parts = [none]
        yield packed(parts)

    def reduce(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, pending = [], 0
        for batch in rows:
            for v in batch.column(1).to_pylist():
                parts.append(np.frombuffer(v, dtype=none.dtype))
                pending += len(parts[-1])
                if pending > MERGE:
                    parts, pending = [summed(parts, by)], 0
        e = summed(parts, by) if parts else none
        if len(e):
            yield from choose(e)

    return spread(df.mapInArrow(count, "bucket int, entries binary"), n_buckets, "bucket").mapInArrow(reduce, ddl)
