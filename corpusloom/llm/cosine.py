"""Exact weighted cosine join over inverted lists.

Terms of all vectors are in one order, the heavier (rarer) ones first.  A vector's front part ends where the
norm of the rest falls under the threshold; two vectors similar enough share a term of both front parts.
Only these are posted.  A shared term makes a candidate if its product and the norms that remain behind it
can reach the threshold, and if the largest weight of one and the sum of the other's weights can.
Candidates get their exact dot product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_POST = pa.schema([("term", pa.int64()), ("key", pa.int64()), ("weight", pa.float64()), ("rest", pa.float64()), ("top", pa.float64()), ("total", pa.float64())])
_POST_DDL = "term long, key long, weight double, rest double, top double, total double"
_DOT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cosine", pa.float64())])


def _vectors(col_terms: pa.Array, col_weights: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t, w = col_terms.to_pylist(), col_weights.to_pylist()
    size = np.array([len(x) // 8 for x in t], dtype=np.int64)
    return np.frombuffer(b"".join(t), dtype="<u8"), np.frombuffer(b"".join(w), dtype="<f8"), np.concatenate([[0], np.cumsum(size)])


def pack(terms: np.ndarray, weights: np.ndarray) -> tuple[bytes, bytes]:
    """A vector of unit length with its terms in the common order: by falling raw weight of one occurrence, then by term.

    weights[:, 0] orders the terms and must be the same wherever a term occurs; weights[:, 1] is the value.
    """
    order = np.lexsort((terms, -weights[:, 0]))
    w = weights[order, 1]
    norm = np.sqrt((w**2).sum())
    return terms[order].astype("<u8").tobytes(), (w / norm if norm > 0 else w).astype("<f8").tobytes()


def _postings(df: DataFrame, threshold: float) -> DataFrame:
    def emit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            terms, w, off = _vectors(b.column(1), b.column(2))
            row = np.repeat(np.arange(b.num_rows), np.diff(off))
            square = np.concatenate([[0.0], np.cumsum(w**2)])
            behind = np.sqrt(np.maximum(square[off[1:]][row] - square[1:], 0))
            before = np.sqrt(np.maximum(square[off[1:]][row] - square[:-1], 0))
            top, total = np.zeros(b.num_rows), np.zeros(b.num_rows)
            np.maximum.at(top, row, w)
            np.add.at(total, row, w)
            keep = before >= threshold - 1e-9
            keys = b.column(0).to_numpy(zero_copy_only=False)
            values = (terms[keep].view(np.int64), keys[row[keep]], w[keep], behind[keep], top[row[keep]], total[row[keep]])
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v)) for v in values], schema=_POST)

    return df.select("key", "terms", "weights").mapInArrow(emit, _POST_DDL)


def join(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, cosine): keys of left and right whose packed vectors (key, terms, weights) reach the threshold."""
    x, y = _postings(left, threshold), _postings(right, threshold)
    x = x.select("term", *(F.col(c).alias(f"{c}_x") for c in x.columns if c != "term"))
    y = y.select("term", *(F.col(c).alias(f"{c}_y") for c in y.columns if c != "term"))
    t = F.lit(threshold - 1e-9)
    reach = F.col("weight_x") * F.col("weight_y") + F.col("rest_x") * F.col("rest_y")
    most = F.least(F.col("top_x") * F.col("total_y"), F.col("top_y") * F.col("total_x"))
    pairs = x.join(y, "term").where((reach >= t) & (most >= t)).select(F.col("key_x").alias("a"), F.col("key_y").alias("b")).distinct()

    def dot(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            (tx, wx, ox), (ty, wy, oy) = _vectors(b.column(2), b.column(3)), _vectors(b.column(4), b.column(5))
            row = np.concatenate([np.repeat(np.arange(b.num_rows), np.diff(o)) for o in (ox, oy)])
            terms, w = np.concatenate([tx, ty]), np.concatenate([wx, wy])
            order = np.lexsort((terms, row))
            row, terms, w = row[order], terms[order], w[order]
            twice = (terms[1:] == terms[:-1]) & (row[1:] == row[:-1])
            cosine = np.bincount(row[1:][twice], (w[1:] * w[:-1])[twice], minlength=b.num_rows)
            keep = cosine >= threshold - 1e-9
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep)), pa.array(cosine[keep])], schema=_DOT)

    vx, vy = (d.select(F.col("key").alias(k), F.col("terms").alias(f"t{k}"), F.col("weights").alias(f"w{k}")) for d, k in ((left, "a"), (right, "b")))
    return pairs.join(vx, "a").join(vy, "b").select("a", "b", "ta", "wa", "tb", "wb").mapInArrow(dot, "a long, b long, cosine double")
