"""Exact and near deduplication: first copies, MinHash signatures, LSH bands, and the order-faithful greedy rule."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..functions import text as T
from ..session import materialise, spread_small

PRIME = 2147483647
PERMUTATIONS, BANDS, ROWS = 100, 16, 6
SHINGLE = 3


def coefficients(n: int = PERMUTATIONS) -> list[tuple[int, int]]:
    """Multiplier and offset of each permutation, by a fixed rule, so that other engines can have the same ones."""
    return [((i + 1) * 48271 % PRIME, (i + 1) * 69621 % PRIME) for i in range(n)]


def shingles(words: Column, n: int = SHINGLE) -> Column:
    """Distinct runs of n words, joined by a blank."""
    return F.array_distinct(T.runs(words, n))


_AB = np.array(coefficients(), dtype=np.int64)


@F.arrow_udf(Y.ArrayType(Y.LongType()))
def signature(text: pa.Array) -> pa.Array:
    """The least value of (a h + b) mod PRIME over a text's distinct runs of SHINGLE words, for each permutation.

    h is the first 32 bits of a run's MD5, modulo the prime.  Null for texts with fewer words.
    """
    out = []
    for t in text.to_pylist():
        w = t.split() if t else []
        runs = {" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)}
        if not runs:
            out.append(None)
            continue
        h = np.array([int.from_bytes(hashlib.md5(r.encode()).digest()[:4], "big") % PRIME for r in runs], dtype=np.int64)
        out.append(((h[:, None] * _AB[None, :, 0] + _AB[None, :, 1]) % PRIME).min(axis=0))
    return pa.array(out, pa.list_(pa.int64()))


# so that a filter on the result doesn't compute it a second time
signature = signature.asNondeterministic()


def signatures(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, signature) of every text with enough words."""
    return spread_small(df.where(F.col(text).isNotNull()).select(key, text)).select(key, signature(F.col(text)).alias("signature")).where("signature is not null")


def bands(sigs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, band, band_key): what is shuffled is a 64-bit key for each band, never text or signature."""
    keys = F.array(*(F.xxhash64(F.slice("signature", i * ROWS + 1, ROWS)) for i in range(BANDS)))
    return sigs.select(key, F.posexplode(keys).alias("band", "band_key"))


def candidate_pairs(sigs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(id_a, id_b) that share a band, the smaller first.

    Documents of one signature are one vertex until the end, so copies add no pairs of bands.
    """
    groups = sigs.groupBy("signature").agg(F.min(key).alias("head"))
    members = sigs.join(groups, "signature").select("head", F.col(key).alias("member"))
    b = bands(groups.withColumnRenamed("head", "doc_id"))
    x, y = b.select("band", "band_key", F.col("doc_id").alias("x")), b.select("band", "band_key", F.col("doc_id").alias("y"))
    linked = x.join(y, ["band", "band_key"]).where("x < y").select("x", "y").distinct()
    linked = linked.union(groups.select(F.col("head").alias("x"), F.col("head").alias("y")))
    m = members.select(F.col("head").alias("x"), F.col("member").alias("ma")), members.select(F.col("head").alias("y"), F.col("member").alias("mb"))
    pairs = linked.join(m[0], "x").join(m[1], "y").where("x <> y or ma < mb")
    return pairs.select(F.least("ma", "mb").alias("id_a"), F.greatest("ma", "mb").alias("id_b")).distinct()


def greedy_keep(sigs: DataFrame, key: str = "doc_id", decided: DataFrame | None = None) -> DataFrame:
    """The keys a scan in key order would keep: a document goes if it shares a band with a kept one before it.

    Without edges: of the undecided documents, those that come first in all their bands are kept, and all that
    share a band with a kept one are dropped; this repeats until none is undecided.  The least undecided key is
    always decided, and rounds are as many as the longest chain of decisions, not as documents.  decided may hold
    (band, band_key) of documents kept before.
    """
    groups = sigs.groupBy("signature").agg(F.min(key).alias("id"))
    todo = materialise(bands(groups.withColumnRenamed("id", "doc_id")))
    if decided is not None:
        gone = todo.join(decided.select("band", "band_key").distinct(), ["band", "band_key"], "left_semi").select("doc_id").distinct()
        todo = materialise(todo.join(gone, "doc_id", "left_anti"))
    kept = []
    while not todo.isEmpty():
        first = todo.groupBy("band", "band_key").agg(F.min("doc_id").alias("first"))
        seen = todo.join(first, ["band", "band_key"])
        now = materialise(seen.groupBy("doc_id").agg(F.bool_and(F.col("first") == F.col("doc_id")).alias("ok")).where("ok").select("doc_id"))
        kept.append(now)
        taken = todo.join(now, "doc_id", "left_semi").select("band", "band_key").distinct()
        gone = todo.join(taken, ["band", "band_key"], "left_semi").select("doc_id").distinct()
        todo = materialise(todo.join(gone, "doc_id", "left_anti"))
    out = kept[0] if kept else sigs.select(F.col(key).alias("doc_id")).limit(0)
    for k in kept[1:]:
        out = out.union(k)
    return out.withColumnRenamed("doc_id", key)


def first_copies(df: DataFrame, by: Column, order: list[str]) -> DataFrame:
    """The first row of each value of ``by``; a minimum over structs, so copies are combined before the shuffle."""
    cols = [F.col(c) for c in df.columns]
    best = df.groupBy(by.alias("_k")).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return best.select("_r.*")
