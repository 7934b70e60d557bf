"""Seeded splits, out-of-core shuffles, disjoint partitions, weighted draws and samples, all by hashes and so in any order."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1_000_000


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on key and seed alone, from the MD5 of both."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("long")
    return (h % BUCKETS) / F.lit(float(BUCKETS))


def rank_hash(key: Column, seed: int) -> Column:
    """A hash to order rows by, as text, so that other engines order alike."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def assign(df: DataFrame, key: str, seed: int = 42, train: float = 0.95, val: float = 0.025) -> DataFrame:
    """df with split: train below the first ratio, val below the sum of both, else test."""
    u = uniform(F.col(key), seed)
    return df.withColumn("split", F.when(u < train, "train").when(u < train + val, "val").otherwise("test"))


def stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Documents and bytes of each split, and of all as split ``total``."""
    return df.rollup("split").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long").alias("n_bytes")).withColumn("split", F.coalesce("split", F.lit("total")))


def shuffled(df: DataFrame, key: str, seed: int = 42, buckets: int = 32) -> DataFrame:
    """df in random order: rows go to hashed buckets, each sorted by hash, and the buckets come in hashed order too; nothing is sorted as a whole."""
    order = sorted(range(buckets), key=lambda b: hashlib.md5(f"{seed + 2}:{b}".encode()).hexdigest())
    place = F.array(*(F.lit(order.index(b)) for b in range(buckets)))
    rows = df.withColumn("bucket", (uniform(F.col(key), seed + 1) * buckets).cast("int")).withColumn("_h", rank_hash(F.col(key), seed))
    return rows.repartitionById(buckets, F.element_at(place, F.col("bucket") + 1)).sortWithinPartitions("_h").drop("_h")


def disjoint(items: DataFrame, pool: str, item: str, fractions: dict[str, float], seed: int, floor: int = 1) -> DataFrame:
    """(pool, item, split): distinct items of each pool dealt out in hashed order.

    Every split gets ``floor`` items, then the whole part of its fraction of the remainder, and the last one
    what is left.  A pool with fewer items than floors gives no rows.  Items of one pool are ranked in one
    window: pools are word lists.
    """
    names = list(fractions)
    total = sum(fractions.values())
    rows = items.where(f"{item} is not null").select(pool, item).distinct()
    by = Window.partitionBy(pool)
    rows = rows.withColumn("_r", F.row_number().over(by.orderBy(rank_hash(F.col(item), seed))) - 1).withColumn("_n", F.count("*").over(by))
    rest = F.col("_n") - floor * len(names)
    edge: Column = F.lit(0)
    split: Column = F.lit(names[-1])
    edges = []
    for name in names[:-1]:
        edge = edge + floor + F.floor(rest * F.lit(fractions[name] / total))
        edges.append((edge, name))
    for e, name in reversed(edges):
        split = F.when(F.col("_r") < e, name).otherwise(split)
    return rows.where(rest >= 0).select(pool, item, split.alias("split"))


def draw(df: DataFrame, key: str, weights: list[tuple[str, float]], seed: int, name: str = "task") -> DataFrame:
    """df with a weighted choice for each row."""
    u = uniform(F.col(key), seed)
    total, upto = sum(w for _, w in weights), 0.0
    choice: Column = F.lit(weights[-1][0])
    steps = []
    for value, w in weights:
        upto += w / total
        steps.append((upto, value))
    for bound, value in reversed(steps[:-1]):
        choice = F.when(u < bound, value).otherwise(choice)
    return df.withColumn(name, choice)


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement: the first by hash, a top-n and no sort of all rows."""
    return df.orderBy(rank_hash(F.col(key), seed)).limit(n)
