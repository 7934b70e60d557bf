"""Problem 2: near-duplicate records with small edits, insertions or reordering.

The method asked for is a Jaccard metric-space join: pivots, Voronoi regions, windows by the triangle
inequality.  It can't give the result at this similarity: records count as similar up to a distance of
1/2, so a window is 2 * 1/2 = 1 wide, and no two Jaccard distances differ by more than 1.  Every record
would be copied into every region, at each level of the recursion, whatever the pivots are.  The same
exact result comes from a prefix-filtered join over inverted lists instead (see setjoin); the README has
the figures for 64 pivots.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import setjoin
from .graph import components


class NearDuplicates:
    """Pairs and groups of records whose sets of word shingles have a Jaccard similarity of at least threshold.

    df needs a BIGINT key, unique, and a text column; other columns are ignored.  Records with a null key,
    a null text or fewer than ``shingle`` words are in no pair and in no group.  Records with equal sets
    have the similarity 1.  Repeated rows of one key count as that record.
    """

    def __init__(self, df: DataFrame, key: str = "rec_id", text: str = "text", shingle: int = 5, threshold: float = 0.8, slot_bits: int = setjoin.slots.SLOT_BITS):
        if not 0 < threshold <= 1 or shingle < 1:
            raise ValueError("threshold must be in (0, 1] and shingle at least 1")
        df = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("body")).where("key is not null and body is not null")
        t = threshold

        def front(n):
            return np.where(n > 0, n - np.ceil(t * n - 1e-9).astype(np.int64) + 1, 0)

        def need(n, m):
            return np.ceil(t / (1 + t) * (n + m) - 1e-9)

        joined = setjoin.Join(df, None, shingle, t, front, need, t, 1 - t, slot_bits)
        #: Signature of each record.
        self.members = joined.members.select("sig", "key")
        #: Verified pairs of signatures (a, b, common, every), in the shared folder.
        self.links = joined.links

    def pairs(self) -> DataFrame:
        """(id_a, id_b, common, every) of all similar pairs, copies included, the smaller key first."""
        x, y = (self.members.select(F.col("sig").alias(s), F.col("key").alias(k)) for s, k in (("a", "ka"), ("b", "kb")))
        across = self.links.join(x, "a").join(y, "b").select("ka", "kb", "common", "every")
        many = self.members.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1").select("sig")
        own = self.members.join(many, "sig")
        same = own.select("sig", F.col("key").alias("ka")).join(own.select("sig", F.col("key").alias("kb")), "sig").where("ka < kb")
        same = same.select("ka", "kb", F.lit(1).cast("long").alias("common"), F.lit(1).cast("long").alias("every"))
        return across.union(same).select(F.least("ka", "kb").alias("id_a"), F.greatest("ka", "kb").alias("id_b"), "common", "every")

    def groups(self) -> DataFrame:
        """(key, class_id, n_links): each record that has a shingle, its group's smallest key, and how many records are similar to it."""
        sizes = self.members.groupBy("sig").agg(F.count("*").alias("n"), F.min("key").alias("low"))
        both = self.links.select("a", "b").union(self.links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.join(sizes.select(F.col("sig").alias("b"), "n"), "b").groupBy(F.col("a").alias("sig")).agg(F.sum("n").alias("near"))
        roots = components(self.links).select(F.col("v").alias("sig"), "root")
        placed = sizes.join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
        lows = placed.groupBy("root").agg(F.min("low").alias("class_id"))
        flat = placed.join(lows, "root").join(near, "sig", "left").select("sig", "class_id", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
        return self.members.join(flat, "sig").select("key", "class_id", "n_links")

