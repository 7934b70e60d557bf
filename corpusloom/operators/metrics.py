"""Scores of generated texts against references, and language-model losses."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import runs


def gram_counts(df: DataFrame, key: str, items: str, orders: int) -> DataFrame:
    """(key, n, gram, count) for runs of 1 to ``orders`` items; counting combines before the shuffle."""

    def of(n: int) -> Column:
        return F.transform(runs(F.col(items), n, "\x1f"), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))

    every = F.flatten(F.array(*(of(n) for n in range(1, orders + 1))))
    return df.select(key, F.explode(every).alias("g")).groupBy(key, F.col("g.n").alias("n"), F.col("g.gram").alias("gram")).agg(F.count("*").alias("count"))


def _in_row(reference: Column, hypothesis: Column, orders: int) -> Column:
    """For each order matched, hypothesis' and reference's n-grams of one pair, counted inside the row."""

    fields = [T.StructField("n", T.IntegerType()), *(T.StructField(f, T.LongType()) for f in ("matched", "n_hyp", "n_ref"))]

    @F.arrow_udf(T.ArrayType(T.StructType(fields)))
    def count(ref: pa.Array, hyp: pa.Array) -> pa.Array:
        out = []
        for r, h in zip(ref.to_pylist(), hyp.to_pylist()):
            r, h = r or [], h or []
            row = []
            for n in range(1, orders + 1):
                a, b = (Counter(zip(*(x[i:] for i in range(n)))) for x in (r, h))
                row.append({"n": n, "matched": sum((a & b).values()), "n_hyp": max(len(h) - n + 1, 0), "n_ref": max(len(r) - n + 1, 0)})
            out.append(row)
        return pa.array(out, pa.list_(pa.struct([("n", pa.int32()), *((f, pa.int64()) for f in ("matched", "n_hyp", "n_ref"))])))

    return count(reference, hypothesis)


def matches(pairs: DataFrame, key: str, reference: str, hypothesis: str, orders: int) -> DataFrame:
    """(key, n, matched, n_hyp, n_ref): clipped n-gram matches of each pair, one row for each order.

    All that meets is in one row, so nothing is exchanged.  A null is a text without items; repeated rows of a key
    give repeated rows.
    """
    return pairs.select(key, F.inline(_in_row(F.col(reference), F.col(hypothesis), orders)))


def bleu(pairs: DataFrame, key: str, reference: str, hypothesis: str, orders: int = 4) -> DataFrame:
    """One row: corpus BLEU, pooled clipped precisions with a floor of 1e-10, brevity penalty; 0 without hypothesis words."""
    m = matches(pairs, key, reference, hypothesis, orders)
    of = lambda c, n: F.coalesce(F.sum(F.when(F.col("n") == n, F.col(c))), F.lit(0))
    sums = m.agg(of("n_ref", 1).alias("r"), of("n_hyp", 1).alias("c"), *((of("matched", n) / F.greatest(of("n_hyp", n), F.lit(1))).alias(f"p{n}") for n in range(1, orders + 1)))
    logs = sum((F.ln(F.greatest(f"p{n}", F.lit(1e-10))) for n in range(2, orders + 1)), F.ln(F.greatest("p1", F.lit(1e-10)))) / orders
    brevity = F.when(F.col("c") < F.col("r"), F.exp(1 - F.col("r") / F.col("c"))).otherwise(1.0)
    return sums.select(F.when(F.col("c") == 0, 0.0).otherwise(F.round(brevity * F.exp(logs) * 100, 2)).alias("bleu"))


def chrf(pairs: DataFrame, key: str, reference: str, hypothesis: str, orders: int = 6, beta: float = 2.0) -> DataFrame:
    """One row: precision and recall of character n-grams averaged over all pairs and orders, then their F-score."""
    split = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda x: x != "")
    chars = pairs.select(key, split(reference).alias("r"), split(hypothesis).alias("h"))
    m = matches(chars, key, "r", "h", orders)
    avg = m.agg(F.coalesce(F.avg(F.col("matched") / F.greatest("n_hyp", F.lit(1))), F.lit(0.0)).alias("p"), F.coalesce(F.avg(F.col("matched") / F.greatest("n_ref", F.lit(1))), F.lit(0.0)).alias("r"))
    score = (1 + beta**2) * F.col("p") * F.col("r") / (beta**2 * F.col("p") + F.col("r"))
    return avg.select(F.when(F.col("p") + F.col("r") == 0, 0.0).otherwise(F.round(score * 100, 2)).alias("chrf"))


@F.arrow_udf(T.IntegerType())
def lcs(a: pa.Array, b: pa.Array) -> pa.Array:
    """Length of the longest common subsequence of two lists; null is an empty list.

    The table's rows are NumPy vectors: a row is the prefix maximum of the row before it and of its matches.
    """
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist()):
        number: dict = {}
        x, y = (np.array([number.setdefault(w, len(number)) for w in z or []], dtype=np.int64) for z in (x, y))
        row = np.zeros(len(y) + 1, dtype=np.int32)
        for v in x[np.isin(x, y)].tolist():
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(y == v, row[:-1] + 1, 0)))
        out.append(int(row[-1]))
    return pa.array(out, pa.int32())


def rouge_l(pairs: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """One row: mean F1 of the longest common subsequence."""
    n = lcs(F.col(reference), F.col(hypothesis))
    rows = pairs.select(n.alias("n"), F.size(reference).alias("r"), F.size(hypothesis).alias("h"))
    p, r = F.col("n") / F.greatest("h", F.lit(1)), F.col("n") / F.greatest("r", F.lit(1))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return rows.agg(F.round(F.coalesce(F.avg(f1), F.lit(0.0)) * 100, 2).alias("rouge_l"))


def diversity(df: DataFrame, key: str, items: str) -> DataFrame:
    """One row: distinct unigrams and bigrams by all of them, and repeated by all 4-grams of each text."""
    c = gram_counts(df, key, items, 4)
    pooled = c.where("n <= 2").groupBy("n", "gram").agg(F.sum("count").alias("k")).groupBy("n").agg((F.count("*") / F.sum("k")).alias("v"))
    repeated = c.where("n = 4").agg((F.sum(F.col("count") - 1) / F.sum("count")).alias("v"))
    one = lambda n: F.coalesce(F.max(F.when(F.col("n") == n, F.col("v"))), F.lit(0.0))
    return pooled.agg(F.round(one(1), 4).alias("distinct_1"), F.round(one(2), 4).alias("distinct_2")).crossJoin(repeated.select(F.round(F.coalesce("v", F.lit(0.0)), 4).alias("repetition_4")))


def loss(df: DataFrame, by: list[str], nll: str, n_tokens: str, n_bytes: str) -> DataFrame:
    """Cross-entropy, perplexity and bits a byte from summed losses (in nats), tokens and bytes."""
    sums = df.groupBy(*by).agg(F.sum(nll).alias("nats"), F.sum(n_tokens).alias("tokens"), F.sum(n_bytes).alias("bytes"))
    ce = F.col("nats") / F.greatest("tokens", F.lit(1))
    return sums.select(*by, F.round(ce, 4).alias("cross_entropy"), F.round(F.exp(F.least(ce, F.lit(20.0))), 2).alias("perplexity"), F.round(F.col("nats") / (F.greatest("bytes", F.lit(1)) * F.ln(F.lit(2.0))), 4).alias("bits_per_byte"), F.col("tokens").cast("long").alias("tokens"))


def forgetting(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """Change of perplexity and bits a byte, share retained (at most 100), and a verdict."""
    b, a = (d.select(by, F.col("perplexity").alias(f"ppl_{s}"), F.col("bits_per_byte").alias(f"bpb_{s}")) for d, s in ((before, "before"), (after, "after")))
    kept = F.least(F.lit(100.0), F.col("ppl_before") / F.greatest(F.col("ppl_after"), F.lit(0.001)) * 100)
    verdict = F.when(kept >= 90, "preserved").when(kept >= 75, "partly forgotten").otherwise("forgotten")
    return b.join(a, by).select(by, F.round(F.col("ppl_after") - F.col("ppl_before"), 4).alias("ppl_change"), F.round(F.col("bpb_after") - F.col("bpb_before"), 4).alias("bpb_change"), F.round(kept, 2).alias("retained"), verdict.alias("verdict"))


def mean_of_means(df: DataFrame, by: list[str], mean: str, rows: str, order: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Batch means weighted by the batches' rows, not by tokens; with ``most``, of the first so many batches by ``order``."""
    if most is not None:
        df = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*(order or [])))).where(F.col("_r") <= most)
    return df.groupBy(*by).agg(F.round(F.sum(F.col(mean) * F.col(rows)) / F.sum(rows), 6).alias("loss"))


def fertility(df: DataFrame, by: list[str], n_tokens: str, n_words: Column, n_chars: Column, n_unknown: Column) -> DataFrame:
    """Tokens a word, characters a token and unknown tokens by all, as ratios of sums; 0 where nothing is counted."""
    s = df.groupBy(*by).agg(F.sum(n_tokens).cast("long").alias("tokens"), F.sum(n_words).cast("long").alias("words"), F.sum(n_chars).cast("long").alias("chars"), F.sum(n_unknown).cast("long").alias("unknown"))
    ratio = lambda a, b, k: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), k)
    return s.select(*by, "tokens", "words", ratio("tokens", "words", 4).alias("fertility"), ratio("chars", "tokens", 4).alias("chars_per_token"), ratio("unknown", "tokens", 8).alias("unknown_rate"))
