"""Decoding filters, learning rates, early stopping and rate limits, over tables of logits, losses and events."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def repetition_penalty(logit: Column, seen: Column, penalty: float) -> Column:
    """Positive logits of seen tokens are divided by the penalty, negative ones multiplied."""
    return F.when(seen & (logit > 0), logit / penalty).when(seen, logit * penalty).otherwise(logit)


def softmax(df: DataFrame, by: list[str], logit: str, temperature: float = 1.0, name: str = "p") -> DataFrame:
    w = Window.partitionBy(*by)
    z = F.col(logit) / temperature
    e = F.exp(z - F.max(z).over(w))
    return df.withColumn("_e", e).withColumn(name, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def top_k(df: DataFrame, by: list[str], logit: str, k: int) -> DataFrame:
    """Rows whose logit is at least the k-th; ties stay."""
    return df.withColumn("_r", F.rank().over(Window.partitionBy(*by).orderBy(F.desc(logit)))).where(F.col("_r") <= k).drop("_r")


def top_p(df: DataFrame, by: list[str], logit: str, token: str, p: float) -> DataFrame:
    """Rows before which the probabilities sum up to at most p; the first always stays."""
    rows = softmax(df, by, logit, name="_p")
    before = F.sum("_p").over(Window.partitionBy(*by).orderBy(F.desc(logit), token).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_c", F.coalesce(before, F.lit(0.0))).where(F.col("_c") <= p).drop("_p", "_c")


def learning_rate(step: Column, warmup: int, last: int, floor: float = 0.1) -> Column:
    """Linear warmup, then half a cosine down to the floor."""
    progress = F.least(F.lit(1.0), (step - warmup) / float(max(1, last - warmup)))
    return F.when(step < warmup, step / float(max(1, warmup))).otherwise(F.greatest(F.lit(floor), 0.5 * (1 + F.cos(math.pi * progress))))


def early_stop(df: DataFrame, run: str, step: str, loss: str, patience: int = 6, after: int = 200) -> DataFrame:
    """df with best_before, improved, bad (evaluations since the last improvement) and stop. One run's evaluations are few."""
    w = Window.partitionBy(run).orderBy(step)
    rows = df.withColumn("best_before", F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("improved", F.col("best_before").isNull() | (F.col(loss) < F.col("best_before")))
    rows = rows.withColumn("_g", F.sum(F.col("improved").cast("int")).over(w))
    rows = rows.withColumn("bad", (F.row_number().over(Window.partitionBy(run, "_g").orderBy(step)) - 1).cast("long")).drop("_g")
    return rows.withColumn("stop", (F.col("bad") >= patience) & (F.col(step) > after))


def rate_window(df: DataFrame, key: str, order: str, at: str, amount: str, seconds: int = 60) -> DataFrame:
    """df with requests and amount of the last ``seconds`` before and with each row, of the same key.

    Ordered by second, so rows of one second see each other.
    """
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-(seconds - 1), 0)
    return df.withColumn("requests", F.count("*").over(w)).withColumn("spent", F.sum(amount).over(w))
