"""Reject cascade, cleaning funnel and text statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import spread_small


@dataclass(frozen=True)
class Limits:
    """Thresholds of the cascade."""

    length: int = 100
    n_words: int = 10
    word: int = 30
    punctuation: float = 0.20
    script: float = 0.95
    script_pattern: str = T.SCRIPT
    letter_pattern: str = T.LETTERS


def drop_reason(clean: Column, n_words: Column, longest: Column, limits: Limits = Limits()) -> Column:
    """The first failing test of a cleaned text, or null: short, word_length, noise, ratio. Cheap tests come first."""
    letters = T.count_of(clean, limits.letter_pattern)
    in_script = T.count_of(clean, limits.script_pattern)
    return (
        F.when(F.length(clean) < limits.length, "short")
        .when(n_words < limits.n_words, "short")
        .when(longest > limits.word, "word_length")
        .when(T.punctuation_count(clean) / F.length(clean) > limits.punctuation, "noise")
        .when((letters == 0) | (in_script / letters < limits.script), "ratio")
    )


def labelled(df: DataFrame, key: str = "doc_id", text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """(key, n_bytes, clean, n_words, longest, reason) of every row; a null text is malformed."""
    rows = spread_small(df.select(key, text)).select(F.col(key), F.octet_length(text).cast("long").alias("n_bytes"), T.cleaned(F.col(text)).alias("c"))
    rows = rows.select(key, "n_bytes", F.col("c.text").alias("clean"), F.col("c.n_words").alias("n_words"), F.col("c.longest").alias("longest"))
    return rows.withColumn("reason", F.when(F.col("clean").isNull(), "malformed").otherwise(drop_reason(F.col("clean"), F.col("n_words"), F.col("longest"), limits)))


def funnel(df: DataFrame, key: str = "doc_id", text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """Documents and bytes by outcome; ``kept`` for those that pass."""
    rows = labelled(df, key, text, limits)
    return rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n_docs"), F.sum(F.coalesce("n_bytes", F.lit(0))).cast("long").alias("n_bytes"))


def cleaned(df: DataFrame, key: str = "doc_id", text: str = "text", limits: Limits = Limits()) -> DataFrame:
    return labelled(df, key, text, limits).where("reason is null").select(key, F.col("clean").alias("text"), "n_words")


def reduction(df: DataFrame, **how) -> DataFrame:
    """One row: documents and megabytes read and kept, and the percentage of documents lost (0 if none was read)."""
    f = funnel(df, **how)
    read, kept = F.sum("n_docs"), F.coalesce(F.sum(F.when(F.col("outcome") == "kept", F.col("n_docs"))), F.lit(0))
    return f.agg(F.coalesce(read, F.lit(0)).alias("docs_read"), kept.alias("docs_kept"), F.round(F.coalesce(F.sum("n_bytes"), F.lit(0)) / 1048576, 4).alias("mb_read"), F.coalesce(F.round(100 * (1 - F.try_divide(kept, read)), 4), F.lit(0.0)).alias("percent_lost"))


def text_stats(df: DataFrame, by: str, text: str = "text") -> DataFrame:
    w = T.word_count(F.col(text))
    return df.groupBy(by).agg(F.count("*").alias("n_docs"), F.sum(w).cast("long").alias("n_words"), F.coalesce(F.sum(F.length(text)), F.lit(0)).cast("long").alias("n_chars"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long").alias("n_bytes"))
