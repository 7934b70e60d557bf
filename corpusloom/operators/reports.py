"""Grouped accuracy, error classes, comparisons, frequency and length tables, and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Answers that are no names, and words that mark a reasoning step.
PLAIN_ANSWERS = ("हाँ", "हो", "होइन", "नही", "नहीं", "बराबर")
STEP_WORDS = ("तर्क", "कारण", "भन्दा", "से")


def error_class(format_ok: Column, predicted: Column, prompt: Column, task: Column, generated: Column) -> Column:
    """The first class that fits a wrong prediction."""
    numeric = F.coalesce(F.rlike(predicted, F.lit(r"\p{Nd}")), F.lit(False))
    known = F.coalesce(F.contains(prompt, predicted), F.lit(False)) | F.coalesce(predicted.isin(*PLAIN_ANSWERS), F.lit(False))
    steps = F.coalesce(F.rlike(generated, F.lit("|".join(STEP_WORDS))), F.lit(False))
    return (
        F.when(~F.coalesce(format_ok, F.lit(False)), "format_error")
        .when(~numeric & (F.length(predicted) > 1) & ~known, "hallucination_error")
        .when(numeric | F.rlike(task, F.lit("calc|age|distance")), "calculation_error")
        .when(steps, "reasoning_step_error")
        .otherwise("conclusion_error")
    )


def lenient_match(predicted: Column, gold: Column) -> Column:
    """Either answer is part of the other; an empty prediction matches nothing."""
    return (F.length(predicted) > 0) & (F.contains(gold, predicted) | F.contains(predicted, gold))


def accuracy(df: DataFrame, *by: str) -> DataFrame:
    """Accuracy, format rate and answer-in-text rate: overall and by each column, in one pass of grouping sets."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 4)
    sets = df.groupingSets([[], *([F.col(c)] for c in by)], *(F.col(c) for c in by))
    return sets.agg(F.count("*").alias("n"), rate("correct").alias("accuracy"), rate("format_ok").alias("format_rate"), rate("answer_in_text").alias("in_text_rate"))


def error_shares(df: DataFrame, error: str = "error_type") -> DataFrame:
    """Wrong predictions by class, and each class's share."""
    counts = df.where(F.col(error).isNotNull()).groupBy(F.col(error).alias("error_type")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def compare_arms(first: DataFrame, second: DataFrame, by: str) -> DataFrame:
    """Accuracy of two runs for each value; what the first has not counts as 0."""
    acc = lambda d, n: d.groupBy(by).agg(F.avg(F.col("correct").cast("int")).alias(n))
    both = acc(second, "after").join(acc(first, "before"), by, "left")
    before = F.coalesce("before", F.lit(0.0))
    return both.select(by, F.round(before, 4).alias("before"), F.round("after", 4).alias("after"), F.round(F.col("after") - before, 4).alias("change"))


def compare_runs(df: DataFrame, run: str, base: str, by: str) -> DataFrame:
    """(run, by, before, after, change): accuracy of every run against the base run; what the base has not counts as 0."""
    acc = df.groupBy(run, by).agg(F.avg(F.col("correct").cast("int")).alias("after"))
    first = acc.where(F.col(run) == base).select(by, F.col("after").alias("before"))
    before = F.coalesce("before", F.lit(0.0))
    return acc.join(first, by, "left").select(run, by, F.round(before, 4).alias("before"), F.round("after", 4).alias("after"), F.round(F.col("after") - before, 4).alias("change"))


def frequencies(df: DataFrame, *columns: str) -> DataFrame:
    """(column, value, n): counts of the values of each column, all in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))


def length_table(df: DataFrame, by: str, length: str) -> DataFrame:
    """Mean (one place), upper median, 95th percentile by index, and maximum.

    Order statistics come from counts of each length, whose number is bounded by the longest, not from sorted
    lists of all rows.
    """
    counts = df.where(F.col(length).isNotNull()).groupBy(by, F.col(length).cast("long").alias("v")).agg(F.count("*").alias("k"))
    w = Window.partitionBy(by)
    ranked = counts.withColumn("upto", F.sum("k").over(w.orderBy("v"))).withColumn("n", F.sum("k").over(w))
    at = lambda index: F.min(F.when(F.col("upto") > index, F.col("v")))
    return ranked.groupBy(by).agg(
        F.max("n").alias("n"), F.round(F.sum(F.col("v") * F.col("k")) / F.max("n"), 1).alias("mean"), at(F.floor(F.col("n") / 2)).alias("median"),
        at(F.floor(0.95 * (F.col("n") - 1))).alias("p95"), F.max("v").alias("max"),
    )


def shared(df: DataFrame, part: str, value: Column) -> DataFrame:
    """(part_a, part_b, n): values that two parts have in common, for each pair of parts, zeros included."""
    seen = df.select(F.col(part).alias("p"), value.alias("v")).where("v is not null").distinct()
    x, y = seen.select(F.col("p").alias("part_a"), "v"), seen.select(F.col("p").alias("part_b"), "v")
    found = x.join(y, "v").where("part_a < part_b").groupBy("part_a", "part_b").agg(F.count("*").alias("n"))
    parts = df.select(F.col(part).alias("p")).where("p is not null").distinct()
    pairs = parts.select(F.col("p").alias("part_a")).join(parts.select(F.col("p").alias("part_b")), F.col("part_a") < F.col("part_b"))
    return pairs.join(found, ["part_a", "part_b"], "left").select("part_a", "part_b", F.coalesce("n", F.lit(0)).alias("n"))


def gaps(spec: DataFrame, rows: DataFrame, by: str, least: int) -> DataFrame:
    """(value, n): values of the specification with fewer than ``least`` rows."""
    n = rows.groupBy(by).agg(F.count("*").alias("n"))
    return spec.select(by).distinct().join(n, by, "left").select(by, F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < least)


def first_of_each(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group.

    The window is bounded by rank, so Spark keeps n rows of a group in each task before the shuffle.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def coverage(spec: DataFrame, rows: DataFrame, least: Column) -> DataFrame:
    """(kind, value, n, least): what a specification (kind, value) asks for and rows (kind, value) have too few of."""
    n = rows.groupBy("kind", "value").agg(F.count("*").alias("n"))
    both = spec.select("kind", "value").distinct().join(n, ["kind", "value"], "left").select("kind", "value", F.coalesce("n", F.lit(0)).alias("n"), least.alias("least"))
    return both.where(F.col("n") < F.col("least"))


def previews(df: DataFrame, by: list[str], order: list[str], n: int, texts: dict[str, int]) -> DataFrame:
    """The first n rows of each group with the beginnings of their texts, in characters."""
    rows = first_of_each(df, by, order, n)
    return rows.select(*by, *order, "rank", *(F.substring(c, 1, k).alias(c) for c, k in texts.items()))
