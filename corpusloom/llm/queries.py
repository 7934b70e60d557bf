"""Registered queries over the problems' operators: (spark, folder of the tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import leakage, lookalikes, main_content, packing, repetition, split_overlap, sql, standing_lines, tokens
from ._spark import table
from .near_duplicates import NearDuplicates


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return standing_lines.lines_of(standing_lines.standing(table(spark, folder, "documents")))


def p1_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return standing_lines.cleaned(table(spark, folder, "documents"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    near = NearDuplicates(table(spark, folder, "train"), shingle=3, threshold=0.5)
    return near.pairs().select("id_a", "id_b")


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate classes of the default parameters: five words, similarity 0.8."""
    return NearDuplicates(table(spark, folder, "train")).groups().withColumnRenamed("key", "rec_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.twins(table(spark, folder, "train"))


def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Records by their consistent form, without pairs."""
    return lookalikes.classes(table(spark, folder, "train"))


def p3_normalised(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.normalised(table(spark, folder, "train"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = split_overlap.found(*(table(spark, folder, t) for t in ("train", "holdout", "reasoning")))
    return rows.select("field", F.least("train_key", "held_key").alias("id_a"), F.greatest("train_key", "held_key").alias("id_b"))


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    return split_overlap.counts(*(table(spark, folder, t) for t in ("train", "holdout", "reasoning")))


def p4_near_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation prompts near a training prompt, the same problem or not."""
    return split_overlap.near_prompts(table(spark, folder, "reasoning"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return main_content.content(table(spark, folder, "crawl_pages"))


def p5_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return main_content.cleaned(table(spark, folder, "crawl_pages"))


def p6_record_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.counted(table(spark, folder, "train"), table(spark, folder, "vocab"), keep=("rec_id", "source", "lang", "domain"))


def p6_token_budget(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.budget(table(spark, folder, "train"), table(spark, folder, "vocab"))


def p6_unigram_budget(spark: SparkSession, folder: str) -> DataFrame:
    """The same totals by best paths, the pieces taken for a unigram vocabulary."""
    vocab = table(spark, folder, "vocab")
    return tokens.budget(table(spark, folder, "train"), None, counters=tokens.unigram_counters(vocab))


def p7_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of 512 tokens for all documents."""
    sized = tokens.counted(table(spark, folder, "documents"), table(spark, folder, "vocab"), keep=("doc_id",))
    return packing.packed(sized, capacity=512)


def p7_placed(spark: SparkSession, folder: str) -> DataFrame:
    """For each document its tokens in blocks, its pieces, and whether all its blocks hold at most 512."""
    rows = p7_blocks(spark, folder)
    full = rows.where("block_id is not null").groupBy("block_id").agg((F.sum("n_tokens") <= 512).alias("fits"))
    return rows.join(full, "block_id", "left").groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_pieces"), F.min(F.coalesce("fits", F.lit(True))).alias("fits"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_passages(spark, folder).select("doc_id", "item_id")


def p8_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Copies with their longest run and subsequence."""
    return leakage.found(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_paraphrases(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a copy of an item's passage or one in other words."""
    return leakage.retrieved(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.repetitive(table(spark, folder, "documents")).select("doc_id")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Words, repeated words and share of every document."""
    return repetition.scored(table(spark, folder, "documents")).select("doc_id", "n_words", "repeated", F.round("share", 6).alias("share"))


def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The trees' score of every document."""
    return repetition.scored(table(spark, folder, "documents")).select("doc_id", "share", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_cleaned": p1_cleaned,
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p3_found": p3_found,
    "p3_normalised": p3_normalised,
    "p3_classes": p3_classes,
    "p4_found": p4_found,
    "p4_counts": p4_counts,
    "p4_near_prompts": p4_near_prompts,
    "p5_found": p5_found,
    "p5_cleaned": p5_cleaned,
    "p6_token_budget": p6_token_budget,
    "p6_record_tokens": p6_record_tokens,
    "p6_unigram_budget": p6_unigram_budget,
    "p7_blocks": p7_blocks,
    "p7_placed": p7_placed,
    "p8_found": p8_found,
    "p8_passages": p8_passages,
    "p8_paraphrases": p8_paraphrases,
    "p9_found": p9_found,
    "p9_shares": p9_shares,
    "p9_scores": p9_scores,
}

SQL: dict[str, str] = sql.SQL
