"""Token sequences: packing into blocks, chunks for evaluation, loss masks, length buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import running_total
from .splits import rank_hash

EOS, PAD, IGNORED = 3, 0, -100


def pack(df: DataFrame, order: str, ids: str, block: int = 512, eos: int = EOS) -> DataFrame:
    """(block_no, input_ids, targets): all documents in order, each followed by eos, cut into blocks.

    Block k has positions k * block to (k + 1) * block of the stream; its last position is also the first of
    the next block, as targets are the inputs moved by one.  A tail shorter than block + 1 is left out.
    Documents are placed by a prefix sum of their lengths; only a block's own positions meet in one task.
    """
    tokens = F.concat(F.coalesce(ids, F.array().cast("array<int>")), F.array(F.lit(eos)))
    docs = df.select(F.col(order), tokens.alias("t")).withColumn("n", F.size("t"))
    placed = running_total(docs, [order], F.col("n"), "begin")
    first, last = F.col("begin") / block, (F.col("begin") + F.col("n") - 1) / block
    # the piece of each document in each block, with the extra position at the block's end
    pieces = placed.select("begin", "t", "n", F.explode(F.sequence(F.greatest(F.floor(first) - 1, F.lit(0)), F.floor(last))).alias("block_no"))
    low = F.greatest(F.col("begin"), F.col("block_no") * block)
    high = F.least(F.col("begin") + F.col("n"), F.col("block_no") * block + block + 1)
    cut = pieces.where(low < high).select("block_no", low.alias("low"), F.slice("t", (low - F.col("begin") + 1).cast("int"), (high - low).cast("int")).alias("part"))
    joined = cut.groupBy("block_no").agg(F.array_sort(F.collect_list(F.struct("low", "part"))).alias("parts"))
    whole = joined.select("block_no", F.flatten(F.col("parts.part")).alias("s")).where(F.size("s") == block + 1)
    return whole.select("block_no", F.slice("s", 1, block).alias("input_ids"), F.slice("s", 2, block).alias("targets"))


def chunks(df: DataFrame, key: str, ids: str, n_bytes: str, width: int = 512, eos: int = EOS, pad: int = PAD) -> DataFrame:
    """(key, chunk_no, input_ids, targets, num_tokens, num_bytes): one document at a time, padded on the right.

    Documents under two tokens are left out; eos is appended; bytes stand on the first chunk only.
    """
    docs = df.where(F.size(ids) >= 2).select(key, n_bytes, F.concat(F.col(ids), F.array(F.lit(eos))).alias("t"))
    starts = F.sequence(F.lit(0), F.size("t") - 2, F.lit(width))
    rows = docs.select(key, n_bytes, "t", F.posexplode(starts).alias("chunk_no", "s"))
    full = rows.withColumn("x", F.slice("t", F.col("s") + 1, width + 1)).withColumn("n", F.size("x") - 1)
    padded = lambda a: F.concat(a, F.array_repeat(F.lit(pad), F.lit(width) - F.col("n")))
    return full.select(
        key, "chunk_no", padded(F.slice("x", F.lit(1), F.col("n"))).alias("input_ids"), padded(F.slice("x", F.lit(2), F.col("n"))).alias("targets"),
        F.col("n").alias("num_tokens"), F.when(F.col("chunk_no") == 0, F.col(n_bytes)).otherwise(F.lit(0)).cast("long").alias("num_bytes"),
    )


def masked(df: DataFrame, key: str, prompt_ids: str, answer_ids: str, most: int | None = None) -> DataFrame:
    """(key, input_ids, labels) of prompt and answer; labels of the prompt are ignored. Longer rows than ``most`` go."""
    rows = df.select(key, F.concat(prompt_ids, answer_ids).alias("full"), F.size(prompt_ids).alias("n"))
    if most is not None:
        rows = rows.where(F.size("full") <= most)
    labels = F.transform(F.slice("full", F.lit(2), F.size("full") - 1), lambda x, i: F.when(i < F.col("n") - 1, IGNORED).otherwise(x))
    return rows.where(F.size("full") >= 2).select(key, F.slice("full", F.lit(1), F.size("full") - 1).alias("input_ids"), labels.alias("labels"))


def length_buckets(df: DataFrame, key: str, length: str, batch: int, seed: int = 0) -> DataFrame:
    """(key, length, batch_no, batch_order): batches of rows of like length, and a hashed order of the batches."""
    from .ordered import row_index

    rows = df.select(key, length, rank_hash(F.col(key), seed).alias("_h"))
    placed = row_index(rows, [length, "_h"], "_i").withColumn("batch_no", F.floor(F.col("_i") / batch))
    return placed.select(key, length, "batch_no", rank_hash(F.col("batch_no"), seed + 1).alias("batch_order"))


def padding_waste(buckets: DataFrame, length: str) -> DataFrame:
    """Padded by real tokens, if each batch is padded to its longest row."""
    per = buckets.groupBy("batch_no").agg((F.max(length) * F.count("*")).alias("padded"), F.sum(length).alias("real"))
    return per.agg(F.round(F.sum("padded") / F.sum("real"), 4).alias("waste"))


def continued(df: DataFrame, key: str, ids: str, most: int, share: float = 0.5, least: int = 10, most_reference: int = 100) -> DataFrame:
    """(key, prefix, reference): sequences cut into what is given and what is to be generated.

    The prefix has the share of the sequence, five positions at least and ten fewer than the model's ``most`` at
    most; the reference the positions after it.  Sequences under ``least`` positions, or with under five to
    generate, are left out.
    """
    n = F.size(ids)
    cut = F.least(F.greatest(F.lit(5), F.floor(n * share).cast("int")), F.lit(most - 10))
    rows = df.where(n >= least).select(key, F.slice(F.col(ids), F.lit(1), cut).alias("prefix"), F.slice(F.col(ids), cut + 1, F.lit(most_reference)).alias("reference"))
    return rows.where(F.size("reference") >= 5)
