"""Problem 4: same or near-same records across splits.

Texts are compared by a cosine join of shingle vectors, prompts by a cosine join of TF-IDF word vectors (see
setjoin and cosine); an exact check follows: the similarity of the sets for texts, the same facts and question
for prompts.  Shingle vectors have equal weights, so a Jaccard similarity of s is a cosine of at least
2 s / (1 + s), and the residual norm after the first i of n shingles is sqrt((n - i) / n).

Records of one set of shingles, or prompts of one form, are one class.  Classes are joined, not records; counts
come from the classes' sizes, and only ``pairs`` expands them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cosine, prompts, setjoin, slots
from ._spark import materialise

PROMPT_COSINE = 0.95
_VECTOR = pa.schema([("key", pa.int64()), ("form", pa.int64()), ("more", pa.int64()), ("terms", pa.binary()), ("weights", pa.binary())])


def _ready(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("body")).where("key is not null and body is not null")


@dataclass
class Overlap:
    """(key, class) of the training records and of the held-out ones, and links (a, b, ...) of similar classes."""

    train: DataFrame
    held: DataFrame
    links: DataFrame

    def pairs(self) -> DataFrame:
        """(train_key, held_key, ...) of all similar records."""
        x, y = (d.select(F.col("class").alias(k), F.col("key").alias(name)) for d, k, name in ((self.train, "a", "train_key"), (self.held, "b", "held_key")))
        return self.links.join(x, "a").join(y, "b").select("train_key", "held_key", *(c for c in self.links.columns if c not in "ab"))

    def partners(self) -> DataFrame:
        """(held_key, n_pairs): how many training records each held-out record that has one is similar to."""
        sizes = self.train.groupBy(F.col("class").alias("a")).agg(F.count("*").alias("n"))
        near = self.links.join(sizes, "a").groupBy("b").agg(F.sum("n").alias("n_pairs"))
        return self.held.withColumnRenamed("class", "b").join(near, "b").select(F.col("key").alias("held_key"), "n_pairs")


def text_overlap(train: DataFrame, held: DataFrame, key: str = "rec_id", text: str = "text", shingle: int = 3, similarity: float = 0.5, slot_bits: int = slots.SLOT_BITS) -> Overlap:
    """Texts whose shingle sets have at least this Jaccard similarity; links with their common shingles and all.

    Null keys, null texts and texts under ``shingle`` words are in no pair.  Equal sets have a similarity of 1.
    """
    c = 2 * similarity / (1 + similarity)

    def front(n):
        return np.where(n > 0, np.floor(n * (1 - c * c) + 1e-9).astype(np.int64) + 1, 0)

    def need(n, m):
        return np.ceil(c * np.sqrt(n * m) - 1e-9)

    j = setjoin.Join(_ready(train, key, text), _ready(held, key, text), shingle, similarity, front, need, c * c, 1 - c * c, slot_bits)
    x, y = (j.members.where(F.col("side") == side).select("key", F.col("sig").alias("class")) for side in (0, 1))
    one = F.lit(1).cast("long")
    same = x.select("class").distinct().join(y.select("class").distinct(), "class").select(F.col("class").alias("a"), F.col("class").alias("b"), one.alias("common"), one.alias("every"))
    return Overlap(x, y, j.links.select("a", "b", "common", "every").union(same))


def texts(train: DataFrame, held: DataFrame, key: str = "rec_id", text: str = "text", shingle: int = 3, similarity: float = 0.5) -> DataFrame:
    """(train_key, held_key, common, every) of similar texts; see text_overlap."""
    return text_overlap(train, held, key, text, shingle, similarity).pairs()


def _vectors(df: DataFrame, intros: set, log: np.ndarray) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast((intros, log))
    top = float(log.max()) / 8 + 1

    def emit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = shared.value
        for b in rows:
            out: tuple[list, ...] = ([], [], [], [], [])
            for key, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts = prompts.canonical(p, known)
                if not parts:
                    continue
                flat = "\n".join(" ".join(s) for s in parts).encode()
                h, n = np.unique(np.array([xxhash.xxh64_intdigest(w.encode()) for s in parts for w in s], dtype=np.uint64), return_counts=True)
                idf = top - table[slots.slot(h)] / 8
                for column, v in zip(out, (key, np.uint64(xxhash.xxh64_intdigest(flat)).astype(np.int64), np.uint64(xxhash.xxh64_intdigest(flat, 1)).astype(np.int64), *cosine.pack(h, np.stack([idf, idf * n], axis=1)))):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, _VECTOR)], schema=_VECTOR)

    return df.select("key", "body").mapInArrow(emit, "key long, form long, more long, terms binary, weights binary")


def prompt_overlap(train: DataFrame, held: DataFrame, key: str = "ex_id", text: str = "prompt", threshold: float = PROMPT_COSINE) -> Overlap:
    """Prompts whose words have at least this cosine; links with the cosine, and whether facts and question are the same.

    Word frequencies and introductions are those of all prompts.  Null keys, null prompts and prompts without
    words are in no pair.
    """
    left, right = _ready(train, key, text), _ready(held, key, text)
    both = left.union(right)
    intros = prompts.introductions(both)

    def things(part: pa.RecordBatch) -> np.ndarray:
        words = (w for p in part.column(0).to_pylist() for s in prompts.canonical(p, intros) for w in s)
        return np.array([xxhash.xxh64_intdigest(w.encode()) for w in words], dtype=np.uint64)

    log, _ = slots.log_counts(both.select("body"), "body", things)
    x, y = (materialise(_vectors(d, intros, log)).withColumn("class", F.struct("form", "more")) for d in (left, right))
    # one of each form, its smallest key standing for it
    one = [materialise(d.groupBy("class").agg(F.min(F.struct("key", "terms", "weights")).alias("v")).select("class", "v.*")) for d in (x, y)]
    near = cosine.join(*one, threshold)
    forms = [d.select(F.col("key").alias(k), F.col("class").alias(f"form_{k}")) for d, k in zip(one, "ab")]
    links = near.join(forms[0], "a").join(forms[1], "b").select(F.col("form_a").alias("a"), F.col("form_b").alias("b"), "cosine", (F.col("form_a") == F.col("form_b")).alias("same"))
    return Overlap(x.select("key", "class"), y.select("key", "class"), materialise(links))


def same_prompts(train: DataFrame, held: DataFrame, key: str = "ex_id", text: str = "prompt", threshold: float = PROMPT_COSINE) -> DataFrame:
    """(train_key, held_key, cosine) of prompts that state the same facts and ask the same question."""
    near = prompt_overlap(train, held, key, text, threshold)
    return Overlap(near.train, near.held, near.links.where("same").drop("same")).pairs()


def near_prompts(reasoning: DataFrame, threshold: float = PROMPT_COSINE) -> DataFrame:
    """(train_key, held_key, cosine, same): one row for each pair of near prompt forms, by their smallest keys."""
    near = prompt_overlap(*_splits(reasoning), threshold=threshold)
    low = [d.groupBy("class").agg(F.min("key").alias("key")) for d in (near.train, near.held)]
    return Overlap(*low, near.links).pairs()


def _splits(reasoning: DataFrame) -> tuple[DataFrame, DataFrame]:
    return reasoning.where("split = 'train'"), reasoning.where("split in ('val', 'test')")


def _both(train: DataFrame, held: DataFrame, reasoning: DataFrame) -> list[tuple[str, Overlap]]:
    near = prompt_overlap(*_splits(reasoning))
    return [("text", text_overlap(train, held)), ("prompt", Overlap(near.train, near.held, near.links.where("same")))]


def found(train: DataFrame, held: DataFrame, reasoning: DataFrame) -> DataFrame:
    """(field, train_key, held_key) of both fields."""
    a, b = (o.pairs().select(F.lit(field).alias("field"), "train_key", "held_key") for field, o in _both(train, held, reasoning))
    return a.union(b).distinct()


def counts(train: DataFrame, held: DataFrame, reasoning: DataFrame) -> DataFrame:
    """(field, split, source, n_pairs, n_records): overlaps of each evaluation split and source with training; no pair is made."""
    a, b = (o.partners().select(F.lit(field).alias("field"), "held_key", "n_pairs") for field, o in _both(train, held, reasoning))
    about = held.select(F.lit("text").alias("field"), F.col("rec_id").alias("held_key"), "split", "source").union(reasoning.select(F.lit("prompt"), "ex_id", "split", "source")).dropDuplicates(["field", "held_key"])
    rows = a.union(b).dropDuplicates(["field", "held_key"]).join(about, ["field", "held_key"])
    return rows.groupBy("field", "split", "source").agg(F.sum("n_pairs").alias("n_pairs"), F.count("*").alias("n_records"))
