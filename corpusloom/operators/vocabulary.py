"""Tokens of a vocabulary of merges: ids, counts, and characters it doesn't have.

A text is cut at white space; each word starts with U+2581 and is joined from single characters, always the
neighbours of the lowest id first.  A character without an entry is the unknown token.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_MARK, UNKNOWN, DEFAULT_LANG = "▁", 1, "hi"
#: Entries of a vocabulary that are sent to all tasks at most, and words whose ids a task keeps.
MOST_PIECES, CACHE = 4_000_000, 500_000


def merged(word: str, merges: dict[tuple[str, str], int]) -> list[str]:
    """The pieces of a word: always the pair of the lowest rank is joined next, the leftmost of several.

    A heap of pairs over a linked list keeps very long words near-linear.
    """
    parts = list(word)
    n = len(parts)
    if n < 2:
        return parts
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank = merges.get
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank((parts[i], parts[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if parts[i] == a else n
        if j >= n or parts[j] != b:
            continue
        parts[i], parts[j] = a + b, ""
        k = after[j]
        after[i] = k
        if k < n:
            before[k] = i
            if (r := rank((parts[i], parts[k]))) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[k]))
        h = before[i]
        if h >= 0 and (r := rank((parts[h], parts[i]))) is not None:
            heapq.heappush(heap, (r, h, parts[h], parts[i]))
    return [p for p in parts if p]


class Encoder(dict):
    """word -> ids of its tokens."""

    def __init__(self, ids: dict[str, int], merges: dict[tuple[str, str], int]):
        super().__init__()
        self.ids, self.merges = ids, merges

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= CACHE:
            self.clear()
        self[word] = out = [self.ids.get(p, UNKNOWN) for p in merged(WORD_MARK + word, self.merges)]
        return out

    def encode(self, text: str) -> list[int]:
        return [i for word in text.split() for i in self[word]]


def encoders(vocab: DataFrame) -> dict[str, Encoder]:
    """An encoder of each language. A vocabulary has a bounded size, which is checked before it is collected."""
    rows = vocab.select("lang", "token_id", "piece", "left_piece", "right_piece").where("lang is not null and piece is not null")
    if (n := rows.count()) > MOST_PIECES:
        raise ValueError(f"a vocabulary of {n} pieces is more than {MOST_PIECES}")
    ids: dict[str, dict[str, int]] = {}
    merges: dict[str, dict[tuple[str, str], int]] = {}
    for r in sorted(rows.collect(), key=lambda r: -r["token_id"]):
        ids.setdefault(r["lang"], {})[r["piece"]] = r["token_id"]
        if r["left_piece"] is not None and r["right_piece"] is not None:
            merges.setdefault(r["lang"], {})[r["left_piece"], r["right_piece"]] = r["token_id"]
    return {k: Encoder(v, merges.get(k, {})) for k, v in ids.items()}


def token_ids(known: dict[str, Encoder], text: Column, lang: Column) -> Column:
    """The ids of each text; a null text has none. Other and missing languages get the tokenizer of DEFAULT_LANG."""
    tables = {k: (e.ids, e.merges) for k, e in known.items()}
    made: dict[str, Encoder] = {}

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pa.Array, langs: pa.Array) -> pa.Array:
        if not made:
            made.update({k: Encoder(*t) for k, t in tables.items()})
        last = made[DEFAULT_LANG] if DEFAULT_LANG in made else next(iter(made.values()), Encoder({}, {}))
        return pa.array([made.get(k, last).encode(t) if t else [] for t, k in zip(texts.to_pylist(), langs.to_pylist())], pa.list_(pa.int32()))

    return encode.asNondeterministic()(text, lang)


def unknown_count(ids: Column) -> Column:
    return F.size(F.filter(ids, lambda i: i == UNKNOWN))


def characters(vocab: DataFrame) -> DataFrame:
    """(lang, known): all single characters of each language's vocabulary, in one string."""
    return vocab.where("length(piece) = 1").groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("piece")), "").alias("known"))


def first_unknown(df: DataFrame, vocab: DataFrame, key: str, text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, character, place, n): the first character of each text that its vocabulary lacks, its place from 0, and how many characters it lacks; texts without any are left out.

    White space is no character of a token.  Nulls have none; a missing or other language gets DEFAULT_LANG's.
    """
    known = characters(vocab)
    rows = df.select(key, F.col(text).alias("_t"), F.col(lang).alias("_l")).where("_t is not null")
    rows = rows.join(F.broadcast(known), F.col("_l") == F.col("lang"), "left").withColumnRenamed("known", "_own").drop("lang")
    rows = rows.crossJoin(F.broadcast(known.where(F.col("lang") == DEFAULT_LANG).agg(F.max("known").alias("_default"))))  # one row
    own = F.coalesce("_own", "_default", F.lit(""))
    place = F.transform(F.split("_t", ""), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    lacking = F.filter(place, lambda p: (p["c"] != "") & ~F.rlike(p["c"], F.lit(r"^[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]$")) & (F.instr(own, p["c"]) == 0))
    found = rows.select(key, lacking.alias("u")).where(F.size("u") > 0)
    return found.select(key, F.col("u")[0]["c"].alias("character"), F.col("u")[0]["i"].alias("place"), F.size("u").alias("n"))
