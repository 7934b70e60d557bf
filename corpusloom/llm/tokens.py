"""Problem 6: token budget per source and language.

The tokenizers of the vocab table join neighbouring pieces in order of token_id.  That isn't a unigram model,
so the count of a best path in a trie would be another number; MergeCounter counts by the merges instead.  For
vocabularies with scores (unigram models) UnigramCounter has the double-array trie and a Viterbi that keeps
only scores and counts; unigram_counters reads the table's pieces that way.  Either counts each distinct word of a
task once.  A vocabulary of more than MOST_PIECES pieces is refused.

A text is cut at white space; each word starts with U+2581; a character without an entry is one token.
Null and empty texts have no tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.vocabulary import DEFAULT_LANG, MOST_PIECES, WORD_MARK, merged

#: Words whose counts a task keeps; with more it starts anew.
CACHE = 1_000_000


class MergeCounter(dict):
    """word -> number of tokens, for a vocabulary of merges (left, right) -> rank."""

    def __init__(self, merges: dict[tuple[str, str], int]):
        super().__init__()
        self.merges = merges

    def __missing__(self, word: str) -> int:
        n = len(merged(WORD_MARK + word, self.merges))
        if len(self) >= CACHE:
            self.clear()
        self[word] = n
        return n


class DoubleArray:
    """Trie of pieces in two arrays: a node s has the child of character c at base[s] + code(c) if check there is s."""

    def __init__(self, scores: dict[str, float]):
        chars = sorted({c for p in scores for c in p})
        self.code = {c: i + 1 for i, c in enumerate(chars)}
        size = max(1024, 4 * sum(map(len, scores)) + len(chars) + 2)
        self.base, self.check = np.zeros(size, dtype=np.int64), np.full(size, -1, dtype=np.int64)
        self.score = np.full(size, -np.inf)
        self.check[0] = 0
        tree: dict = {}
        for piece, score in scores.items():
            node = tree
            for c in piece:
                node = node.setdefault(self.code[c], {})
            node[0] = score
        todo, low = [(0, tree)], 1
        while todo:
            s, node = todo.pop()
            if 0 in node:
                self.score[s] = node[0]
            kids = sorted(k for k in node if k)
            if not kids:
                continue
            b = max(1, low - kids[0])
            while True:
                if b + kids[-1] >= len(self.base):
                    self._grow()
                if all(self.check[b + k] < 0 for k in kids):
                    break
                b += 1
            self.base[s] = b
            for k in kids:
                self.check[b + k] = s
                todo.append((b + k, node[k]))
            while low < len(self.check) and self.check[low] >= 0:
                low += 1

    def _grow(self) -> None:
        n = len(self.base)
        self.base, self.check = np.concatenate([self.base, np.zeros(n, np.int64)]), np.concatenate([self.check, np.full(n, -1)])
        self.score = np.concatenate([self.score, np.full(n, -np.inf)])


class UnigramCounter(dict):
    """word -> number of tokens of its best path under a unigram vocabulary; only scores and counts are kept.

    Among paths of one score the one of fewer tokens counts.  A character that no piece covers is one token
    of the score ``unknown``.
    """

    def __init__(self, scores: dict[str, float], unknown: float = -1e3):
        super().__init__()
        t = DoubleArray(scores)
        self.code, self.unknown = t.code, unknown
        self.base, self.check, self.score = t.base.tolist(), t.check.tolist(), t.score.tolist()

    def __missing__(self, word: str) -> int:
        ids = [self.code.get(c, 0) for c in WORD_MARK + word]
        n = len(ids)
        best: list[tuple[float, int]] = [(0.0, 0)] + [(-np.inf, 0)] * n
        size = len(self.check)
        for i in range(n):
            here, count = best[i]
            s = 0
            for j in range(i, n):
                at = self.base[s] + ids[j]
                if not ids[j] or not self.base[s] or at >= size or self.check[at] != s:
                    break
                s = at
                found = (here + self.score[s], count - 1)
                if self.score[s] > -np.inf and found > best[j + 1]:
                    best[j + 1] = found
            if (here + self.unknown, count - 1) > best[i + 1]:
                best[i + 1] = (here + self.unknown, count - 1)
        if len(self) >= CACHE:
            self.clear()
        self[word] = -best[n][1]
        return -best[n][1]


def merge_tables(vocab: DataFrame) -> dict[str, dict[tuple[str, str], int]]:
    """The merges of each language. A vocabulary has a fixed size, which is checked before it is collected."""
    rows = vocab.where("left_piece is not null and right_piece is not null").select("lang", "token_id", "left_piece", "right_piece")
    if (n := rows.count()) > MOST_PIECES:
        raise ValueError(f"a vocabulary of {n} merges is more than {MOST_PIECES}")
    out: dict[str, dict[tuple[str, str], int]] = {}
    for r in sorted(rows.collect(), key=lambda r: -r["token_id"]):
        out.setdefault(r["lang"], {})[r["left_piece"], r["right_piece"]] = r["token_id"]
    return out


def unigram_counters(vocab: DataFrame) -> dict[str, Callable[[], dict]]:
    """Counters that read the pieces as a unigram vocabulary: a piece's score falls with the logarithm of its id."""
    rows = vocab.where("piece is not null and token_id is not null and not piece like '<%>'").select("lang", "token_id", "piece")
    if (n := rows.count()) > MOST_PIECES:
        raise ValueError(f"a vocabulary of {n} pieces is more than {MOST_PIECES}")
    scores: dict[str, dict[str, float]] = {}
    for r in rows.collect():
        scores.setdefault(r["lang"], {})[r["piece"]] = -float(np.log(r["token_id"] + 2))
    return {k: partial(UnigramCounter, v) for k, v in scores.items()}


def counted(df: DataFrame, vocab: DataFrame | None, text: str = "text", lang: str = "lang", keep: tuple[str, ...] = (), counters: dict[str, Callable[[], dict]] | None = None) -> DataFrame:
    """The columns ``keep`` and n_tokens of each row.

    vocab is a table of merges; counters makes other counters by language instead.  A row of a language
    without a tokenizer, or of none, gets the one of DEFAULT_LANG.
    """
    made = counters or {k: partial(MergeCounter, m) for k, m in merge_tables(vocab).items()}
    shared = df.sparkSession.sparkContext.broadcast(made)
    names = [*keep]
    fields = [df.schema[c] for c in names]

    def emit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = {k: make() for k, make in shared.value.items()}
        last = by[DEFAULT_LANG] if DEFAULT_LANG in by else next(iter(by.values()), MergeCounter({}))
        for b in rows:
            n = []
            for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n.append(sum(map(by.get(k, last).__getitem__, t.split())) if t else 0)
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(n, pa.int64())], names=[*names, "n_tokens"])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_tokens bigint"])
    return df.select(F.col(text).alias("_text"), F.col(lang).alias("_lang"), *names).mapInArrow(emit, ddl)


def budget(df: DataFrame, vocab: DataFrame | None, by: tuple[str, ...] = ("source", "lang", "domain"), text: str = "text", lang: str = "lang", **how) -> DataFrame:
    """Documents and tokens of each slice; nulls are slices of their own."""
    return counted(df, vocab, text, lang, by, **how).groupBy(*by).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
