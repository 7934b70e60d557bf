"""One form for prompts that state the same facts and ask the same question.

A prompt is its sentences; the last asks, the others state facts.  Sentences are compared as words without
punctuation, invisible characters and differences of digit script, width, composed form or look-alike
letters, and without an introduction.  Introductions are learned from all prompts: beginnings of two or more
words that a given share of all sentences has.  Facts are taken in any order.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import materialise
from .lookalikes import LOOKALIKES

#: Lengths that are tried in one pass over the facts, and beginnings that a task counts before it sends them.
AT_ONCE, FLUSH = 6, 500_000
_END = re.compile(r"\.(?=\s|$)")
_COUNT = pa.schema([("start", pa.string()), ("n", pa.int64())])


class _Fold(dict):
    """Code point to its folded form: sentence ends become newlines, other signs and gaps spaces."""

    def __init__(self):
        alike = (x for x in LOOKALIKES.split() if unicodedata.category(x[0])[0] == "L" and unicodedata.category(x[1])[0] == "L")
        super().__init__({ord(x[0]): x[1] for x in alike})
        self.update({ord(c): "\n" for c in "।॥|∣?？!;；"})

    def __missing__(self, c: int) -> str:
        ch = chr(c)
        kind = unicodedata.category(ch)
        digit = unicodedata.decimal(ch, None)
        out = str(digit) if digit is not None else "" if kind == "Cf" else ch if kind[0] in "LMN" else " "
        self[c] = out
        return out


FOLD = _Fold()


def sentences(prompt: str) -> list[list[str]]:
    """Words of each sentence, empty sentences left out; a newline is a gap like a space."""
    text = _END.sub("।", unicodedata.normalize("NFKC", prompt)).translate(FOLD)
    out = [[w.rstrip("ः") for w in s.split()] for s in text.split("\n")]
    return [[w for w in s if w] for s in out if s]


def introductions(df: DataFrame, share: float = 0.02, least: int = 5) -> set[tuple[str, ...]]:
    """Beginnings, of any length from two words, that at least this share of all facts has.

    Of one length at most 1 / share reach the driver.  A beginning is lengthened only if it was frequent itself, so
    after the first pass over pairs of words few are counted.
    """
    known: set[tuple[str, ...]] | None = None
    out: set[tuple[str, ...]] = set()
    total, first, last = 0, 2, 2
    while True:

        def count(rows: Iterator[pa.RecordBatch], known=known, first=first, last=last) -> Iterator[pa.RecordBatch]:
            c: Counter[str] = Counter()
            for b in rows:
                for p in b.column(0).to_pylist():
                    for s in sentences(p)[:-1]:
                        c[""] += 1
                        if known is None or tuple(s[: first - 1]) in known:
                            c.update(" ".join(s[:k]) for k in range(first, min(last, len(s) - 1) + 1))
                if len(c) > FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], schema=_COUNT)
                    c.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], schema=_COUNT)

        counts = materialise(df.select("body").mapInArrow(count, "start string, n long").groupBy("start").agg(F.sum("n").alias("n")))
        if not total:
            total = next((r["n"] for r in counts.where("start = ''").collect()), 0)
        frequent = {tuple(r["start"].split(" ")) for r in counts.where((F.col("n") >= max(least, share * total)) & (F.col("start") != "")).collect()}
        out |= frequent
        known = {x for x in frequent if len(x) == last}
        if not known:
            return out
        first, last = last + 1, last + AT_ONCE


def canonical(prompt: str, intros: set[tuple[str, ...]]) -> list[list[str]]:
    """Facts without introductions, sorted, then the question."""
    parts = sentences(prompt)
    facts = []
    for s in parts[:-1]:
        # all beginnings of a frequent beginning are frequent
        k = 1
        while k + 1 < len(s) and tuple(s[: k + 1]) in intros:
            k += 1
        facts.append(s[k if k > 1 else 0 :])
    return [*sorted(facts), *parts[-1:]]
