"""Problem 9: repetition inside a single document.

Each document is measured exactly: its words inside a run that occurs at several places.  Beside the measure stands a
score of gradient-boosted trees over other statistics of the document (repeated runs of two, four and six words,
words seen once, how much stands twice), with monotonic constraints: more repeated content never lowers it.  The
trees are fitted on at most ``sample`` rows labelled by the measure, flattened into node arrays, and score all
documents.  A learned score can't hold an exact share, so the measure decides which documents are repetitive, and
the score ranks them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codes, trees
from ._spark import materialise

#: Features and their constraint.
FEATURES = {"size": 0, "twice": 1, "again_2": 1, "again_4": 1, "again_6": 1, "most": 1, "distinct": -1}
SAMPLE = 20_000
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("repeated", pa.int64()), ("share", pa.float64()), *((f, pa.float64()) for f in FEATURES)])
_DDL = "doc_id long, n_words long, repeated long, share double, " + ", ".join(f"{f} double" for f in FEATURES)


def _counts(g: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each n-gram how often its document has it, and whether it stands first among its equals."""
    order = np.lexsort((g, doc))
    gs, ds = g[order], doc[order]
    new = np.ones(len(gs), dtype=bool)
    new[1:] = (gs[1:] != gs[:-1]) | (ds[1:] != ds[:-1])
    size = np.diff(np.concatenate([np.flatnonzero(new), [len(gs)]]))
    count = np.empty(len(gs), dtype=np.int64)
    count[order] = np.repeat(size, size)
    first = np.zeros(len(gs), dtype=bool)
    first[order[new]] = True
    return count, first


def measure(col: pa.Array, run: int = 6, places: int = 3) -> dict[str, np.ndarray]:
    """Statistics of each text: words, words inside a run that occurs at ``places`` or more places, and the features."""
    w = codes.folded_words(col, digits=False)
    n = w.counts()
    over = np.maximum(n, 1)
    out: dict[str, np.ndarray] = {"n_words": n, "size": np.log1p(n)}
    for k in (2, 4, run):
        g, at = codes.ngrams(w.hash, w.doc, k)
        doc = w.doc[at]
        count, first = _counts(g, doc)
        total = np.bincount(doc, minlength=w.n_docs)
        out[f"again_{k}" if k != run else "again_6"] = 1 - np.bincount(doc[first], minlength=w.n_docs) / np.maximum(total, 1) * (total > 0) - (total == 0)
    for name, least in (("repeated", places), ("doubled", 2)):
        edge = np.zeros(len(w.hash) + 1, dtype=np.int64)
        hit = at[count >= least]
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + run, -1)
        inside = np.cumsum(edge[:-1]) > 0
        out[name] = np.bincount(w.doc[inside], minlength=w.n_docs)
    out["share"], out["twice"] = out["repeated"] / over, out["doubled"] / over
    most = np.zeros(w.n_docs)
    np.maximum.at(most, doc, count)
    out["most"] = most / over
    _, first = _counts(w.hash, w.doc)
    out["distinct"] = np.where(n > 0, np.bincount(w.doc[first], minlength=w.n_docs) / over, 1.0)
    return out


def statistics(df: DataFrame, key: str = "doc_id", text: str = "text", run: int = 6, places: int = 3) -> DataFrame:
    """(doc_id, n_words, repeated, features) of every row with a key; a null or empty text has no words and a share of 0."""

    def emit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in codes.slices(batch, "body"):
                m = measure(part.column(1), run, places)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(m[f.name], f.type) for f in list(_SCHEMA)[1:])], schema=_SCHEMA)

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("body")).where("doc_id is not null").mapInArrow(emit, _DDL)


def scored(df: DataFrame, key: str = "doc_id", text: str = "text", run: int = 6, places: int = 3, least: float = 0.35, sample: int = SAMPLE) -> DataFrame:
    """Statistics with the trees' score, the probability that ``share`` is at least ``least``.

    The sample is every document whose hashed key falls into 1 of m parts, m such that about ``sample`` remain;
    with at most ``sample`` documents it is all of them.
    """
    rows = materialise(statistics(df, key, text, run, places))
    m = max(1, -(-rows.count() // sample))
    picked = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(m)) == 0).select("share", *FEATURES).limit(2 * sample).toPandas()
    x = picked[list(FEATURES)].to_numpy(dtype=np.float64).reshape(-1, len(FEATURES))
    forest = trees.fit(x, (picked["share"].to_numpy() >= least).astype(np.float64), list(FEATURES.values()))
    names = list(FEATURES)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(b.schema.get_field_index(f)).to_numpy(zero_copy_only=False) for f in names], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(forest.score(x))], names=[*b.schema.names, "score"])

    return rows.mapInArrow(score, _DDL + ", score double")


def repetitive(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.35, **how) -> DataFrame:
    """(doc_id, share, score): documents whose exact share is at least ``least``, with the trees' score."""
    return scored(df, key, text, least=least, **how).where(F.col("share") >= least).select("doc_id", "share", "score")
