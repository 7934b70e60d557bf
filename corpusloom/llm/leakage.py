"""Problem 8: evaluation texts leaking into training text.

Latent semantic retrieval.  Passages, WIDTH words of documents and of items, are weighted by TF-IDF (document
frequencies over all documents); a randomised SVD, whose products are summed over the cluster, gives each word a
latent vector, and passages whose latent vectors have a cosine of at least ``cosine`` are candidates.  A document's
passages are compared as they stand, words that no item has included in their length.  Candidates are then checked
word by word: the longest common subsequence of a passage of an item and the document's passage with what surrounds
it, weighted by IDF, must hold ``share`` of the item's passage (a paraphrase), or document and item must have
``run`` consecutive words in common (a copy).

A passage may hold only ``run`` words of a copy and point elsewhere, so copies are also searched by windows of
``run`` words at every position: a shared run has two windows with the same latent vector and can't be missed.

The items are the query set.  Documents are read once for each MOST_VOCAB words of items, and their words, as
numbers of the items' vocabulary, are compared with BLOCK_WORDS words of items at a time, so what is broadcast is
bounded.  The item passages of a block are clustered, and a document's passage is compared with those of its
nearest clusters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import codes
from ._spark import batches, materialise, spread

#: Words of items that are searched for at once, and those whose vocabulary documents are read for at once.
BLOCK_WORDS, MOST_VOCAB = 200_000, 4_000_000
SEARCH_WORDS = 128_000
RANK, EXTRA, ROUNDS = 48, 8, 1
#: Words of a passage, and between passages of a document and of an item.
WIDTH, STEP, ITEM_STEP = 20, 10, 5
COSINE, SHARE = 0.6, 0.75
#: Words of the model; with a larger vocabulary some share a latent vector, which adds candidates.
MODEL_ROWS = 1 << 17
#: Windows of the same words have a cosine of 1 but for rounding; WINDOW_DIMS leading coordinates tell them apart.
SAME, WINDOW_DIMS = 1 - 1e-6, 8
SEGMENTS = 16
_DOCS = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("words", pa.binary()), ("said", pa.binary())])
_DDL = "kind int, doc_id long, words binary, said binary"
_SUMS = pa.schema([("segment", pa.int32()), ("sums", pa.binary())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("run_words", pa.int32()), ("common_words", pa.int32()), ("share", pa.float64()), ("cosine", pa.float64()), ("has_answer", pa.bool_())])
_FOUND_DDL = "doc_id long, item_id long, run_words int, common_words int, share double, cosine double, has_answer boolean"


class Vocabulary:
    """Words of all items and of their answers, and each word's row of the model."""

    def __init__(self, words: np.ndarray, answers: np.ndarray):
        self.words, self.answers = np.unique(words), np.unique(answers)
        n = len(self.words)
        self.row = np.arange(n) if n <= MODEL_ROWS else (codes.mix(self.words) % np.uint64(MODEL_ROWS)).astype(np.int64)
        self.rows = min(n, MODEL_ROWS)

    @staticmethod
    def numbers(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Place of each word in the table, -1 for others."""
        if not len(table):
            return np.full(len(hashes), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
        return np.where(table[at] == hashes, at, -1)


class Model:
    """IDF of each word, its latent vector times IDF, and the weight of words that no item has."""

    def __init__(self, idf: np.ndarray, vectors: np.ndarray, row: np.ndarray):
        self.idf = np.append(idf[row], idf.max(initial=1.0))
        latent = vectors[row] if len(row) else np.zeros((0, vectors.shape[1]))
        self.latent = np.append(latent, np.zeros((1, vectors.shape[1])), axis=0).astype(np.float32)
        # for windows: a few coordinates, and a random one, so that no window is zero
        random = 0.05 * self.idf[:-1] * (0.5 + codes.mix(np.arange(1, len(row) + 1, dtype=np.uint64)) / 2.0**64)
        self.exact = np.column_stack([latent[:, :WINDOW_DIMS], random])

    def passages(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Latent vectors of passages (rows of word numbers; -1 a foreign word, -2 none), as long as the part of their weight that items' words have, and this part."""
        out = np.zeros((len(words), self.latent.shape[1]), dtype=np.float32)
        square, own = np.zeros(len(words)), np.zeros(len(words))
        for k in range(words.shape[1]):
            w = words[:, k]
            out += self.latent[np.maximum(w, -1)]
            weight = np.where(w >= -1, self.idf[np.maximum(w, -1)] ** 2, 0)
            square += weight
            own += np.where(w >= 0, weight, 0)
        part = np.sqrt(own / np.maximum(square, 1e-12))
        return out * (part / np.maximum(np.sqrt((out.astype(np.float64) ** 2).sum(axis=1)), 1e-9))[:, None].astype(np.float32), part


def starts(off: np.ndarray, step: int) -> np.ndarray:
    """First words of the passages of each text: every step-th word, and the last that has room for WIDTH."""
    size = np.diff(off)
    last = np.maximum(size - WIDTH, 0)
    n = np.where(size > 0, last // step + 1 + (last % step > 0), 0)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(off[:-1], n) + np.minimum(k * step, np.repeat(last, n))


def passages_at(words: np.ndarray, off: np.ndarray, first: np.ndarray, before: int = 0, after: int = 0) -> np.ndarray:
    """Rows of WIDTH words from each place on, and some before and after; -2 beyond a text's ends."""
    of = np.searchsorted(off, first, side="right") - 1
    at = first[:, None] + np.arange(-before, WIDTH + after)
    inside = (at >= off[of][:, None]) & (at < off[of + 1][:, None])
    return np.where(inside, words[np.clip(at, 0, max(len(words) - 1, 0))], -2) if len(words) else np.zeros((0, WIDTH + before + after), np.int64)


class Items:
    """One block of the query set: windows, passages, and the words and answer of each item."""

    def __init__(self, rows: list[tuple[int, str, str]], known: Vocabulary, run: int):
        w = codes.folded_words(pa.array([r[1] for r in rows], pa.string()))
        self.ids = np.array([r[0] for r in rows], dtype=np.int64)
        self.words = known.numbers(known.words, w.hash)
        self.start = np.searchsorted(w.doc, np.arange(len(rows) + 1))
        at = np.flatnonzero(w.doc[: len(w.doc) - run + 1] == w.doc[run - 1 :]) if len(w.doc) >= run else np.zeros(0, np.int64)
        self.windows = self.words[at[:, None] + np.arange(run)] if len(at) else np.zeros((0, run), np.int64)
        self.window_item = w.doc[at] if len(at) else at
        answers = codes.folded_words(pa.array([r[2] or "" for r in rows], pa.string()))
        number = known.numbers(known.answers, answers.hash)
        self.answers = [set(number[answers.doc == i].tolist()) for i in range(len(rows))]
        first = starts(self.start, ITEM_STEP)
        self.passages = passages_at(self.words, self.start, first)
        self.passage_item = np.searchsorted(self.start, first, side="right") - 1


def _documents(docs: DataFrame, known: Vocabulary) -> DataFrame:
    """kind 1: a document's words as numbers of the vocabulary (-1 for others), if it has any, and the answers' words it holds; kind 0: document frequencies of a task, in segments."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def emit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        df, n_docs = np.zeros(v.rows, dtype=np.int64), 0
        for batch in rows:
            for part in codes.slices(batch, "body"):
                w = codes.folded_words(part.column(1))
                n_docs += part.num_rows
                at = v.numbers(v.words, w.hash)
                own = at >= 0
                df += np.bincount(np.unique(w.doc[own] * v.rows + v.row[at[own]]) % max(v.rows, 1), minlength=v.rows)
                said = v.numbers(v.answers, w.hash)
                edge = np.searchsorted(w.doc, np.arange(w.n_docs + 1))
                some = np.flatnonzero(np.bincount(w.doc[own], minlength=w.n_docs)).tolist()
                keys = part.column(0).to_numpy(zero_copy_only=False)
                held = [np.unique(said[edge[d] : edge[d + 1]]) for d in some]
                yield batches(_DOCS, kind=[1] * len(some), doc_id=keys[some], words=[at[edge[d] : edge[d + 1]].astype("<i4").tobytes() for d in some], said=[x[x >= 0].astype("<i4").tobytes() for x in held])
        yield batches(_DOCS, kind=[0] * SEGMENTS, doc_id=range(SEGMENTS), words=[p.tobytes() for p in np.array_split(np.append(df, n_docs).astype(np.float64), SEGMENTS)], said=[b""] * SEGMENTS)

    return materialise(docs.mapInArrow(emit, _DDL))


def _summed(blobs: DataFrame) -> np.ndarray:
    """Sum of equally long float64 arrays that arrive in SEGMENTS pieces: each is summed in one task, so one array reaches the driver."""

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in rows:
            for s, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(v, dtype=np.float64)
                total[s] = total[s] + x if s in total else x.copy()
        yield batches(_SUMS, segment=list(total), sums=[x.tobytes() for x in total.values()])

    got = {r["segment"]: np.frombuffer(r["sums"], dtype=np.float64) for r in spread(blobs, SEGMENTS, "segment").mapInArrow(add, "segment int, sums binary").collect()}
    return np.concatenate([got[s] for s in range(SEGMENTS)]) if len(got) == SEGMENTS else np.zeros(0)


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = col.to_pylist()
    size = np.array([len(v) // 4 for v in raw], dtype=np.int64)
    return np.frombuffer(b"".join(raw), dtype="<i4").astype(np.int64), np.concatenate([[0], np.cumsum(size)])


def _product(words: np.ndarray, row: np.ndarray, idf: np.ndarray, least: float, g: np.ndarray) -> np.ndarray:
    """A'A g for the TF-IDF rows of passages whose items' words have the part ``least`` of the weight."""
    n = len(idf)
    z = np.zeros_like(g)
    if not len(words) or not n:
        return z
    at = np.where(words >= 0, row[np.maximum(words, 0)], n)
    weight = np.where(words >= 0, np.append(idf, 0)[at], np.where(words == -1, idf.max(), 0))
    square = (weight**2).sum(axis=1)
    weight = np.where(words >= 0, weight, 0)
    keep = np.flatnonzero((weight**2).sum(axis=1) >= least**2 * square - 1e-12)
    # as lists of entries, ordered by word
    at, weight = at[keep], weight[keep] / np.sqrt(np.maximum(square[keep], 1e-12))[:, None]
    wide = np.append(g, np.zeros((1, g.shape[1])), axis=0).astype(np.float32)
    y = np.zeros((len(keep), g.shape[1]), dtype=np.float32)
    for k in range(words.shape[1]):
        y += wide[at[:, k]] * weight[:, k, None].astype(np.float32)
    flat, passage = at.ravel(), np.repeat(np.arange(len(keep)), words.shape[1])
    order = np.argsort(flat, kind="stable")
    order = order[: np.searchsorted(flat[order], n)]
    for a in range(0, len(order), 200_000):
        o = order[a : a + 200_000]
        first = np.flatnonzero(np.concatenate([[True], flat[o][1:] != flat[o][:-1]]))
        z[flat[o][first]] += np.add.reduceat(y[passage[o]] * weight.ravel()[o][:, None].astype(np.float32), first, axis=0)
    return z


def fitted(docs: DataFrame, items: DataFrame, known: Vocabulary, cosine: float) -> Model:
    """docs as _documents makes them; items has a string column ``body``."""
    sc = docs.sparkSession.sparkContext
    sums = _summed(docs.where("kind = 0").select(F.col("doc_id").cast("int").alias("segment"), F.col("words").alias("sums")))
    sums = sums if len(sums) == known.rows + 1 else np.zeros(known.rows + 1)
    idf = np.log((1 + sums[-1]) / (1 + sums[:-1])) + 1
    size = min(known.rows, RANK + EXTRA)
    g = np.linalg.qr(np.random.default_rng(7).normal(size=(known.rows, size)))[0]
    for step in range(ROUNDS + 1):
        shared = sc.broadcast((idf, g, known))

        def pieces(total: np.ndarray) -> pa.RecordBatch:
            return batches(_SUMS, segment=range(SEGMENTS), sums=[p.tobytes() for p in np.array_split(total.ravel(), SEGMENTS)])

        def of_documents(rows: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            weights, basis, v = shared.value
            total = np.zeros_like(basis)
            for b in rows:
                for part in _pieces(b, 0):
                    words, off = _flat(part.column(0))
                    total += _product(passages_at(words, off, starts(off, STEP)), v.row, weights, cosine, basis)
            yield pieces(total)

        def of_items(rows: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            weights, basis, v = shared.value
            total = np.zeros_like(basis)
            for b in rows:
                for part in codes.slices(b, "body"):
                    w = codes.folded_words(part.column(0))
                    off = np.searchsorted(w.doc, np.arange(part.num_rows + 1))
                    total += _product(passages_at(v.numbers(v.words, w.hash), off, starts(off, ITEM_STEP)), v.row, weights, 0, basis)
            yield pieces(total)

        ddl = "segment int, sums binary"
        z = _summed(docs.where("kind = 1").select("words").mapInArrow(of_documents, ddl).union(items.select("body").mapInArrow(of_items, ddl)))
        z = z.reshape(known.rows, size) if z.size == known.rows * size else np.zeros((known.rows, size))
        if step < ROUNDS:
            g = np.linalg.qr(z)[0]
    values, vectors = np.linalg.eigh(g.T @ z)
    return Model(idf, (g @ vectors[:, np.argsort(-values)[:RANK]]) * idf[:, None], known.row)


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of about SEARCH_WORDS words."""
    size = np.array([len(v) // 4 for v in batch.column(column).to_pylist()], dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // SEARCH_WORDS)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x**2).sum(axis=1, keepdims=True)), 1e-12)


class Cells:
    """Unit vectors by the cell of their first three latent coordinates.

    Two unit vectors of cosine c differ by at most sqrt(2 - 2 c) in each coordinate, so the cells that a
    vector's coordinates may fall into, give or take that much, hold all its neighbours.
    """

    def __init__(self, unit: np.ndarray, least: float):
        self.unit, self.least = unit, least
        self.near = float(np.sqrt(2 - 2 * least))
        self.side = 4 * self.near
        self.dims = min(3, unit.shape[1])
        self.span = int(2 / self.side) + 4
        cell = self._pack(np.floor((unit[:, : self.dims] + 1) / self.side))
        self.order = np.argsort(cell, kind="stable")
        self.cell = cell[self.order]

    def _pack(self, c: np.ndarray) -> np.ndarray:
        out = np.zeros(len(c), dtype=np.int64)
        for d in range(c.shape[1]):
            out = out * self.span + c[:, d].astype(np.int64) + 1
        return out

    def neighbours(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of x and of the cells' vectors whose cosine is at least ``least``."""
        lo = np.floor((x[:, : self.dims] - self.near + 1) / self.side)
        hi = np.floor((x[:, : self.dims] + self.near + 1) / self.side)
        found = []
        for corner in range(1 << self.dims):
            bits = np.array([corner >> d & 1 for d in range(self.dims)], dtype=bool)
            rows = np.flatnonzero(((lo != hi) | ~bits).all(axis=1))
            cell = self._pack(np.where(bits, hi[rows], lo[rows]))
            a, b = np.searchsorted(self.cell, cell, "left"), np.searchsorted(self.cell, cell, "right")
            n = b - a
            i = np.repeat(rows, n)
            j = self.order[np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            ok = (x[i] * self.unit[j]).sum(axis=1) >= self.least - 1e-9
            found.append((i[ok], j[ok]))
        return tuple(np.concatenate([f[k] for f in found]) for k in range(2))


class Clusters:
    """Vectors in about sqrt(n) clusters, made by a few rounds of spherical k-means; a search looks into the nearest of them."""

    def __init__(self, x: np.ndarray, probes: int | None = None):
        self.x = x
        k = max(1, int(np.sqrt(len(x))))
        self.centre = _unit(x[np.random.default_rng(3).permutation(len(x))[:k]].astype(np.float64)).astype(np.float32) if len(x) else x
        for _ in range(6 if k > 1 else 0):
            own = np.argmax(x @ self.centre.T, axis=1)
            total = np.zeros(self.centre.shape)
            np.add.at(total, own, x)
            self.centre = np.where(np.bincount(own, minlength=k)[:, None] > 0, _unit(total), self.centre).astype(np.float32)
        own = np.argmax(x @ self.centre.T, axis=1) if len(x) else np.zeros(0, np.int64)
        self.members = [np.flatnonzero(own == c) for c in range(k)]
        self.probes = min(k, probes or max(6, k // 5))

    def near(self, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of q and of the clusters' vectors whose product is at least ``least``, and the product."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        if len(q) and len(self.x):
            to = q @ self.centre.T
            bound = np.partition(to, to.shape[1] - self.probes, axis=1)[:, to.shape[1] - self.probes]
            for c, m in enumerate(self.members):
                rows = np.flatnonzero(to[:, c] >= bound)
                if len(rows) and len(m):
                    s = q[rows] @ self.x[m].T
                    i, j = np.nonzero(s >= least)
                    out.append((rows[i], m[j], s[i, j]))
        return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def weighted_subsequence(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The greatest weight of a common subsequence of each row of a and the same row of b; negative numbers match nothing."""
    row = np.zeros((len(a), b.shape[1] + 1))
    for k in range(a.shape[1]):
        x = a[:, k, None]
        hit = np.where((x == b) & (x >= 0), row[:, :-1] + weight[np.maximum(x, 0)], 0)
        row[:, 1:] = np.maximum.accumulate(np.maximum(hit, row[:, 1:]), axis=1)
    return row[:, -1]


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence: a prefix maximum over each row of the table."""
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for x in a[np.isin(a, b)].tolist():
        step = np.where(b == x, row[:-1] + 1, row[1:])
        row[1:] = np.maximum.accumulate(np.maximum(step, row[1:]))
    return int(row[-1])


def common_run(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common run: the longest stretch of equal places on a diagonal."""
    a_at, order = np.flatnonzero(np.isin(a, b)), np.argsort(b, kind="stable")
    lo, hi = (np.searchsorted(b[order], a[a_at], side) for side in ("left", "right"))
    n = hi - lo
    x = np.repeat(a_at, n)
    y = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    if not len(x):
        return 0
    diagonal = x - y
    order = np.lexsort((x, diagonal))
    x, diagonal = x[order], diagonal[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(x) != 1) | (np.diff(diagonal) != 0)]))
    return int(np.diff(np.append(new, len(x))).max())


def retrieved(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", answer: str = "answer",
    run: int = 10, cosine: float = COSINE, share: float = SHARE, block_words: int = BLOCK_WORDS, most_vocab: int = MOST_VOCAB,
) -> DataFrame:
    """(doc_id, item_id, run_words, common_words, share, cosine, has_answer): documents with a copy or a paraphrase of an item's passage.

    run_words is the longest run that document and item share, common_words their longest common subsequence, share
    the greatest part of an item's passage, by IDF, that such a subsequence of two passages holds (0 if no passage
    was near), cosine that of these two; has_answer tells whether the document holds all words of the item's answer.
    Words are compared without punctuation, invisible characters and differences of digit script, width or composed
    form.  Null keys and texts give no rows; repeated rows count once; an item of fewer than ``run`` words can
    only be found by its passages.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body")).where("doc_id is not null and body is not null")
    asked = items.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("body"), F.col(answer).cast("string").alias("answer")).where("item_id is not null and body is not null").distinct()
    asked = materialise(asked)
    # words have a letter and a gap at least
    total = asked.agg(F.coalesce(F.sum(F.length("body") / 2 + 1), F.lit(0)).cast("long")).first()[0]
    result = None
    n_scans, n_blocks = (max(1, -(-int(total) // n)) for n in (most_vocab, block_words))
    for scan in range(n_scans if total else 0):
        group = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(n_scans)) == scan)
        known = _vocabulary(group)
        if not known.rows:
            continue
        read = _documents(rows, known)
        model = fitted(read, group, known, cosine)
        per = -(-n_blocks // n_scans)
        for b in range(per):
            block = group.where(F.pmod(F.xxhash64("item_id", F.lit(1)), F.lit(per)) == b).orderBy("item_id", "body").toArrow()
            part = _search(read, Items(list(zip(*(block.column(i).to_pylist() for i in range(3)))), known, run), model, run, cosine, share) if block.num_rows else None
            result = part if result is None else result if part is None else result.union(part)
    if result is None:
        return docs.sparkSession.createDataFrame([], T._parse_datatype_string(_FOUND_DDL))
    names = _FOUND.names[2:]
    return result.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in names))


def found(docs: DataFrame, items: DataFrame, run: int = 10, **how) -> DataFrame:
    """(doc_id, item_id, run_words, common_words, has_answer): documents that hold ``run`` consecutive words of an item; see retrieved."""
    return retrieved(docs, items, run=run, **how).where(F.col("run_words") >= run).select("doc_id", "item_id", "run_words", "common_words", "has_answer")


def _vocabulary(items: DataFrame) -> Vocabulary:
    """At most ``most_vocab`` words reach the driver."""

    def words(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for part in codes.slices(b, "body"):
                for kind, column in ((0, 0), (1, 1)):
                    h = np.unique(codes.folded_words(part.column(column)).hash)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), pa.array(h.view(np.int64))], names=["kind", "word"])

    got = items.select("body", "answer").mapInArrow(words, "kind int, word long").distinct().toArrow()
    kind, word = got.column(0).to_numpy(), got.column(1).to_numpy().view(np.uint64)
    return Vocabulary(word[kind == 0], word[kind == 1])


def _search(read: DataFrame, items: Items, model: Model, run: int, cosine: float, share: float) -> DataFrame:
    shared = read.sparkSession.sparkContext.broadcast((items, model))

    def search(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it, m = shared.value
        cells = Cells(_unit(m.exact[it.windows].sum(axis=1)), SAME) if len(it.windows) else None
        targets, _ = m.passages(it.passages)
        clusters = Clusters(targets)
        whole = np.where(it.passages >= 0, m.idf[np.maximum(it.passages, 0)], 0).sum(axis=1)
        for batch in rows:
            for part in _pieces(batch, 1):
                words, off = _flat(part.column(1))
                pairs = {p: (0.0, 0.0) for p in _copies(words, off, it, m, cells, run)}
                for p, s, c in _paraphrases(words, off, it, m, clusters, whole, cosine, share):
                    pairs[p] = max(pairs.get(p, (0.0, 0.0)), (s, c))
                out = []
                for (r, k), (s, c) in pairs.items():
                    a, b = words[off[r] : off[r + 1]], it.words[it.start[k] : it.start[k + 1]]
                    wanted = it.answers[k]
                    said = bool(wanted) and wanted <= set(np.frombuffer(part.column(2)[r].as_py(), "<i4").tolist())
                    out.append((part.column(0)[r].as_py(), int(it.ids[k]), common_run(a, b), common_subsequence(a, b), s, c, said))
                if out:
                    yield batches(_FOUND, **dict(zip(_FOUND.names, map(list, zip(*out)))))

    return read.where("kind = 1").select("doc_id", "words", "said").mapInArrow(search, _FOUND_DDL)


def _copies(words: np.ndarray, off: np.ndarray, it: Items, m: Model, cells: Cells | None, run: int) -> list[tuple[int, int]]:
    """(document, item) of windows of ``run`` words that are the same."""
    if cells is None or len(words) < run:
        return []
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    foreign = np.concatenate([[0], np.cumsum(words < 0)])
    at = np.flatnonzero((row[: len(row) - run + 1] == row[run - 1 :]) & (foreign[run:] == foreign[:-run]))
    vec = np.where(words[:, None] >= 0, m.exact[np.maximum(words, 0)], 0)
    sums = np.concatenate([np.zeros((1, vec.shape[1])), np.cumsum(vec, axis=0)])
    i, j = cells.neighbours(_unit(sums[at + run] - sums[at]))
    same = (words[at[i][:, None] + np.arange(run)] == it.windows[j]).all(axis=1)
    return [tuple(p) for p in np.unique(np.stack([row[at[i[same]]], it.window_item[j[same]]], axis=1), axis=0).tolist()]


def _paraphrases(words: np.ndarray, off: np.ndarray, it: Items, m: Model, clusters: Clusters, whole: np.ndarray, cosine: float, share: float) -> Iterator[tuple[tuple[int, int], float, float]]:
    """((document, item), share, cosine) of passages with a common subsequence of enough weight."""
    first = starts(off, STEP)
    queries, part = m.passages(passages_at(words, off, first))
    first, queries = first[part >= cosine], queries[part >= cosine]
    i, j, near = clusters.near(queries, cosine)
    passages, every = it.passages.astype(np.int32), passages_at(words, off, first, STEP // 2, STEP // 2).astype(np.int32)
    for a in range(0, len(i), 4000):
        q, c = j[a : a + 4000], near[a : a + 4000]
        p, around, own = first[i[a : a + 4000]], every[i[a : a + 4000]], passages[q]
        # the words of the item's passage that the other has at all bound the subsequence
        held = np.zeros(own.shape, dtype=bool)
        for k in range(around.shape[1]):
            held |= own == around[:, k, None]
        bound = np.where(held & (own >= 0), m.idf[np.maximum(own, 0)], 0).sum(axis=1)
        ok = np.flatnonzero(bound >= share * whole[q] - 1e-9)
        got = weighted_subsequence(own[ok], around[ok], m.idf) / np.maximum(whole[q[ok]], 1e-9)
        good = got >= share - 1e-9
        doc = np.searchsorted(off, p[ok][good], side="right") - 1
        yield from (((d, k), s, x) for d, k, s, x in zip(doc.tolist(), it.passage_item[q[ok][good]].tolist(), got[good].tolist(), c[ok][good].tolist()))
