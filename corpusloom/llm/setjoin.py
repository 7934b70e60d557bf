"""Exact similarity join of shingle sets by inverted lists.

A document is the set of its runs of ``shingle`` consecutive words (stretches without space, tab or
newline, as stored).  All documents order their shingles alike, the rarer first, so that two
documents similar enough must share shingles near the front of both; only these front parts are
exchanged.  Nothing in the result depends on the order, which only decides how many candidates arise.

* Documents with equal sets are one representative (by a 64-bit signature) until the pairs are expanded.
* Postings travel as packed arrays, one per bucket of shingles, not as rows.
* Candidates are checked on whole sets, so the result is exact but for collisions of hashes.

Null texts and texts with fewer words than ``shingle`` are in no pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codes, slots
from ._spark import batches, materialise, spread

#: So many shingles must be common to the front parts of two sets, unless fewer must be common to the sets.
HITS = 3
POSTINGS_A_BUCKET = 800_000
PAIRS_AT_ONCE = 2_000_000
HOT_PAIRS = 40_000_000
HOT_BLOCK = 4096
MEMBER, CANDIDATE, HOT = 0, 1, 2

_BLOBS = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("posts", pa.binary())])
_LINKS = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32()), ("side", pa.int32()), *((f"bits{i}", pa.int64()) for i in range(4)), ("left", pa.binary()), ("right", pa.binary())])
_LINKS_DDL = "kind int, a long, b long, n int, side int, bits0 long, bits1 long, bits2 long, bits3 long, left binary, right binary"
#: Documents of candidate pairs whose keys are broadcast at most (4 MB of keys); more are joined by a shuffle.
BROADCAST_KEYS = 500_000

#: One set: signature, size, side of the join (0 for a self-join).
DOC = np.dtype([("sig", "<u8"), ("n", "<u4"), ("side", "u1")])
#: One shingle of the front part of a set: shingle, its set's number in the blob, position in the set's order.
POST = np.dtype([("low", "<u4"), ("high", "u1"), ("doc", "<u4"), ("at", "<u2")])
#: One record: signature and size of its set, and the set's parity bitmap.
RECORD = np.dtype([("sig", "<u8"), ("key", "<i8"), ("n", "<u4"), ("bits", "<u8", (4,))])
ENTRY = np.dtype([("sig", "<u8"), ("n", "<u4"), ("at", "<u2"), ("side", "u1")])


class Sets:
    """Shingle sets of a slice's documents, ordered: ids[start[i]:start[i + 1]] is the i-th set."""

    def __init__(self, col: pa.Array, shingle: int, cost: np.ndarray):
        w = codes.plain_words(col)
        g, at = codes.ngrams(w.hash, w.doc, shingle)
        ids = (cost[slots.slot(g, len(cost).bit_length() - 1)].astype(np.uint64) << np.uint64(56)) | (g >> np.uint64(8))
        doc = w.doc[at]
        order = np.lexsort((ids, doc))
        ids, doc = ids[order], doc[order]
        new = np.ones(len(ids), dtype=bool)
        new[1:] = (ids[1:] != ids[:-1]) | (doc[1:] != doc[:-1])
        self.ids, self.doc = ids[new], doc[new]
        first = np.ones(len(self.doc), dtype=bool)
        first[1:] = self.doc[1:] != self.doc[:-1]
        self.start = np.concatenate([np.flatnonzero(first), [len(self.doc)]]).astype(np.int64)
        self.row = self.doc[self.start[:-1]] if len(self.doc) else np.zeros(0, np.int64)
        self.size = np.diff(self.start)
        one = codes.mix(self.ids + np.uint64(0xABCDEF))
        self.sig = codes.mix(np.add.reduceat(one, self.start[:-1]) + self.size.astype(np.uint64)) if len(self.ids) else np.zeros(0, np.uint64)

    def parity(self) -> np.ndarray:
        """256 bits of each set: a bit is set if an odd number of its shingles falls on it.

        Two sets differ in at least as many shingles as their bitmaps differ in bits.
        """
        flat = np.zeros(len(self.size) * 256, dtype=np.uint8)
        of = np.repeat(np.arange(len(self.size)), self.size)
        hits = of * 256 + (codes.mix(self.ids) & np.uint64(255)).astype(np.int64)
        flat[:] = np.bincount(hits, minlength=len(flat)) & 1
        return np.packbits(flat.reshape(-1, 64), axis=1, bitorder="little").view("<u8").reshape(-1, 4)


def _emit(ids, doc, at, sig, size, side, n_buckets) -> Iterator[pa.RecordBatch]:
    """Postings as one blob for each bucket."""
    bucket = (codes.mix(ids) % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ids, doc, at, bucket = ids[order], doc[order], at[order], bucket[order]
    cut = np.searchsorted(bucket, np.arange(n_buckets + 1))
    out: tuple[list, list, list] = ([], [], [])
    for b in np.flatnonzero(np.diff(cut)).tolist():
        s = slice(cut[b], cut[b + 1])
        used, local = np.unique(doc[s], return_inverse=True)
        docs = np.empty(len(used), dtype=DOC)
        docs["sig"], docs["n"], docs["side"] = sig[used], size[used], side
        posts = np.empty(s.stop - s.start, dtype=POST)
        posts["low"], posts["high"] = ids[s] & np.uint64(0xFFFFFFFF), (ids[s] >> np.uint64(32)) & np.uint64(0xFF)
        posts["doc"], posts["at"] = local, np.minimum(at[s], 0xFFFF)
        for column, value in zip(out, (b, docs.tobytes(), posts.tobytes())):
            column.append(value)
    if out[0]:
        yield batches(_BLOBS, bucket=out[0], docs=out[1], posts=out[2])


def postings(df: DataFrame, key: str, text: str, shingle: int, cost, front: Callable[[np.ndarray], np.ndarray], side: int, n_buckets: int) -> DataFrame:
    """Blobs of the front parts of all sets; and, in negative buckets, the records with their signatures."""
    table = df.sparkSession.sparkContext.broadcast(cost)

    def emit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in rows:
            for part in codes.slices(batch, text):
                sets = Sets(part.column(1), shingle, table.value)
                if not len(sets.row):
                    continue
                key_of = part.column(0).to_numpy(zero_copy_only=False)
                members = np.empty(len(sets.row), dtype=RECORD)
                members["sig"], members["key"], members["n"], members["bits"] = sets.sig, key_of[sets.row], sets.size, sets.parity()
                yield batches(_BLOBS, bucket=[-1 - int(sets.sig[0] % np.uint64(n_buckets))], docs=[members.tobytes()], posts=[bytes([side])])
                fresh = np.zeros(len(sets.row), dtype=bool)
                if len(seen) > 1 << 20:
                    seen.clear()  # copies are then sent again, which changes nothing
                for i, s in enumerate(sets.sig.tolist()):
                    if s not in seen:
                        seen.add(s)
                        fresh[i] = True
                n = np.where(fresh, np.minimum(front(sets.size) + HITS - 1, sets.size), 0)
                take = np.repeat(sets.start[:-1], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                of = np.repeat(np.arange(len(n)), n)
                yield from _emit(sets.ids[take], of, take - sets.start[of], sets.sig, sets.size, side, n_buckets)

    return df.select(key, text).mapInArrow(emit, "bucket int, docs binary, posts binary")


def _pairs(left: np.ndarray, right: np.ndarray | None, lo_ratio: float, need) -> Iterator[tuple]:
    """Signature pairs of entries that share a shingle, how many they share here, and how many they must.

    Of the shingles that two similar sets share, the first HITS stand so near the front of both that enough
    shingles follow.
    """
    for a, b in _ranges(left, right, lo_ratio):
        least = need(a["n"].astype(np.float64), b["n"].astype(np.float64))
        ok = (np.minimum(a["n"] - a["at"].astype(np.int64), b["n"] - b["at"].astype(np.int64)) >= least - (HITS - 1)) & (a["sig"] != b["sig"])
        if ok.any():
            x, y = a["sig"][ok], b["sig"][ok]
            if right is None:
                x, y = np.minimum(x, y), np.maximum(x, y)
            must = np.minimum(least[ok], HITS).astype(np.int32)
            order = np.lexsort((y, x))
            x, y, must = x[order], y[order], must[order]
            first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
            yield x[first], y[first], np.diff(np.concatenate([first, [len(x)]])), must[first]


def _ranges(left: np.ndarray, right: np.ndarray | None, lo_ratio: float):
    """Pairs of entries of one group whose sizes are close enough, some millions at a time."""
    big = np.int64(1) << 33
    other = left if right is None else right
    key = other["g"].astype(np.int64) * big + other["n"]
    base = left["g"].astype(np.int64) * big
    hi = np.searchsorted(key, base + np.floor(left["n"] / lo_ratio + 1e-9).astype(np.int64), side="right")
    if right is None:
        lo = np.arange(len(left)) + 1
    else:
        lo = np.searchsorted(key, base + np.ceil(left["n"] * lo_ratio - 1e-9).astype(np.int64), side="left")
    count = np.maximum(hi - lo, 0)
    upto = np.concatenate([[0], np.cumsum(count)])
    done, total = 0, int(upto[-1])
    while done < total:
        stop = min(total, done + PAIRS_AT_ONCE)
        at = np.arange(done, stop)
        i = np.searchsorted(upto, at, side="right") - 1
        yield left[i], other[lo[i] + (at - upto[i])]
        done = stop


_GROUPED = np.dtype([*ENTRY.descr, ("g", "<u4")])


def _grouped(entries: np.ndarray, g: np.ndarray) -> np.ndarray:
    out = np.empty(len(entries), dtype=_GROUPED)
    for f in ENTRY.names:
        out[f] = entries[f]
    out["g"] = g
    return out[np.lexsort((out["n"], out["g"]))]


def candidates(blobs: DataFrame, n_buckets: int, lo_ratio: float, need, two_sided: bool) -> DataFrame:
    """Rows of kind MEMBER (signature, key, size, side, bitmap) and CANDIDATE (signature, signature, hits in n, hits needed in side)."""

    def reduce(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, posts, shift = [], [], 0
        for batch in rows:
            for b, d, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if b < 0:
                    m = np.frombuffer(d, dtype=RECORD)
                    yield _rows(MEMBER, m["sig"], m["key"], m["n"], p[0], m["bits"])
                    continue
                docs.append(np.frombuffer(d, dtype=DOC))
                q = np.frombuffer(p, dtype=POST).copy()
                q["doc"] += shift
                shift += len(docs[-1])
                posts.append(q)
        if not posts:
            return
        docs, posts = np.concatenate(docs), np.concatenate(posts)
        ids = posts["low"].astype(np.uint64) | (posts["high"].astype(np.uint64) << np.uint64(32))
        order = np.argsort(ids)
        ids = ids[order]
        new = np.ones(len(ids), dtype=bool)
        new[1:] = ids[1:] != ids[:-1]
        size = np.diff(np.concatenate([np.flatnonzero(new), [len(ids)]]))
        g = np.cumsum(new) - 1
        keep = size[g] > 1
        order, g = order[keep], g[keep]
        entries = np.empty(len(order), dtype=ENTRY)
        of = posts["doc"][order]
        for f in ("sig", "n", "side"):
            entries[f] = docs[f][of]
        entries["at"] = posts["at"][order]
        del posts, docs
        # copies that came from several tasks count once
        e = _grouped(entries, g)
        e = e[np.lexsort((e["sig"], e["n"], e["g"]))]
        same = np.zeros(len(e), dtype=bool)
        same[1:] = (e["g"][1:] == e["g"][:-1]) & (e["sig"][1:] == e["sig"][:-1]) & (e["side"][1:] == e["side"][:-1])
        e = e[~same]
        size = np.bincount(e["g"]) if len(e) else np.zeros(0, np.int64)
        hot = np.flatnonzero(size.astype(np.float64) ** 2 / 2 > HOT_PAIRS)
        if len(hot):
            for h in hot.tolist():
                own = e[e["g"] == h]
                cut = [own[i : i + HOT_BLOCK].tobytes() for i in range(0, len(own), HOT_BLOCK)]
                for i in range(len(cut)):
                    for j in range(i, len(cut)):
                        yield _rows(HOT, np.array([i]), np.array([j]), left=[cut[i]], right=[cut[j]])
            e = e[~np.isin(e["g"], hot)]
        yield from _found(e, lo_ratio, need, two_sided)

    def blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in (1, 2, 9, 10))):
                x, y = np.frombuffer(x, dtype=_GROUPED), np.frombuffer(y, dtype=_GROUPED)
                if a == b:
                    yield from _found(x, lo_ratio, need, two_sided)
                elif two_sided:
                    yield from _found(x, lo_ratio, need, True, y)
                else:
                    for p in _pairs(x, y, lo_ratio, need):
                        yield _rows(CANDIDATE, np.minimum(p[0], p[1]), np.maximum(p[0], p[1]), p[2], p[3])

    links = materialise(spread(blobs, n_buckets, "bucket").mapInArrow(reduce, _LINKS_DDL))
    rest = links.where(F.col("kind") == HOT).repartition(F.col("a"), F.col("b")).mapInArrow(blocks, _LINKS_DDL)
    return links.where(F.col("kind") != HOT).drop("left", "right").union(rest.drop("left", "right"))


def _found(e: np.ndarray, lo_ratio, need, two_sided: bool, with_: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    if not two_sided:
        sides = [(e, None)]
    elif with_ is None:
        sides = [(e[e["side"] == 0], e[e["side"] == 1])]
    else:
        sides = [(e[e["side"] == 0], with_[with_["side"] == 1]), (with_[with_["side"] == 0], e[e["side"] == 1])]
    for left, right in sides:
        for p in _pairs(left, right, lo_ratio, need):
            yield _rows(CANDIDATE, *p)


def _rows(kind: int, a, b, n=None, side: int = 0, bits=None, left=None, right=None) -> pa.RecordBatch:
    rows = len(a)
    bits = np.zeros((rows, 4), np.uint64) if bits is None else bits
    long = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(rows, kind, np.int32)), long(a), long(b), pa.array(np.zeros(rows, np.int32) if n is None else n.astype(np.int32)), pa.array(np.broadcast_to(np.asarray(side, np.int32), rows)),
            *(long(bits[:, i]) for i in range(4)), pa.array([None] * rows if left is None else left, pa.binary()), pa.array([None] * rows if right is None else right, pa.binary()),
        ],
        schema=_LINKS,
    )


def buckets_for(n_postings: float) -> int:
    return int(max(12, np.ceil(n_postings / POSTINGS_A_BUCKET)))


WIDTH = 5  # bytes of a shingle in a packed set


def sets_of(df: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """key, ids: the set of each text, packed; for the documents of candidates."""
    schema = pa.schema([(key, pa.int64()), ("ids", pa.binary())])

    def emit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free = np.zeros(2, dtype=np.uint8)
        for batch in rows:
            for part in codes.slices(batch, text):
                s = Sets(part.column(1), shingle, free)
                keys = part.column(0).to_numpy(zero_copy_only=False)[s.row] if len(s.row) else []
                packed = np.ascontiguousarray(s.ids.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH]).tobytes()
                ids = [packed[a * WIDTH : b * WIDTH] for a, b in zip(s.start[:-1].tolist(), s.start[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.binary())], schema=schema)

    return df.select(key, text).mapInArrow(emit, f"{key} long, ids binary")


def _unpack(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of all sets of a column, and each one's row."""
    raw = col.to_pylist()
    size = np.array([len(v) // WIDTH for v in raw], dtype=np.int64)
    wide = np.zeros((int(size.sum()), 8), dtype=np.uint8)
    wide[:, :WIDTH] = np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(-1, WIDTH)
    return wide.view("<u8").reshape(-1), np.repeat(np.arange(len(raw)), size)


def overlaps(pairs: DataFrame) -> DataFrame:
    """For rows (a, b, x, y) with packed sets x and y: a, b, and the numbers of common and of all shingles."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("common", pa.int64()), ("every", pa.int64())])

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                (x, rx), (y, ry) = _unpack(batch.column(2)), _unpack(batch.column(3))
                ids, row = np.concatenate([x, y]), np.concatenate([rx, ry])
                order = np.lexsort((ids, row))
                ids, row = ids[order], row[order]
                twice = (ids[1:] == ids[:-1]) & (row[1:] == row[:-1])
                common = np.bincount(row[1:][twice], minlength=batch.num_rows)
                every = np.bincount(row, minlength=batch.num_rows) - common
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(every, pa.int64())], schema=schema)

    return pairs.select("a", "b", "x", "y").mapInArrow(count, "a long, b long, common long, every long")


class Join:
    """Members and verified links of one side with itself, or of two sides.

    Shingles are ordered by counts in 2**slot_bits slots, which is also the number of bytes that reach the driver and
    all tasks: more of them order a larger collection finer.

    left and right have a BIGINT ``key`` and a string ``body``, both without nulls.  Pairs of equal sets are
    not among the links; they share their signature.
    """

    def __init__(self, left: DataFrame, right: DataFrame | None, shingle: int, jaccard: float, front: Callable, need: Callable, lo_ratio: float, front_share: float, slot_bits: int = slots.SLOT_BITS):
        both = left if right is None else left.union(right)

        def things(part: pa.RecordBatch) -> np.ndarray:
            w = codes.plain_words(part.column(0))
            return codes.ngrams(w.hash, w.doc, shingle)[0]

        cost, total = slots.log_counts(both.select("body"), "body", things, bits=slot_bits)
        n_buckets = buckets_for(total * front_share)
        blobs = postings(left, "key", "body", shingle, cost, front, 0, n_buckets)
        if right is not None:
            blobs = blobs.union(postings(right, "key", "body", shingle, cost, front, 1, n_buckets))
        links = candidates(blobs, n_buckets, lo_ratio, need, right is not None)
        records = links.where(F.col("kind") == MEMBER)
        #: (sig, key, side) of each record.
        self.members = records.select(F.col("a").alias("sig"), F.col("b").alias("key"), "side").distinct()
        one = records.groupBy(F.col("a").alias("sig")).agg(F.first("n").alias("n"), *(F.first(f"bits{i}").alias(f"bits{i}") for i in range(4)))
        found = links.where(F.col("kind") == CANDIDATE).groupBy("a", "b").agg(F.sum("n").alias("hits"), F.max("side").alias("must")).where("hits >= must").select("a", "b")
        x, y = (one.select(F.col("sig").alias(k), F.col("n").alias(f"n{k}"), *(F.col(f"bits{i}").alias(f"{k}{i}") for i in range(4))) for k in "ab")
        found = found.join(x, "a").join(y, "b")
        differ = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(1, 4)), F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))))
        most = (F.col("na") + F.col("nb") - differ) / 2
        found = materialise(found.where(most >= jaccard / (1 + jaccard) * (F.col("na") + F.col("nb")) - 1e-9).select("a", "b"))
        if right is None:
            ends = found.select(F.col("a").alias("sig")).union(found.select("b"))
            x = y = materialise(self._sets(ends, 0, left, shingle))
        else:
            x, y = self._sets(found.select(F.col("a").alias("sig")), 0, left, shingle), self._sets(found.select(F.col("b").alias("sig")), 1, right, shingle)
        pairs = found.join(x.select(F.col("sig").alias("a"), F.col("ids").alias("x")), "a").join(y.select(F.col("sig").alias("b"), F.col("ids").alias("y")), "b")
        #: Verified pairs of signatures (a, b, common, every), in the shared folder.
        self.links = materialise(overlaps(pairs).where(F.col("common") >= jaccard * F.col("every") - 1e-9))

    def _sets(self, wanted: DataFrame, side: int, docs: DataFrame, shingle: int) -> DataFrame:
        """(sig, ids): one record of each wanted signature is read again."""
        own = self.members.where(F.col("side") == side)
        key_of = materialise(own.join(wanted.distinct(), "sig", "left_semi").groupBy("sig").agg(F.min("key").alias("key")))
        few = key_of.count() <= BROADCAST_KEYS
        keys = key_of.select("key")
        ids = sets_of(docs.join(F.broadcast(keys) if few else keys, "key", "left_semi"), "key", "body", shingle)
        return key_of.join(ids, "key").select("sig", "ids").dropDuplicates(["sig"])
