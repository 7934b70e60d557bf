"""Problem 1: lines repeated across one site's documents.

A line's wording is its words without digits, punctuation, ornaments and the names of months and days.  One
stretch of two words may be a personal name, another in each document: besides its own wording each line has
those with any one such stretch left open, and those with all words left open that are rarer in its source than
one of the line's own: any number of names, of two words each, or of one to NAME_WORDS in a line that doesn't end
as a sentence does (sentences built alike are an article's, not standing lines).  A standing line's fixed words each stand in enough documents of its
source, so words are counted first, exactly, and wordings with another fixed word are left out.  For each
source and wording the documents of all variant lines are united as compressed bitmaps, and a wording with
enough documents is a standing line.  Beside each bitmap stands the list of its lines (document and number), by which
they are deleted: a bitmap tells the document, not the line, and a lookup of these documents in it is always true.

* An open wording only counts if no single filling makes up more than half of its lines and there are three or
  more fillings; else the variants are different wordings, not one with values filled in.
* Documents without a source belong to no source.  Null texts hold no lines but count as documents.
* Repeated rows of one document count once.
* A wording all of whose fixed words are very frequent in its source may be a hot one, with a large share of all
  documents.  The lines and fillings of such wordings are counted first, exactly and pre-aggregated; those that
  can't be standing lines are left out, and the lines of the others are spread by document over as many buckets as
  their number needs.  The parts' bitmaps hold different documents, so their cardinalities add up.
* The frequent words of a source are few (with a least share of 10 % at most ten times the words of its average
  document).  Where those of all sources are too many for one broadcast, the sources are taken in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmaps, codes, tallies
from ._spark import batches, materialise, spread

# Words of dates in Hindi, Nepali and English.
DATE_WORDS = """
जनवरी फ़रवरी फरवरी मार्च अप्रैल मई जून जुलाई अगस्त सितंबर सितम्बर अक्टूबर अक्तूबर नवंबर नवम्बर दिसंबर दिसम्बर
वैशाख बैशाख जेठ ज्येष्ठ असार आषाढ़ आषाढ साउन श्रावण सावन भदौ भाद्र असोज आश्विन कात्तिक कार्तिक मंसिर मङ्सिर पुस पौष माघ फागुन फाल्गुन चैत चैत्र
सोमवार मंगलवार बुधवार गुरुवार शुक्रवार शनिवार रविवार आइतबार सोमबार मङ्गलबार मंगलबार बुधबार बिहीबार शुक्रबार शनिबार
जनवरी फेब्रुअरी मार्च अप्रिल मे जुन जुलाई अगस्ट सेप्टेम्बर अक्टोबर नोभेम्बर डिसेम्बर
January February March April May June July August September October November December
Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec
Monday Tuesday Wednesday Thursday Friday Saturday Sunday
""".split()

ENTRY = np.dtype([("key", "<u8"), ("source", "<u8"), ("doc", "<i8"), ("fill", "<u4"), ("line", "<u4"), ("hot", "u1")])
#: Rows of each fixed word from which on a wording's lines are counted before they are sent, and spread in parts of so many.
HOT = 4096
LINES_A_BUCKET = 400_000
#: Frequent words that are sent to all tasks at once (64 MB); with more the sources are taken in blocks.
MOST_WORDS = 4_000_000
_WORD = np.dtype([("key", "<u8"), ("source", "<u8"), ("n", "<i8")])
_HOT = np.dtype([("pair", "<u8"), ("key", "<u8"), ("source", "<u8"), ("fill", "<u4"), ("n", "<i8")])
_OPEN, _STRETCH = np.uint64(0x0BADC0FFEE0DDF00), np.uint64(0x5EED0FA11BADF00D)
#: The most words of a personal name.
NAME_WORDS = 4
#: What ends a sentence.
SENTENCE = "।॥?!|"
_BLOB = pa.schema([("bucket", pa.int32()), ("entries", pa.binary())])
_GROUP = pa.schema([("key", pa.int64()), ("source_id", pa.int64()), ("n_docs", pa.int64()), ("bitmap", pa.binary()), ("lines", pa.binary())])
_GROUP_DDL = "key long, source_id long, n_docs long, bitmap binary, lines binary"
_BLANK = (0xA0, 0xAD, 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, *range(0x2060, 0x2065), 0x3000, 0xFEFF)


def _table(chosen: list[int]) -> np.ndarray:
    out = np.zeros(0x110000, dtype=bool)
    out[chosen] = True
    return out


_IS_BLANK, _IS_SENTENCE = _table([*range(0x21), *_BLANK]), _table([ord(c) for c in SENTENCE])
_LINE = np.dtype([("doc", "<i8"), ("line", "<u4")])


@lru_cache(maxsize=1)
def _date_hashes() -> np.ndarray:
    cps, off = codes.nfkc(*codes.from_strings(list(dict.fromkeys(DATE_WORDS))))
    return np.sort(codes.words(cps, off, codes.char_class()[cps] == codes.WORD).hash)


class Lines:
    """Words of the lines of a slice's texts: hash, position in the line; and each line's document and number."""

    def __init__(self, col: pa.Array):
        cps, off, is_word = codes.folded(col, digits=False)
        w = codes.words(cps, off, is_word)
        newlines = np.concatenate([[0], np.cumsum(cps == 0x0A)])
        line = newlines[w.start] - newlines[off[w.doc]] if len(w.doc) else np.zeros(0, np.int64)
        dates = _date_hashes()
        at = np.minimum(np.searchsorted(dates, w.hash), len(dates) - 1)
        keep = dates[at] != w.hash
        self.hash, self.word_doc, line = w.hash[keep], w.doc[keep], line[keep]
        new = np.ones(len(line), dtype=bool)
        new[1:] = (line[1:] != line[:-1]) | (self.word_doc[1:] != self.word_doc[:-1])
        self.first = np.flatnonzero(new)
        self.of = np.cumsum(new) - 1
        self.doc, self.line = self.word_doc[self.first], line[self.first]
        self.size = np.diff(np.concatenate([self.first, [len(line)]]))
        self.at = np.arange(len(line)) - self.first[self.of] if len(line) else np.zeros(0, np.int64)
        # whether only blanks lie between a word and the one before it
        solid = np.concatenate([[0], np.cumsum(~_IS_BLANK[cps])])
        start, end = w.start[keep], w.end[keep]
        self.joined = np.zeros(len(line), dtype=bool)
        self.joined[1:] = ~new[1:] & (solid[start[1:]] == solid[end[:-1]])
        # whether what follows a line's last word ends a sentence
        cut = np.concatenate([np.flatnonzero(cps == 0x0A), [len(cps)]])
        marks = np.concatenate([[0], np.cumsum(_IS_SENTENCE[cps])])
        last = end[self.first + self.size - 1] if len(line) else self.first
        self.sentence = marks[np.minimum(cut[np.searchsorted(cut, last)], off[self.doc + 1])] > marks[last]


class Frequent:
    """Rows of their source that the frequent words stand in, by the hash of word and source."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.rows = keys[order], rows[order]

    def of(self, keys: np.ndarray) -> np.ndarray:
        """0 for words that aren't frequent."""
        if not len(self.keys):
            return np.zeros(len(keys), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rows[at], 0)


def _sites(part: pa.RecordBatch) -> np.ndarray:
    return part.column(1).to_numpy(zero_copy_only=False).view(np.uint64)


def _buckets(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def frequent(full: DataFrame, totals: DataFrame, least_docs: int, least_share: float) -> tuple[DataFrame, int]:
    """(source_id, key, n): the words that stand in enough rows of their source to be fixed words of a standing line, counted exactly; and the number of all words."""
    schema = pa.schema([("source_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64())])

    def once(part: pa.RecordBatch) -> np.ndarray:
        lines, source = Lines(part.column(2)), _sites(part)
        key = codes.mix(lines.hash ^ source[lines.word_doc])
        order = np.lexsort((key, lines.word_doc))
        k, d = key[order], lines.word_doc[order]
        first = np.ones(len(k), dtype=bool)
        first[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
        out = np.zeros(int(first.sum()), dtype=_WORD)
        out["key"], out["source"], out["n"] = k[first], source[d[first]], 1
        return out

    def choose(e: np.ndarray) -> Iterator[pa.RecordBatch]:
        good = e[e["n"] >= least_docs]
        # one row without a source has the number of all words
        n = np.append(good["n"], e["n"].sum())
        source = pa.array(np.append(good["source"].view(np.int64), 0), mask=np.arange(len(n)) == len(good))
        yield pa.RecordBatch.from_arrays([source, pa.array(np.append(good["key"].view(np.int64), 0)), pa.array(n)], schema=schema)

    rows = materialise(tallies.tallied(full, "body", once, ("key", "source"), np.zeros(0, dtype=_WORD), _buckets(full), choose, "source_id long, key long, n long"))
    n_words = rows.where("source_id is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    enough = rows.join(totals, "source_id").where(F.col("n") >= F.lit(least_share) * F.col("total") - 1e-9)
    return materialise(enough.select("source_id", "key", "n")), n_words


def _frequent(rows: DataFrame) -> Frequent:
    got = rows.select("key", "n").toArrow()
    return Frequent(got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy())


def _entries(lines: Lines, source: np.ndarray, keys: np.ndarray, table: Frequent, hot_from: int, only_hot: bool = False) -> np.ndarray:
    """The own wording of each line and those with words left open, if all their fixed words are frequent; or only the hot ones."""
    if not len(lines.first):
        return np.zeros(0, dtype=ENTRY)
    power, _ = codes._powers(int(lines.size.max()) + 1)
    part = lines.hash * power[lines.at]
    whole = np.add.reduceat(part, lines.first)
    src = source[lines.doc]
    n = table.of(codes.mix(lines.hash ^ source[lines.word_doc]))
    rare, cold = (n == 0).astype(np.int64), (n < hot_from).astype(np.int64)
    n_rare, n_cold = (np.add.reduceat(x, lines.first) for x in (rare, cold))
    out = []

    def add(rows: np.ndarray, value: np.ndarray, size: np.ndarray, fill: np.ndarray | int, hot: np.ndarray) -> None:
        e = np.empty(len(rows), dtype=ENTRY)
        e["key"] = codes.mix(value ^ codes.mix(src[rows] + size.astype(np.uint64)))
        e["source"], e["doc"], e["fill"], e["line"] = src[rows], keys[lines.doc[rows]], fill, lines.line[rows]
        e["hot"] = hot
        out.append(e)

    rows = np.flatnonzero((n_cold if only_hot else n_rare) == 0)
    add(rows, whole[rows], lines.size[rows], 0, n_cold[rows] == 0)
    i = np.flatnonzero(lines.of[1:] == lines.of[:-1])
    i = i[(lines.size[lines.of[i]] >= 3) & (rare[i] + rare[i + 1] == n_rare[lines.of[i]])]
    if only_hot:
        i = i[cold[i] + cold[i + 1] == n_cold[lines.of[i]]]
    rows = lines.of[i]
    value = whole[rows] - part[i] - part[i + 1] + _OPEN * power[lines.at[i]]
    fill = (codes.mix(lines.hash[i] * np.uint64(3) + lines.hash[i + 1]) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    add(rows, value, lines.size[rows], fill, cold[i] + cold[i + 1] == n_cold[rows])
    for x in _stretches(lines, n, hot_from if only_hot else 1):
        add(x.rows, x.value, x.size, x.fill, x.least >= hot_from)
    return np.concatenate(out)


class _Wordings(NamedTuple):
    rows: np.ndarray
    value: np.ndarray
    size: np.ndarray
    fill: np.ndarray
    #: Count of the least frequent fixed word.
    least: np.ndarray


def _stretches(lines: Lines, n: np.ndarray, least: int = 1) -> Iterator[_Wordings]:
    """Wordings with all words left open that are rarer in their source than one of the line's own, for each of these with ``least`` rows.

    A stretch holds one or more names, with signs between them.  With a higher bound names only grow and unite, so a
    line is done when something is longer than a name.
    """
    power, _ = codes._powers(int(lines.size.max()) + 1)
    none = np.iinfo(np.int64).max
    bound = np.minimum.reduceat(np.where(n >= max(least, 1), n, none), lines.first)
    line = np.flatnonzero(bound < none)
    while len(line):
        mine = np.zeros(len(lines.first), dtype=bool)
        mine[line] = True
        token = np.flatnonzero(mine[lines.of])
        size = lines.size[line]
        first = np.cumsum(size) - size
        of = np.repeat(np.arange(len(line)), size)
        count, hashes, limit = n[token], lines.hash[token], bound[line]
        is_open = count < limit[of]
        begins = is_open.copy()
        begins[1:] &= ~is_open[:-1] | (of[1:] != of[:-1])
        # a stretch may hold several names with signs between them
        names = is_open & (begins | ~lines.joined[token])
        length = np.bincount((np.cumsum(names) - 1)[is_open], minlength=int(names.sum()))
        owner = of[names]
        longest, shortest = np.zeros(len(line), np.int64), np.full(len(line), NAME_WORDS + 1)
        np.maximum.at(longest, owner, length)
        np.minimum.at(shortest, owner, length)
        n_names = np.bincount(owner, minlength=len(line))
        # in a sentence only two words are taken for a name, and one such name has its wordings already
        sentence = lines.sentence[line]
        alive = longest <= np.where(sentence, 2, NAME_WORDS)
        good = alive & (n_names > 0) & (~sentence | (n_names > 1) & (shortest == 2))
        shown = begins | ~is_open
        upto = np.cumsum(shown)
        place = np.where(shown, upto - upto[first][of], 0)
        value = np.add.reduceat(np.where(shown, np.where(begins, _STRETCH, hashes) * power[place], np.uint64(0)), first)
        fill = np.add.reduceat(np.where(is_open, hashes * power[lines.at[token]], np.uint64(0)), first)
        fill = (codes.mix(fill) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        g = np.flatnonzero(good)
        yield _Wordings(line[g], value[g], np.add.reduceat(shown.astype(np.int64), first)[g], fill[g], limit[g])
        higher = np.minimum.reduceat(np.where(count > limit[of], count, none), first)
        bound[line] = higher
        line = line[alive & (higher < none)]


def _groups(e: np.ndarray, least_docs: int) -> Iterator[pa.RecordBatch]:
    """For each wording with enough documents its bitmap and lines; for a hot one, known to be accepted, those of this part of it."""
    e = e[np.lexsort((e["doc"], e["fill"], e["key"]))]
    cut = np.concatenate([np.flatnonzero(np.concatenate([[True], e["key"][1:] != e["key"][:-1]])), [len(e)]])
    some = (np.diff(cut) >= least_docs) | (e["hot"][cut[:-1]] > 0)
    for a, b in zip(cut[:-1][some].tolist(), cut[1:][some].tolist()):
        own = e[a:b]
        hot = bool(own["hot"][0])
        fills, start, n = np.unique(own["fill"], return_index=True, return_counts=True)
        # a wording without a value filled in, or with three or more of which none has more than half of the lines
        if not hot and fills[0] != 0 and (len(fills) < 3 or n.max() * 2 > n.sum()):
            continue
        stop = [*start[1:].tolist(), len(own)]
        united = bitmaps.union([bitmaps.encode(own["doc"][i:j]) for i, j in zip(start.tolist(), stop)])
        n_docs = bitmaps.cardinality(united)
        if not hot and n_docs < least_docs:
            continue
        lines = np.empty(len(own), dtype=_LINE)
        lines["doc"], lines["line"] = own["doc"], own["line"]
        as_long = lambda x: [int(x[:1].view(np.int64)[0])]
        yield batches(_GROUP, key=as_long(own["key"]), source_id=as_long(own["source"]), n_docs=[n_docs], bitmap=[united], lines=[lines.tobytes()])


def _hot(full: DataFrame, entries, totals: DataFrame, least_docs: int, least_share: float) -> tuple[np.ndarray, np.ndarray]:
    """The hot wordings that may be standing lines, sorted, and the number of lines of each.

    Each pair of wording and filling is counted in one bucket, and a wording's pairs lie in all buckets.  A
    standing line has at least as many lines as documents, so those that are left are few.
    """
    schema = pa.schema([("key", pa.int64()), ("source_id", pa.int64()), ("n", pa.int64()), ("most", pa.int64()), ("fills", pa.int64()), ("plain", pa.bool_())])

    def pairs(part: pa.RecordBatch) -> np.ndarray:
        e = entries(part, True)
        out = np.ones(len(e), dtype=_HOT)
        for f in ("key", "source", "fill"):
            out[f] = e[f]
        out["pair"] = codes.mix(e["key"] ^ codes.mix(e["fill"].astype(np.uint64)))
        return out

    def choose(e: np.ndarray) -> Iterator[pa.RecordBatch]:
        e = e[np.argsort(e["key"], kind="stable")]
        first = np.flatnonzero(np.concatenate([[True], e["key"][1:] != e["key"][:-1]])) if len(e) else np.zeros(0, np.int64)
        of = lambda f, v: f.reduceat(v, first) if len(e) else np.zeros(0, np.int64)
        n = np.diff(np.concatenate([first, [len(e)]]))
        columns = (e["key"][first].view(np.int64), e["source"][first].view(np.int64), of(np.add, e["n"]), of(np.maximum, e["n"]), n, of(np.minimum, e["fill"]) == 0)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    parts = tallies.tallied(full, "body", pairs, ("pair", "key", "source", "fill"), np.zeros(0, dtype=_HOT), _buckets(full), choose, "key long, source_id long, n long, most long, fills long, plain boolean")
    whole = parts.groupBy("key", "source_id").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.sum("fills").alias("fills"), F.max("plain").alias("plain"))
    good = whole.where((F.col("n") >= least_docs) & (F.col("plain") | (F.col("fills") >= 3) & (F.col("most") * 2 <= F.col("n"))))
    got = good.join(totals, "source_id").where(F.col("n") >= F.lit(least_share) * F.col("total") - 1e-9).select("key", "n").toArrow()
    keys, n = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def standing(
    df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", least_docs: int = 4, least_share: float = 0.10, hot_from: int = HOT, most_words: int = MOST_WORDS, lines_a_bucket: int = LINES_A_BUCKET
) -> DataFrame:
    """(source, n_docs, bitmap, lines): the wordings of standing lines, hot ones in parts, in the shared folder."""
    docs = df.select(F.col(key).cast("long").alias("key"), F.col(source).cast("string").alias("site"), F.col(text).alias("body")).where("key is not null and site is not null")
    full = docs.where("body is not null and body <> ''").select("key", F.xxhash64("site").alias("source_id"), "body")
    totals = materialise(docs.groupBy("site").agg(F.count_distinct("key").alias("total")).select(F.xxhash64("site").alias("source_id"), F.col("site").alias("source"), "total"))
    words, n_words = frequent(full, totals.select("source_id", "total"), least_docs, least_share)
    n_blocks = max(1, -(-words.count() // most_words))
    out = None
    for b in range(n_blocks):
        of = lambda rows, b=b: rows if n_blocks == 1 else rows.where(F.pmod("source_id", F.lit(n_blocks)) == b)
        part = _block(of(full), of(words), of(totals), n_words // n_blocks, least_docs, least_share, hot_from, lines_a_bucket)
        out = part if out is None else out.union(part)
    return out


def _block(full: DataFrame, words: DataFrame, totals: DataFrame, n_words: int, least_docs: int, least_share: float, hot_from: int, lines_a_bucket: int) -> DataFrame:
    sc = full.sparkSession.sparkContext
    known = _frequent(words)
    table = sc.broadcast(known)

    def entries(part: pa.RecordBatch, only_hot: bool = False) -> np.ndarray:
        return _entries(Lines(part.column(2)), _sites(part), part.column(0).to_numpy(zero_copy_only=False), table.value, hot_from, only_hot)

    any_hot = bool(len(known.rows)) and int(known.rows.max()) >= hot_from
    hot = _hot(full, entries, totals.select("source_id", "total"), least_docs, least_share) if any_hot else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    accepted = sc.broadcast(hot)
    n_buckets = int(max(12, n_words // (8 * lines_a_bucket) + hot[1].sum() // lines_a_bucket))

    def emit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = accepted.value
        for batch in rows:
            for part in codes.slices(batch, "body"):
                e = entries(part)
                salt = np.zeros(len(e), dtype=np.uint64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, e["key"]), len(keys) - 1)
                    good = (keys[at] == e["key"]) & (e["hot"] > 0)
                    salt = np.where(good, codes.mix(e["doc"].view(np.uint64).copy()) % (n[at] // max(1, hot_from) + 1).astype(np.uint64), np.uint64(0))
                    keep = good | (e["hot"] == 0)
                else:
                    keep = e["hot"] == 0
                e, salt = e[keep], salt[keep]
                bucket = (codes.mix(e["key"] + salt) % np.uint64(n_buckets)).astype(np.int64)
                e = e[np.argsort(bucket, kind="stable")]
                cut = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=n_buckets))])
                some = np.flatnonzero(np.diff(cut))
                yield batches(_BLOB, bucket=some.tolist(), entries=[e[cut[b] : cut[b + 1]].tobytes() for b in some.tolist()])

    def reduce(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(v, dtype=ENTRY) for batch in rows for v in batch.column(1).to_pylist()]
        if parts:
            yield from _groups(np.concatenate(parts), least_docs)

    groups = materialise(spread(full.mapInArrow(emit, "bucket int, entries binary"), n_buckets, "bucket").mapInArrow(reduce, _GROUP_DDL))
    # the parts of a wording hold different documents
    every = groups.groupBy("key", "source_id").agg(F.sum("n_docs").alias("all_docs"))
    enough = every.join(totals, "source_id").where((F.col("all_docs") >= least_docs) & (F.col("all_docs") >= F.lit(least_share) * F.col("total") - 1e-9))
    found = groups.drop("source_id").join(enough.select("key", "source", "all_docs"), "key")
    return materialise(found.select("source", F.col("all_docs").alias("n_docs"), "bitmap", "lines"))


def lines_of(found: DataFrame) -> DataFrame:
    """(doc_id, line_no) of all standing lines, from the lists of lines beside the bitmaps."""
    schema = pa.schema([("doc_id", pa.int64()), ("line_no", pa.int32())])

    def explode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for lines in batch.column(0).to_pylist():
                x = np.frombuffer(lines, dtype=_LINE)
                yield pa.RecordBatch.from_arrays([pa.array(x["doc"].copy()), pa.array(x["line"].astype(np.int32))], schema=schema)

    return found.select("lines").mapInArrow(explode, "doc_id long, line_no int").distinct()


def cleaned(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """(key, text, n_removed): each document's text without the standing lines of its source; nulls stay null."""
    gone = lines_of(standing(df, key, source, text, **how)).groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("body")).join(gone, "doc_id", "left")
    kept = F.array_join(F.filter(F.split("body", "\n", -1), lambda _, i: ~F.array_contains("gone", i)), "\n")
    return rows.select(F.col("doc_id").alias(key), F.when(F.col("gone").isNull(), F.col("body")).otherwise(kept).alias(text), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))
