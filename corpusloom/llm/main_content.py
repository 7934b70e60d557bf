"""Problem 5: page boilerplate mixed with main content.

The lines of a page are the nodes of a flow network.  A classifier's log-odds become the capacities to the two
terminals; edges between neighbouring lines, weaker across a line of the site's frame, and between lines two
apart make labels smooth.  The minimum cut separates the article from the rest.  Nodes whose terminal capacity
outweighs all their edges are settled first (no minimum cut labels them otherwise); the few that remain are
separated by augmenting paths.

The classifier is boosted trees.  There are no labelled pages, so it learns from about ``sample`` pages
whose lines are first labelled by a cut over a few certain signs (SIGNS); all pages are then scored by it.
What repeats over a site, and which lines head lists of links, is counted over all distinct pages, exactly: copies
of a page and pages fetched again count once, so that their articles don't look like the site's frame.  Only what
repeats enough is kept, which is little for each site; where it is too much to send to all tasks at once, the sites
are taken in blocks.

Blank lines are never article lines; a null text has no lines; repeated rows of a page count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codes, tallies, trees
from ._spark import materialise
from .standing_lines import _date_hashes

#: Pages the classifier is fitted on, at most twice as many; of these those with at most so many characters.
SAMPLE, SAMPLE_CHARS = 1000, 50_000
MOST_ODDS = 8.0
#: The classifier sees a line's neighbours itself, so its cut has weaker edges than the first one.
WEAKER = 0.4
SIDE, NEXT_SIDE, OVER_FRAME = 1.6, 0.5, 0.8
#: A line that stands on this share of a site's pages, and on this many, is the site's frame.
SITE_SHARE, SITE_LEAST = 0.02, 5
#: So is one that this share of all pages has, and this many.
OFTEN_SHARE, OFTEN_LEAST = 0.002, 25
#: Lines of frames that are sent to all tasks at once (some 40 MB); with more the sites are taken in blocks.
MOST_FRAMES = 2_000_000
_GLOBAL, _LABEL = (np.uint64(x * 0x9E3779B97F4A7C15 & (2**64 - 1)) for x in (3, 13))
#: A wording (or label) of a site, on how many of its pages, and followed by how many links and sentences.
_TALLY = np.dtype([("key", "<u8"), ("site", "<u8"), ("n", "<i8"), ("links", "<i8"), ("prose", "<i8")])
_FRAME = pa.schema([("site_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("everywhere", pa.int64()), ("heads", pa.bool_())])
_FRAME_DDL = "site_id long, key long, n long, everywhere long, heads boolean"

# Signs that end a sentence, and those that begin a list item.
ENDS = "।॥.?!|…\"”’»"
SENTENCE = "।॥?!|"
BULLETS = "•-–—*▪●◦·"
QUOTES = "\"“”'‘’«»"

FEATURES = ("frame", "often", "prose", "single", "piece", "short", "item", "quote", "title", "early", "links", "byline", "advert", "words", "no_prose", "no_title", "before_prose", "after_prose", "before_piece", "after_piece")
#: Log-odds of the certain signs; lines with none of them are left to their neighbours.
SIGNS = {"frame": -6.0, "prose": 5.0, "single": 5.0, "item": 1.5, "piece": -8.0, "title": 8.0, "early": -14.0, "links": -12.0, "byline": -8.0, "advert": -8.0}


def _table(chars: str) -> np.ndarray:
    out = np.zeros(0x110000, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_IS_END, _IS_SENTENCE, _IS_BULLET, _IS_QUOTE = (_table(x) for x in (ENDS, SENTENCE, BULLETS, QUOTES))


class Frames:
    """The lines that repeat: of each site (hash of wording and site) and of all sites (hash of wording)."""

    def __init__(self, keys: np.ndarray, everywhere: np.ndarray, heads: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.everywhere, self.heads = keys[order], everywhere[order], heads[order]

    def find(self, wording: np.ndarray, site: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which wordings are among the site's lines or those of all sites, and their entries' places."""
        hit, at = np.zeros(len(wording), dtype=bool), np.zeros(len(wording), dtype=np.int64)
        for key in (codes.mix(wording ^ _GLOBAL), codes.mix(wording ^ site)):
            if len(self.keys):
                place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                own = self.keys[place] == key
                hit, at = hit | own, np.where(own, place, at)
        return hit, at


class Page:
    """All non-blank lines of a slice's pages, with their place and what can be seen in each alone."""

    def __init__(self, text: pa.Array, title: pa.Array, site: np.ndarray):
        """site has a number (uint64) of each page's site."""
        cps, off, is_word = codes.folded(text)
        n_pages = len(off) - 1
        cut = np.flatnonzero(cps == 0x0A)
        # a line begins with its page and after each newline in it, also where that is the page's end
        start = np.concatenate([off[:-1], cut + 1])
        page = np.concatenate([np.arange(n_pages), np.searchsorted(off, cut, side="right") - 1])
        order = np.lexsort((start, page))
        start, page = start[order], page[order]
        first = np.searchsorted(page, np.arange(n_pages))
        end = np.concatenate([start[1:] - 1, [len(cps)]])
        end[np.concatenate([first[1:], [len(start)]]) - 1] = off[1:]
        number = np.arange(len(start)) - first[page]
        space = (cps <= 0x20) | (cps == 0xA0) | ((codes.char_class()[cps] == codes.GAP) & np.isin(cps, _SPACES))
        solid = np.concatenate([np.flatnonzero(~space), [len(cps)]])
        at = np.searchsorted(solid, start)
        head = solid[at]
        keep = head < end
        tail = solid[np.maximum(np.searchsorted(solid, end) - 1, 0)]
        self.page, self.number, start, end, head, tail = (x[keep] for x in (page, number, start, end, head, tail))
        self.n_pages = n_pages
        total = lambda mask: np.concatenate([[0], np.cumsum(mask)])
        span = lambda c: c[end] - c[start]
        w = codes.words(cps, off, is_word)
        begins = np.zeros(len(cps), dtype=bool)
        begins[w.start] = True
        self.words = span(total(begins))
        digit = codes.char_class()[cps] == codes.DIGIT
        letters = codes.words(cps, off, is_word & ~((cps >= 0x30) & (cps <= 0x39)) & ~digit)
        self.wording = self._hash(letters, start, end)
        # what stands before a colon, as in "Design: name"
        colon = np.concatenate([np.flatnonzero(cps == 0x3A), [len(cps)]])
        stop = colon[np.searchsorted(colon, start)]
        self.label = np.where(stop < end, self._hash(letters, start, np.minimum(stop, end)), np.uint64(0))
        self.ends = _IS_END[cps[tail]] if len(tail) else np.zeros(0, bool)
        self.shout = cps[tail] == 0x21 if len(tail) else self.ends
        inner = np.concatenate([[False], _IS_SENTENCE[cps[:-1]]]) & space if len(cps) else space
        self.sentences = span(total(inner)) + self.ends
        self.comma = span(total(cps == 0x2C)) > 0
        follows = np.concatenate([cps[1:], [0]]) if len(cps) else cps
        numbered = ((cps >= 0x30) & (cps <= 0x39) & (follows == 0x2E)) if len(cps) else space
        self.bullet = (_IS_BULLET[cps[head]] | numbered[head]) if len(head) else self.ends
        self.quote = _IS_QUOTE[cps[head]] & _IS_QUOTE[cps[tail]] if len(head) else self.ends
        title_cps, title_off, title_word = codes.folded(title)
        digit = codes.char_class()[title_cps] == codes.DIGIT
        tw = codes.words(title_cps, title_off, title_word & ~((title_cps >= 0x30) & (title_cps <= 0x39)) & ~digit)
        titles = self._hash(tw, title_off[:-1], title_off[1:])
        self.title = (self.wording == titles[self.page]) & (titles[self.page] != 0)
        #: Pages whose title isn't known, so that the headline must be found by its place.
        self.untitled = titles == 0
        self.source = site[self.page] if len(self.page) else np.zeros(0, np.uint64)

    @staticmethod
    def _hash(w: codes.Words, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One hash of the words of each stretch, without words of dates; 0 if it has none."""
        dates = _date_hashes()
        keep = dates[np.minimum(np.searchsorted(dates, w.hash), len(dates) - 1)] != w.hash
        w = codes.Words(w.start[keep], w.end[keep], w.doc[keep], w.hash[keep], w.n_docs)
        a, b = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
        if not len(w.hash) or not len(start):
            return np.zeros(len(start), dtype=np.uint64)
        power, inverse = codes._powers(len(w.hash) + 1)
        upto = np.concatenate([[np.uint64(0)], np.cumsum(w.hash * power[: len(w.hash)])])
        return np.where(b > a, codes.mix((upto[b] - upto[a]) * inverse[a] + (b - a).astype(np.uint64)), np.uint64(0))

    def kind(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """prose: two or more sentences; single: one; piece: four or more words without an end."""
        prose = self.ends & (self.sentences >= 2) & (self.words >= 8)
        single = self.ends & ~prose & (self.words >= 5)
        piece = ~self.ends & (self.words >= 4) & ~self.bullet & ~self.title & ~(self.comma & (self.words <= 6))
        return prose, single, piece

    def things(self) -> np.ndarray:
        """What is counted over all pages, once for each page: its wordings and labels, and what follows them."""
        prose, single, piece = self.kind()
        n = len(self.page)
        if not n:
            return np.zeros(0, dtype=_TALLY)
        next_ = np.append(self.page[1:] == self.page[:-1], False)
        label = np.flatnonzero(self._labelled())
        page = np.concatenate([self.page, self.page[label]])
        out = np.zeros(n + len(label), dtype=_TALLY)
        out["key"] = np.concatenate([self.wording, self.label[label] ^ _LABEL])
        out["site"] = self.source[np.concatenate([np.arange(n), label])]
        out["links"][:n] = next_ & np.append(piece[1:], False)
        out["prose"][:n] = next_ & np.append((prose | single)[1:], False)
        order = np.lexsort((out["key"], page))
        key, page = out["key"][order], page[order]
        out["n"][order] = np.concatenate([[True], (key[1:] != key[:-1]) | (page[1:] != page[:-1])])
        return out

    def _labelled(self) -> np.ndarray:
        return ~self.ends & (self.words <= 5) & (self.label != 0)

    def features(self, frames: Frames) -> np.ndarray:
        """One row of FEATURES for each line."""
        n = len(self.page)
        prose, single, piece = self.kind()
        repeats, entry = frames.find(self.wording, self.source)
        everywhere = np.where(repeats, frames.everywhere[entry], 0) if len(frames.keys) else np.zeros(n)
        frame = ~self.title & (repeats | (self.words == 0))
        heads = frame & repeats & frames.heads[entry] if len(frames.keys) else np.zeros(n, dtype=bool)
        prose, single, piece = prose & ~frame, single & ~frame, piece & ~frame
        # the last line of the frame before each line, if nothing but single lines and pieces lies between
        at = np.arange(n)
        first = np.concatenate([[True], self.page[1:] != self.page[:-1]]) if n else np.zeros(0, bool)
        stop = first | frame | prose | self.title
        since = np.maximum.accumulate(np.where(stop, at, 0)) if n else at
        under = heads[since] & ~stop if n else heads
        title_at = np.full(self.n_pages, -1)
        where = np.flatnonzero(self.title)
        title_at[self.page[where[::-1]]] = where[::-1]
        # without a title: the last piece before the first prose that only lines of the frame separate from it
        guess = self._headline(frame, prose, single, piece, under, title_at)
        title = self.title.copy()
        title[guess] = True
        title_at[self.page[guess]] = guess
        early = (at < title_at[self.page]) & (title_at[self.page] >= 0)
        piece, under = piece & ~title, under & ~title
        late_title = self.title & (at > title_at[self.page])
        byline = ~self.ends & self.comma & (self.words <= 6) & ~frame & ~self.bullet & ~title
        byline |= self._labelled() & ~frame & ~title & frames.find(self.label ^ _LABEL, self.source)[0]
        advert = self.shout & (self.words <= 4) & ~frame
        has_prose = np.bincount(self.page, prose, self.n_pages)[self.page] > 0
        before, after = self._beside(prose, frame, first), self._beside(piece | heads, frame & ~heads, first)
        short = ~self.ends & (self.words < 4) & ~frame & ~self.bullet & ~title
        columns = (frame, np.log1p(everywhere) / 10, prose, single, piece, short, self.bullet & ~frame, self.quote & ~frame, title & ~late_title, early, under, byline, advert, np.minimum(self.words, 60) / 60, ~has_prose, title_at[self.page] < 0, before[0], before[1], after[0], after[1])
        return np.stack([np.asarray(c, dtype=np.float64) for c in columns], axis=1) if n else np.zeros((0, len(FEATURES)))

    def _headline(self, frame, prose, single, piece, under, title_at) -> np.ndarray:
        n = len(self.page)
        if not n:
            return np.zeros(0, np.int64)
        at = np.arange(n)
        first_prose = np.full(self.n_pages, n)
        p = np.flatnonzero(prose)
        np.minimum.at(first_prose, self.page[p], p)
        text = (single & ~under) | prose
        begin = first_prose.copy()
        q = np.flatnonzero(text)
        np.minimum.at(begin, self.page[q], q)
        short = ~self.ends & self.comma & (self.words <= 6)
        usable = piece & ~short & (at < begin[self.page]) & self.untitled[self.page] & (first_prose[self.page] < n)
        last = np.full(self.n_pages, -1)
        u = np.flatnonzero(usable)
        np.maximum.at(last, self.page[u], u)
        return last[last >= 0]

    def _beside(self, mark: np.ndarray, through: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the nearest line before, and after, that is not passed through bears the mark."""
        n = len(mark)
        if not n:
            return mark, mark
        at = np.arange(n)
        solid = np.where(~through, at, -1)
        prev = np.concatenate([[-1], np.maximum.accumulate(solid)[:-1]])
        back = np.where(~through, at, n)
        nxt = np.concatenate([np.minimum.accumulate(back[::-1])[::-1][1:], [n]])
        ok_p = (prev >= 0) & (self.page[np.maximum(prev, 0)] == self.page)
        ok_n = (nxt < n) & (self.page[np.minimum(nxt, n - 1)] == self.page)
        return mark[np.maximum(prev, 0)] & ok_p, mark[np.minimum(nxt, n - 1)] & ok_n

    def edges(self, frame: np.ndarray, scale: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Capacity from each line to the next one, and to the one after that; 0 over the end of a page."""
        n = len(self.page)
        one, two = np.zeros(n), np.zeros(n)
        if n > 1:
            one[:-1] = np.where(self.page[1:] == self.page[:-1], np.where(frame[1:] | frame[:-1], OVER_FRAME / 2, SIDE), 0)
        if n > 2:
            two[:-2] = np.where(self.page[2:] == self.page[:-2], np.where(frame[1:-1] & ~frame[2:] & ~frame[:-2], OVER_FRAME, np.where(frame[2:] | frame[:-2], 0, NEXT_SIDE)), 0)
        return one * scale, two * scale


_SPACES = np.array([0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint32)


def minimum_cut(odds: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Labels (True: source side) of a minimum cut; odds > 0 is capacity from the source, < 0 to the sink.

    Lines are joined to the next with capacity one[i], and to the one after it with two[i], both ways.
    """
    n = len(odds)
    value = odds.astype(np.float64).copy()
    one, two = one.copy(), two.copy()
    label = np.zeros(n, dtype=np.int8)
    shift = lambda x, k: np.concatenate([np.zeros(k), x[:-k]])[:n] if n > k else np.zeros(n)
    while n:
        pull = one + two + shift(one, 1) + shift(two, 2)
        free = label == 0
        fix = free & (np.abs(value) >= pull - 1e-12)
        if not fix.any():
            break
        label[fix] = np.where(value[fix] > 0, 1, -1)
        # edges to settled lines become terminal capacity of the others
        for c, k in ((one, 1), (two, 2)):
            i = np.flatnonzero(c > 0)
            j = i + k
            sign_i, sign_j = label[i], label[j]
            np.add.at(value, j[(sign_i != 0) & (sign_j == 0)], (sign_i * c[i])[(sign_i != 0) & (sign_j == 0)])
            np.add.at(value, i[(sign_j != 0) & (sign_i == 0)], (sign_j * c[i])[(sign_j != 0) & (sign_i == 0)])
            c[i[(sign_i != 0) | (sign_j != 0)]] = 0
    rest = np.flatnonzero(label == 0)
    for part in _components(rest, one, two):
        for i, side in zip(part, _augment(part, value, one, two)):
            label[i] = 1 if side else -1
    return label > 0


def _components(rest: np.ndarray, one: np.ndarray, two: np.ndarray) -> Iterator[list[int]]:
    part: list[int] = []
    reach = -1
    for i in rest.tolist():
        if part and i > reach:
            yield part
            part = []
        part.append(i)
        reach = max(reach if len(part) > 1 else -1, i + (2 if two[i] > 0 else 1 if one[i] > 0 else 0))
    if part:
        yield part


def _augment(part: list[int], value: np.ndarray, one: np.ndarray, two: np.ndarray) -> list[bool]:
    """Source side of a minimum cut of one component by shortest augmenting paths; ties go to the sink."""
    index = {v: k for k, v in enumerate(part)}
    n = len(part)
    source, sink = n, n + 1
    cap: list[dict[int, float]] = [{} for _ in range(n + 2)]
    for k, v in enumerate(part):
        if value[v] > 0:
            cap[source][k], cap[k][source] = float(value[v]), 0.0
        elif value[v] < 0:
            cap[k][sink], cap[sink][k] = float(-value[v]), 0.0
        for c, step in ((one, 1), (two, 2)):
            if c[v] > 0 and v + step in index:
                j = index[v + step]
                cap[k][j] = cap[k].get(j, 0) + float(c[v])
                cap[j][k] = cap[j].get(k, 0) + float(c[v])
    while True:
        come = {source: -1}
        queue = [source]
        for u in queue:
            for v, c in cap[u].items():
                if c > 1e-9 and v not in come:
                    come[v] = u
                    queue.append(v)
            if sink in come:
                break
        if sink not in come:
            return [k in come for k in range(n)]
        path, v = [], sink
        while v != source:
            path.append((come[v], v))
            v = come[v]
        flow = min(cap[u][v] for u, v in path)
        for u, v in path:
            cap[u][v] -= flow
            cap[v][u] = cap[v].get(u, 0) + flow


def first_labels(x: np.ndarray, page: Page) -> np.ndarray:
    odds = sum(SIGNS[f] * x[:, FEATURES.index(f)] for f in SIGNS) + 0.4
    # a page with neither a headline nor a paragraph is a list of links
    odds = odds - 8.0 * x[:, FEATURES.index("no_prose")] * x[:, FEATURES.index("no_title")]
    return minimum_cut(odds, *page.edges(x[:, 0] > 0))


def odds_of(forest: trees.Forest, x: np.ndarray) -> np.ndarray:
    """The classifier's log-odds, within MOST_ODDS."""
    p = np.clip(forest.score(x), 1e-6, 1 - 1e-6)
    return np.clip(np.log(p / (1 - p)), -MOST_ODDS, MOST_ODDS)


def distinct_pages(df: DataFrame, pages: DataFrame, key: str, url: str) -> DataFrame:
    """(key): one of the pages with the same address, if there is a column of it, and of those of a site whose texts differ in digits at most."""
    same = pages.select("key", F.xxhash64("site", F.regexp_replace("body", r"\p{Nd}+", "")).alias("text_id"))
    if url in df.columns:
        plain = F.regexp_replace(F.trim(F.col(url).cast("string")), r"^(?i:https?://)?(?i:www\.)?|#.*$|/+(#.*)?$", "")
        links = df.select(F.col(key).cast("long").alias("key"), plain.alias("link")).where("key is not null and link <> ''").groupBy("key").agg(F.min("link").alias("link"))
        same = same.join(links, "key", "left").groupBy(F.coalesce("link", F.concat(F.lit(" "), F.col("key").cast("string")))).agg(F.min(F.struct("key", "text_id")).alias("x")).select("x.*")
    return materialise(same.groupBy("text_id").agg(F.min("key").alias("key")).select("key"))


def _page(part: pa.RecordBatch) -> Page:
    return Page(part.column(3), part.column(1), part.column(2).to_numpy(zero_copy_only=False).view(np.uint64))


def repeating(counted: DataFrame) -> DataFrame:
    """(site_id, key, n, everywhere, heads): wordings and labels that are frame, without a site if all sites'.

    counted has one row (key, head, site_id, body) for each distinct page.
    """
    n_buckets = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    often = max(OFTEN_LEAST, OFTEN_SHARE * counted.count())

    def choose(e: np.ndarray) -> Iterator[pa.RecordBatch]:
        # e is ordered by wording, then by site
        first = np.flatnonzero(np.concatenate([[True], e["key"][1:] != e["key"][:-1]]))
        size = np.diff(np.concatenate([first, [len(e)]]))
        total = {f: np.add.reduceat(e[f], first) for f in ("n", "links", "prose")}
        heads = (total["links"] > 1.5 * total["prose"]) & (total["links"] >= 3)
        of = np.repeat(np.arange(len(first)), size)
        own, all_ = np.flatnonzero(e["n"] >= SITE_LEAST), np.flatnonzero(total["n"] >= often)
        key = np.concatenate([e["key"][own], e["key"][first[all_]]])
        group = np.concatenate([of[own], all_])
        site = pa.array(np.concatenate([e["site"][own], np.zeros(len(all_), np.uint64)]).view(np.int64), mask=np.arange(len(key)) >= len(own))
        n = np.concatenate([e["n"][own], total["n"][all_]])
        yield pa.RecordBatch.from_arrays([site, pa.array(key.view(np.int64)), pa.array(n), pa.array(total["n"][group]), pa.array(heads[group])], schema=_FRAME)

    rows = tallies.tallied(counted, "body", lambda part: _page(part).things(), ("key", "site"), np.zeros(0, dtype=_TALLY), n_buckets, choose, _FRAME_DDL)
    totals = counted.groupBy("site_id").agg(F.count("*").alias("total"))
    enough = F.col("site_id").isNull() | (F.col("n") >= F.lit(SITE_SHARE) * F.col("total"))
    return materialise(materialise(rows).join(totals, "site_id", "left").where(enough).select("site_id", "key", "everywhere", "heads"))


def _frames(rows: DataFrame) -> Frames:
    got = rows.toArrow().combine_chunks()
    column = lambda k: got.column(k).to_numpy()
    site = got.column(0).combine_chunks().fill_null(0).to_numpy().view(np.uint64)
    alone = got.column(0).is_null().to_numpy()
    return Frames(codes.mix(column(1).view(np.uint64) ^ np.where(alone, _GLOBAL, site)), column(2), column(3))


def content(df: DataFrame, key: str = "page_id", text: str = "text", title: str = "title", source: str = "source", url: str = "url", sample: int = SAMPLE, most_frames: int = MOST_FRAMES) -> DataFrame:
    """(page_id, line_no) of the article lines; lines count from 0, blank ones included."""
    pages = df.select(F.col(key).cast("long").alias("key"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((title, "head"), (source, "site"), (text, "body")))).where("key is not null and body <> ''")
    chosen = distinct_pages(df, pages, key, url)
    pages = pages.select("key", "head", F.xxhash64("site").alias("site_id"), "body")
    frames = repeating(pages.dropDuplicates(["key"]).join(chosen, "key", "left_semi").select(*pages.columns))
    n_blocks = max(1, -(-frames.count() // most_frames))
    of = lambda rows, b: rows if n_blocks == 1 else rows.where(F.col("site_id").isNull() | (F.pmod("site_id", F.lit(n_blocks)) == b))
    picked = _picked(pages, sample)
    sites = picked.select("site_id").distinct()
    fitted = _fit(picked, _frames(frames.join(sites, "site_id", "left_semi").union(frames.where("site_id is null"))))
    schema = pa.schema([("page_id", pa.int64()), ("line_no", pa.int32())])
    out = None
    for b in range(n_blocks):
        table = df.sparkSession.sparkContext.broadcast(_frames(of(frames, b)))

        def emit(rows: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                for part in codes.slices(batch, "body"):
                    page = _page(part)
                    x = page.features(table.value)
                    inside = minimum_cut(odds_of(fitted, x), *page.edges(x[:, 0] > 0, WEAKER)) & (x[:, 0] == 0)
                    keys = part.column(0).to_numpy(zero_copy_only=False)[page.page[inside]]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(page.number[inside].astype(np.int32))], schema=schema)

        part = of(pages, b).mapInArrow(emit, "page_id long, line_no int")
        out = part if out is None else out.union(part)
    return out.distinct()


def _picked(pages: DataFrame, sample: int) -> DataFrame:
    """At most 2 * ``sample`` pages of up to SAMPLE_CHARS characters, those whose hashed key falls into 1 of m parts."""
    pages = pages.where(F.length("body") <= SAMPLE_CHARS)
    m = max(1, -(-pages.count() // sample))
    return materialise(pages.where(F.pmod(F.xxhash64("key"), F.lit(m)) == 0).limit(2 * sample))


def _fit(picked: DataFrame, frames: Frames) -> trees.Forest:
    """The classifier over the picked pages; their lines' features and first labels are made by the executors."""
    table = picked.sparkSession.sparkContext.broadcast(frames)
    schema = pa.schema([("x", pa.binary()), ("y", pa.binary())])

    def label(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in codes.slices(batch, "body"):
                page = _page(part)
                x = page.features(table.value)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]), pa.array([first_labels(x, page).tobytes()])], schema=schema)

    xs, ys = [np.zeros((0, len(FEATURES)))], [np.zeros(0, bool)]
    for r in picked.mapInArrow(label, "x binary, y binary").collect():
        xs.append(np.frombuffer(r["x"], np.float64).reshape(-1, len(FEATURES)))
        ys.append(np.frombuffer(r["y"], bool))
    return trees.fit(np.concatenate(xs), np.concatenate(ys).astype(np.float64), [0] * len(FEATURES), trees=50, depth=4, rate=0.4)


def cleaned(df: DataFrame, key: str = "page_id", text: str = "text", **how) -> DataFrame:
    """(key, text) with only the article lines of each page, in order; pages without an article have an empty text."""
    lines = content(df, key, text, **how).groupBy("page_id").agg(F.collect_set("line_no").alias("kept"))
    rows = df.select(F.col(key).cast("long").alias("page_id"), F.col(text).alias("body")).join(lines, "page_id", "left")
    body = F.array_join(F.filter(F.split("body", "\n", -1), lambda _, i: F.array_contains("kept", i)), "\n")
    return rows.select(F.col("page_id").alias(key), F.when(F.col("body").isNotNull(), F.coalesce(body, F.lit(""))).alias(text))
