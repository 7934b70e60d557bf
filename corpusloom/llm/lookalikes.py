"""Problem 3: visually identical text with different characters.

Texts become arrays of positioned code points.  Each code point is looked up in one mapping table (its
canonical or width decomposition, then its look-alike), marks after a letter are put in the order of
their combining class, characters without a shape are dropped, and the strings are rebuilt and composed.
The tables have a fixed size and are made by each worker; a text without any mapped character is passed on
as it is.

Kept apart: superscripts, subscripts, circled signs and fractions, which look different from their digits;
letters of different case; digits of different scripts; newlines and spaces.  A null text stays null, and an
empty one empty.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codes
from ._spark import signed

# Letters of other scripts and signs that have the shape of the second one.
LOOKALIKES = (
    "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЈJ ЅS аa еe оo рp сc уy хx іi јj ѕs һh ԁd ԛq ԝw ѵv ӏl "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv ρp αa ιi γy υu "
    "ϲc ϳj ϜF ͿJ "
    "օo սu հh ցg ոn զq յj ՕO ՍU "
    "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᎡR ᏚS ᎢT ᏙV ᎳW ᎩY ᏃZ "
    "ԌG ԚQ ԜW ѴV ԝw "
    "ɑa ɡg ıi ɩi ∣। |। :ः ː: ‐- ‑- ‒- −- ﹣- ꞉ः"
)
# Two signs that together have the shape of a third one.
PAIRS = (("अ", "ा", "आ"), ("ए", "े", "ऐ"), ("आ", "े", "ओ"), ("आ", "ै", "औ"), ("अ", "ो", "ओ"), ("अ", "ौ", "औ"), ("अ", "ॉ", "ऑ"), ("आ", "ॅ", "ऑ"), ("ा", "े", "ो"), ("ा", "ै", "ौ"), ("ा", "ॅ", "ॉ"))
_KEPT = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>")
_LAST = 0x30000


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """changed (code points that are mapped), length, first place in the sequences, sequences, combining class."""
    alike = {x[0]: x[1] for x in LOOKALIKES.split()}
    alike["ः"] = "ः"
    changed = np.zeros(0x110000, dtype=bool)
    length = np.ones(0x110000, dtype=np.int64)
    place = np.zeros(0x110000, dtype=np.int64)
    combining = np.zeros(0x110000, dtype=np.uint8)
    sequences: list[int] = [0]
    drop = codes.char_class() == codes.DROP
    for c in range(_LAST):
        ch = chr(c)
        combining[c] = unicodedata.combining(ch)
        kind = unicodedata.decomposition(ch)
        if not kind and ch not in alike and not drop[c] and unicodedata.category(ch) != "Zs":
            continue
        if drop[c]:
            out = ""
        elif unicodedata.category(ch) == "Zs":
            out = " "
        else:
            out = ch if kind.startswith(_KEPT) else unicodedata.normalize("NFKD", ch)
            out = "".join(alike.get(x, x) for x in out)
        if out != ch:
            changed[c], length[c], place[c] = True, len(out), len(sequences)
            sequences.extend(map(ord, out))
    drop[:_LAST] = False
    changed |= drop
    length[drop] = 0
    return changed, length, place, np.array(sequences, dtype=np.uint32), combining


@lru_cache(maxsize=1)
def _suspects() -> np.ndarray:
    """Code points by which a text is not surely in the consistent form already."""
    flag = _tables()[0] | (_tables()[4] > 0)
    flag[[0x93C, 0x94D]] = False
    flag[0x1100:0x1200] = True
    return flag


def consistent(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The decomposed consistent form of each text as code points and offsets."""
    jamo = (cps >= 0x1100) & (cps < 0x1200)
    if jamo.any():
        texts = [cps[a:b].tobytes().decode("utf-32-le") for a, b in zip(off[:-1], off[1:])]
        cps, off = codes.from_strings([unicodedata.normalize("NFC", t) for t in texts])
    changed, length, place, sequences, combining = _tables()
    # carriage returns belong to the coding of a newline
    cr = cps == 0x0D
    if cr.any():
        follows = np.concatenate([cps[1:] == 0x0A, [False]])
        cps = np.where(cr & ~follows, np.uint32(0x0A), cps)
        cps, off = codes.select(cps, off, ~(cr & follows))
    hit = changed[cps]
    if hit.any():
        n = np.where(hit, length[cps], 1)
        start = np.cumsum(n) - n
        src = np.repeat(np.arange(len(cps)), n)
        within = np.arange(len(src)) - start[src]
        mapped = hit[src]
        out = cps[src]
        out[mapped] = sequences[place[cps[src[mapped]]] + within[mapped]]
        upto = np.concatenate([[0], np.cumsum(n)])
        cps, off = out, upto[off]
    ccc = combining[cps]
    marks = ccc > 0
    if (marks[1:] & marks[:-1]).any():
        base = np.cumsum(~marks)
        doc = np.searchsorted(off, np.arange(len(cps)), side="right")
        cps = cps[np.lexsort((np.arange(len(cps)), ccc, base, doc))]
    for _ in range(2):
        for a, b, c in PAIRS:
            both = (cps[:-1] == ord(a)) & (cps[1:] == ord(b)) if len(cps) else np.zeros(0, bool)
            at = np.flatnonzero(both)
            if len(at):
                edge = np.isin(at + 1, off)
                at = at[~edge]
                cps = cps.copy()
                cps[at] = ord(c)
                keep = np.ones(len(cps), dtype=bool)
                keep[at + 1] = False
                cps, off = codes.select(cps, off, keep)
    return cps, off


def _hashes(cps: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each text."""
    n = len(off) - 1
    out = np.zeros((n, 2), dtype=np.uint64)
    size = np.diff(off).astype(np.uint64)
    full = np.flatnonzero(size > 0)
    power, inverse = codes._powers(len(cps) + 1)
    for k in range(2):
        value = codes._code_hash()[cps + np.uint32(k)] * power[: len(cps)]
        if len(full):
            out[full, k] = codes.mix(np.add.reduceat(value, off[:-1][full]) * inverse[off[:-1][full]] + size[full])
    return out


def normalised(df: DataFrame, key: str = "rec_id", text: str = "text") -> DataFrame:
    """(key, text) with each text in its consistent form, composed."""
    schema = pa.schema([(key, pa.int64()), (text, pa.string())])

    def rewrite(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in codes.slices(batch, text):
                cps, off = codes.codepoints(part.column(1))
                texts = part.column(1).to_pylist()
                where = np.flatnonzero(_suspects()[cps] | (cps == 0x0D) | _paired(cps))
                docs = codes._docs_of(where, off) if len(where) else []
                if len(docs):
                    c, o = consistent(*codes.from_strings([texts[d] for d in docs]))
                    for i, d in enumerate(docs):
                        texts[d] = unicodedata.normalize("NFC", c[o[i] : o[i + 1]].tobytes().decode("utf-32-le"))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(texts, pa.string())], schema=schema)

    return df.select(F.col(key).cast("long").alias(key), text).mapInArrow(rewrite, f"{key} long, {text} string")


def _paired(cps: np.ndarray) -> np.ndarray:
    """True at the first sign of a pair that has the shape of one."""
    out = np.zeros(len(cps), dtype=bool)
    for a, b, _ in PAIRS:
        out[:-1] |= (cps[:-1] == ord(a)) & (cps[1:] == ord(b))
    return out


def fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, form, more, raw): 128 bits of the consistent form and 64 of the text as stored; null texts left out."""
    schema = pa.schema([("key", pa.int64()), ("form", pa.int64()), ("more", pa.int64()), ("raw", pa.int64())])

    def emit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in codes.slices(batch, "body"):
                cps, off = codes.codepoints(part.column(1))
                raw = _hashes(cps, off)[:, 0]
                form = _hashes(*consistent(cps, off))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(signed(np.ascontiguousarray(x))) for x in (form[:, 0], form[:, 1], raw))], schema=schema)

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("body")).where("key is not null and body is not null")
    return rows.mapInArrow(emit, "key long, form long, more long, raw long")


def twins(df: DataFrame, key: str = "rec_id", text: str = "text") -> DataFrame:
    """(id_a, id_b), the smaller first: records of one consistent form whose texts differ as stored.

    Only forms stored in more than one way are joined; a form with one stored text, however often, is not.
    Repeated rows of one key count once for each stored text.
    """
    prints = fingerprints(df, key, text)
    mixed = prints.groupBy("form", "more").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("form", "more")
    own = prints.join(mixed, ["form", "more"])
    x = own.select("form", "more", F.col("raw").alias("ra"), F.col("key").alias("ka"))
    y = own.select("form", "more", F.col("raw").alias("rb"), F.col("key").alias("kb"))
    return x.join(y, ["form", "more"]).where("ka < kb and ra <> rb").select(F.col("ka").alias("id_a"), F.col("kb").alias("id_b")).distinct()


def classes(df: DataFrame, key: str = "rec_id", text: str = "text") -> DataFrame:
    """(key, class_id, n_records, mixed): each record with a text, the smallest key of its consistent form, how many records have it, and whether they are stored in more than one way.

    No pair is made; a form that many records have is summed in every task before it is exchanged.
    """
    prints = fingerprints(df, key, text).distinct()
    by = prints.groupBy("form", "more").agg(F.min("key").alias("class_id"), F.count("*").alias("n_records"), (F.min("raw") != F.max("raw")).alias("mixed"))
    return prints.join(by, ["form", "more"]).select(F.col("key").alias(key), "class_id", "n_records", "mixed")
