"""Column helpers for texts: Unicode white space, normalisation, counts, answers, formats."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Y

# White space as str.split and str.strip see it, as a regex class body for Java and RE2 alike.
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Emoji ranges that cleaning removes.
EMOJI = r"[\x{1f600}-\x{1f64f}\x{1f300}-\x{1f5ff}\x{1f680}-\x{1f6ff}\x{1f1e0}-\x{1f1ff}\x{2600}-\x{26ff}\x{2700}-\x{27bf}]+"
URL = rf"https?://[^{SPACE}]+|www\.[^{SPACE}]+"
SCRIPT = r"[\x{900}-\x{97f}]"
LETTERS = r"[a-zA-Z\x{900}-\x{97f}]"
DIGITS = ("0123456789", "०१२३४५६७८९")


_CLEAN = Y.StructType([Y.StructField("text", Y.StringType()), Y.StructField("n_words", Y.LongType()), Y.StructField("longest", Y.LongType())])


@F.arrow_udf(_CLEAN)
def cleaned(text: pa.Array) -> pa.Array:
    """The cleaned text, its number of words and the length of the longest one; all null for a null text.

    Cleaning: NFKC, without URLs and emoji, runs of blanks and of three or more newlines shortened, stripped.
    Spark has no built-in for NFKC (and Arrow's kernel doesn't compose), so the text goes through Python once;
    the rest is done in the same pass, and what follows reads the result as a column, not as an expression
    that would be repeated in every filter above it.
    """
    clean = [None if t is None else _clean(t) for t in text.to_pylist()]
    words = [None if t is None else t.split() for t in clean]
    return pa.StructArray.from_arrays(
        [pa.array(clean, pa.string()), pa.array([None if w is None else len(w) for w in words], pa.int64()), pa.array([None if w is None else max(map(len, w), default=0) for w in words], pa.int64())],
        names=["text", "n_words", "longest"],
    )


# the same text always gives the same result; marked otherwise, a filter on the result isn't moved below it,
# where it would need the text cleaned once more
cleaned = cleaned.asNondeterministic()


def clean_text(col: Column) -> Column:
    return cleaned(col)["text"]


def _python(pattern: str) -> str:
    """A pattern of this module as Python writes it."""
    return re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", pattern)


_URL, _EMOJI, _BLANKS, _LINES = (re.compile(_python(p)) for p in (URL, EMOJI, r"[ \t]+", r"\n{3,}"))


def _clean(t: str) -> str:
    t = unicodedata.normalize("NFKC", t)
    if "http" in t or "www." in t:
        t = _URL.sub("", t)
    return _LINES.sub("\n\n", _BLANKS.sub(" ", _EMOJI.sub("", t))).strip()


def strip(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col, rf"^[{SPACE}]+", ""), rf"[{SPACE}]+$", "")


def words(col: Column) -> Column:
    """Words between Unicode white space; none for an empty or null text."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), rf"[{SPACE}]+"), lambda w: w != "")


def runs(items: Column, n: int, gap: str = " ") -> Column:
    """All runs of n items, joined; items are walked once for each place in the run, not once for each run."""
    size = F.greatest(F.size(items) - (n - 1), F.lit(0))
    out = F.slice(items, F.lit(1), size)
    for k in range(2, n + 1):
        out = F.zip_with(out, F.slice(items, F.lit(k), size), lambda a, b: F.concat(a, F.lit(gap), b))
    return out


def count_of(col: Column, pattern: str) -> Column:
    """Characters of a class: what is missing when its runs are removed, as there are fewer runs than characters."""
    return (F.length(col) - F.length(F.regexp_replace(col, f"(?:{pattern})+", ""))).cast("long")


def word_count(col: Column) -> Column:
    """Number of words between Unicode white space, without splitting the text."""
    return F.coalesce(F.regexp_count(col, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def punctuation_count(col: Column) -> Column:
    return (F.length(col) - F.length(F.translate(col, PUNCTUATION, ""))).cast("long")


def to_script_digits(col: Column) -> Column:
    return F.translate(col, *DIGITS)


def to_ascii_digits(col: Column) -> Column:
    return F.translate(col, DIGITS[1], DIGITS[0])


def tidy(col: Column) -> Column:
    """One blank between words and none before closing punctuation."""
    return strip(F.regexp_replace(F.regexp_replace(col, rf"[{SPACE}]+", " "), r" ([।,?.])", "$1"))


def prompt_key(col: Column) -> Column:
    """A prompt without any white space, by which repeated prompts are found."""
    return F.regexp_replace(col, rf"[{SPACE}]+", "")


def normalise_answer(col: Column) -> Column:
    """White space collapsed and closing punctuation stripped."""
    return strip(F.regexp_replace(strip(F.regexp_replace(col, rf"[{SPACE}]+", " ")), r"[।.!?,: ]+$", ""))


def extract_answer(col: Column, label: Column) -> Column:
    """What follows the first answer label, up to a newline and then to a danda."""
    marker = F.concat(label, F.lit(":"))
    after = F.when(F.contains(col, marker), F.substring(col, F.instr(col, marker) + F.length(marker), F.length(col))).otherwise(col)
    return normalise_answer(F.substring_index(F.substring_index(strip(after), "\n", 1), "।", 1))


def strip_tags(col: Column) -> Column:
    """Markup removed, white space collapsed; entities are decoded by web.unescape."""
    return strip(F.regexp_replace(F.regexp_replace(col, r"<[^>]+>", " "), rf"[{SPACE}]+", " "))


def _scaled(n: Column, size: int) -> Column:
    """n by size with two places, halves rounded up, in whole numbers."""
    cents = F.floor((n * 100 + size // 2) / size)
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def format_bytes(n: Column) -> Column:
    """B, KB, MB or GB with two places."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for unit, size in (("KB", 10**3), ("MB", 10**6), ("GB", 10**9)):
        out = F.when(n >= size, F.concat(_scaled(n, size), F.lit(f" {unit}"))).otherwise(out)
    return out


def format_tokens(n: Column) -> Column:
    """Plain, or with K, M or B and two places."""
    out = n.cast("string")
    for unit, size in (("K", 10**3), ("M", 10**6), ("B", 10**9)):
        out = F.when(n >= size, F.concat(_scaled(n, size), F.lit(unit))).otherwise(out)
    return out
