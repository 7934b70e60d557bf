"""Fragments of the SQL twins that several of them share."""

from __future__ import annotations

from ..functions.text import DIGITS, EMOJI, PUNCTUATION, SPACE, URL

_WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + "              　"
_PLAIN = "".join(chr(0x21 + i) for i in range(94)) + " " * 15
_QUOTED = _PLAIN.replace("'", "''")


def nfkc(t: str) -> str:
    """NFKC for the compatibility characters that the tables hold: full-width forms and spaces."""
    return f"nfc_normalize(translate({t}, '{_WIDE}', '{_QUOTED}'))"


def strip(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, '^[{SPACE}]+', ''), '[{SPACE}]+$', '')"


def clean(t: str) -> str:
    out = nfkc(t)
    for pattern, to in ((URL, ""), (EMOJI, ""), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")):
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return strip(out)


def words(t: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({t}, ''), '[{SPACE}]+'), lambda w: w <> '')"


def count_of(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, '{pattern}'))"


def punctuation(t: str) -> str:
    quoted = PUNCTUATION.replace("'", "''")
    return f"(length({t}) - length(translate({t}, '{quoted}', '')))"


def uniform(key: str, seed: int) -> str:
    return f"((('0x' || substr(md5('{seed}:' || cast({key} as varchar)), 1, 8))::bigint % 1000000) / 1000000.0)"


def rank_hash(key: str, seed: int) -> str:
    return f"md5('{seed}:' || cast({key} as varchar))"


def chars(t: str) -> str:
    return f"list_filter(string_split(coalesce({t}, ''), ''), lambda x: x <> '')"


def normalise_answer(t: str) -> str:
    return strip(f"regexp_replace({strip(f'''regexp_replace({t}, '[{SPACE}]+', ' ', 'g')''')}, '[।.!?,: ]+$', '')")


def ascii_digits(t: str) -> str:
    return f"translate({t}, '{DIGITS[1]}', '{DIGITS[0]}')"


def token_ids(table: str, key: str, text: str, where: str = "true", lang: str = "lang", name: str = "i") -> str:
    """CTEs that end in (key, ids): a word's merges are those whose piece it has, applied in order of token_id."""
    n = name
    return rf"""{n}_t as (select {key}, case when {lang} in (select lang from vocab) then {lang} else 'hi' end as lang, {words(text)} as w from {table} where {where}),
{n}_w as (select distinct lang, unnest(w) as word from {n}_t),
{n}_m as (select w.lang, word, list('<' || left_piece || '><' || right_piece || '>' order by token_id) as m from {n}_w w join vocab v on v.lang = w.lang and left_piece is not null and contains('▁' || word, left_piece || right_piece) group by 1, 2),
{n}_c as (select w.lang, w.word, list_reduce(list_prepend('<▁>' || regexp_replace(replace(replace(w.word, '<', chr(1)), '>', chr(2)), '(.)', '<\1>', 'gs'), coalesce(m, [])), lambda acc, x: replace(acc, x, replace(x, '><', ''))) as c from {n}_w w left join {n}_m m on m.lang = w.lang and m.word = w.word),
{n}_p as (select lang, word, unnest(regexp_extract_all(c, '<([^>]*)>', 1)) as p, unnest(range(len(regexp_extract_all(c, '<([^>]*)>', 1)))) as pos from {n}_c),
{n}_d as (select p.lang, word, list(coalesce(token_id, 1) order by pos) as ids from {n}_p p left join vocab v on v.lang = p.lang and v.piece = replace(replace(p.p, chr(1), '<'), chr(2), '>') group by 1, 2),
{n}_u as (select {key}, lang, unnest(w) as word, unnest(range(len(w))) as nr from {n}_t),
{n}_f as (select {key}, flatten(list(ids order by nr)) as ids from {n}_u u join {n}_d d on d.lang = u.lang and d.word = u.word group by 1),
{n} as (select t.{key}, coalesce(f.ids, []) as ids from {n}_t t left join {n}_f f on f.{key} = t.{key})"""
