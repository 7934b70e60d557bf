"""SQL twins of queries whose result SQL can state over whole tables: other logic than the operators', the same fixed lists."""

from __future__ import annotations

from ..functions.text import SPACE
from ..plans._sql import nfkc
from .lookalikes import LOOKALIKES, PAIRS

_INVISIBLE = r"[\x{ad}\x{200b}-\x{200f}\x{2060}-\x{2064}\x{feff}\x{34f}\x{fe00}-\x{fe0f}]"
#: The most words of a personal name.
_NAME_WORDS = 4
_DIGITS = ("०१२३४५६७८९", "0123456789")


def _grams(table: str, key: str, n: int) -> str:
    """Distinct runs of n words, words as stored."""
    run = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"select distinct {key}, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: {run})) as g from (select {key}, list_filter(regexp_split_to_array(text, '[ \\t\\n]+'), lambda x: x <> '') as w from {table} where text is not null)"


def _words(t: str, digits: bool) -> str:
    """Words between punctuation and other signs, folded."""
    folded = f"regexp_replace({nfkc(t)}, '{_INVISIBLE}', '', 'g')"
    if digits:
        folded = f"translate({folded}, '{_DIGITS[0]}', '{_DIGITS[1]}')"
    kept = r"\p{L}\p{M}\p{N}" if digits else r"\p{L}\p{M}"
    return f"list_filter(regexp_split_to_array({folded}, '[^{kept}]+'), lambda x: x <> '')"


def _similar(left: str, right: str, key: str, other: str, extra: str) -> str:
    return f"""ln as (select {key} as k, count(*) as n from {left} group by 1), rn as (select {other} as k, count(*) as n from {right} group by 1),
c as (select a.{key} as x, b.{other} as y, count(*) as c from {left} a join {right} b on a.g = b.g {extra} group by 1, 2),
s as (select x, y from c join ln on ln.k = x join rn on rn.k = y where c >= 0.5 * (ln.n + rn.n - c))"""


_FROM = "".join(x[0] for x in LOOKALIKES.split())
_TO = "".join(x[1] for x in LOOKALIKES.split())


def _form() -> str:
    out = f"nfc_normalize(regexp_replace({nfkc('text')}, '{_INVISIBLE}', '', 'g'))"
    out = f"nfc_normalize(translate({out}, '{_FROM}', '{_TO}'))"
    for _ in range(2):
        for a, b, c in PAIRS:
            out = f"replace({out}, '{a}{b}', '{c}')"
    return f"replace(replace({out}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


# Introductions of the test tables' prompts.
_INTROS = "बहीखाते में लिखा है कि|तालिका बताती है कि|नापने पर पता लगा कि|खातामा लेखिएको छ|तालिका भन्छ|नाप्दा थाहा भयो"
_LETTERS = "".join(x[0] for x in LOOKALIKES.split() if x[0].isalpha() and x[1].isalpha()), "".join(x[1] for x in LOOKALIKES.split() if x[0].isalpha() and x[1].isalpha())


def _prompt() -> str:
    text = f"translate(translate(regexp_replace({nfkc('prompt')}, '{_INVISIBLE}', '', 'g'), '{_DIGITS[0]}', '{_DIGITS[1]}'), '{_LETTERS[0]}', '{_LETTERS[1]}')"
    parts = rf"regexp_split_to_array(regexp_replace({text}, '\.(\s|$)', '।', 'g'), '[।|∣?!;]')"
    words = rf"trim(regexp_replace(regexp_replace(x, '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'), 'ः( |$)', ' ', 'g'))"
    return rf"list_filter(list_transform({parts}, lambda x: regexp_replace({words}, ' +', ' ', 'g')), lambda x: x <> '')"



def _tokens(table: str, key: str) -> str:
    """(key, n): tokens of each text. A word's merges are those whose piece it has; they are applied in order of token_id."""
    return rf"""t as (select {key} as key, case when lang in (select lang from vocab) then lang else 'hi' end as lang, list_filter(regexp_split_to_array(text, '[{SPACE}]+'), lambda x: x <> '') as w from {table}),
word as (select distinct lang, unnest(w) as word from t),
m as (select word.lang, word, list('<' || left_piece || '><' || right_piece || '>' order by token_id) as m from word join vocab v on v.lang = word.lang and left_piece is not null and contains('▁' || word, left_piece || right_piece) group by 1, 2),
c as (select word.lang, word.word, list_reduce(list_prepend('<▁>' || regexp_replace(replace(replace(word.word, '<', chr(1)), '>', chr(2)), '(.)', '<\1>', 'gs'), coalesce(m, [])), lambda acc, x: replace(acc, x, replace(x, '><', ''))) as pieces from word left join m on m.lang = word.lang and m.word = word.word),
n as (select lang, word, length(pieces) - length(replace(pieces, '<', '')) as n from c),
s as (select t.key, sum(n)::bigint as n from (select key, lang, unnest(w) as word from t) t join n on n.lang = t.lang and n.word = t.word group by 1)"""


def _dates() -> str:
    from .standing_lines import DATE_WORDS

    return "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(DATE_WORDS)) + "]"


#: Lines of documents (z) whose wording, with one stretch of two words or all names left open, stands often enough.
_STANDING = rf"""with l as (select doc_id, source, unnest(range(len(string_split(text, chr(10))))) as line_no, unnest(string_split(text, chr(10))) as line from documents where text is not null and source is not null),
w as (select doc_id, source, line_no, list_filter({_words('line', False)}, lambda x: not list_contains({_dates()}, x)) as w from l),
o as (select doc_id, source, line_no, regexp_extract_all(regexp_replace({nfkc('line')}, '{_INVISIBLE}', '', 'g'), '[\p{{L}}\p{{M}}]+|[^\p{{L}}\p{{M}}\x{{00}}-\x{{20}}\x{{a0}}]+') as o from l),
u as (select doc_id, source, line_no, unnest(o) as tok, unnest(range(len(o))) as pos from o),
v as (select *, regexp_matches(tok, '^[\p{{L}}\p{{M}}]') and not list_contains({_dates()}, tok) as is_word from u),
x as (select *, coalesce(lag(is_word) over (partition by doc_id, line_no order by pos), false) as joined, max(case when is_word then pos end) over (partition by doc_id, line_no) as last from v),
e as (select doc_id, line_no, max(case when pos > last and regexp_matches(tok, '[।॥?!|]') then 1 else 0 end) as sentence from x group by all),
t as (select source, count(distinct doc_id) as total from documents group by source),
c as (select source, tok, count(distinct doc_id) as n from v join t using (source) where is_word group by source, tok, total having n >= 4 and n >= 0.1 * total),
y as (select x.doc_id, x.source, x.line_no, x.tok, joined, coalesce(n, 0) as n, row_number() over (partition by x.doc_id, x.line_no order by pos) as i from x left join c on c.source = x.source and c.tok = x.tok where is_word),
b as (select distinct doc_id, line_no, n as b from y where n > 0),
p as (select y.*, b, n < b as open, coalesce(lag(n < b) over (partition by doc_id, line_no, b order by i), false) as before from y join b using (doc_id, line_no)),
q as (select *, sum(case when open and not (before and joined) then 1 else 0 end) over (partition by doc_id, line_no, b order by i) as name from p),
r as (select doc_id, line_no, b, count(*) as names, max(c) as longest, min(c) as shortest from (select doc_id, line_no, b, name, count(*) as c from q where open group by all) group by all),
h as (select q.doc_id, q.source, q.line_no, 's:' || string_agg(case when open then '*' else tok end, ' ' order by i) filter (not (open and before)) as k, string_agg(i || tok, ' ' order by i) filter (open) as fill
  from q join r using (doc_id, line_no, b) join e using (doc_id, line_no) where longest <= case when sentence = 1 then 2 else {_NAME_WORDS} end and (sentence = 0 or names > 1 and shortest = 2) group by q.doc_id, q.source, q.line_no, b),
k as (select doc_id, source, line_no, array_to_string(w, ' ') as k, '' as fill from w where len(w) > 0 union all
  select doc_id, source, line_no, len(w) || ':' || array_to_string(w[1 : i - 1], ' ') || ' * ' || array_to_string(w[i + 2 :], ' '), w[i] || ' ' || w[i + 1] from (select *, unnest(range(1, len(w))) as i from w where len(w) >= 3)
  union all select * from h),
f as (select source, k, fill, count(*) as n from k group by all),
g as (select source, k, count(*) as fills, max(n) as most, sum(n) as n, max(fill) as fill from f group by all),
d as (select source, k, count(distinct doc_id) as docs from k group by all),
ok as (select g.source, g.k from g join d on d.source = g.source and d.k = g.k join t on t.source = g.source where docs >= 4 and docs >= 0.1 * total and (fill = '' or fills >= 3 and most * 2 <= n)),
z as (select distinct doc_id, line_no from k join ok on ok.source = k.source and ok.k = k.k)"""
_ACROSS = f"""with t as ({_grams('train', 'rec_id', 3)}), h as ({_grams('holdout', 'rec_id', 3)}), {_similar('t', 'h', 'rec_id', 'rec_id', '')},
p as (select ex_id, split, {_prompt()} as p from reasoning where prompt is not null),
q as (select ex_id, split, p[len(p)] as ask, list_sort(list_transform(p[1 : len(p) - 1], lambda x: regexp_replace(x, '^({_INTROS}) ', ''))) as facts from p),
x as (select 'text' as field, x as train, y as held from s union all select 'prompt', a.ex_id, b.ex_id from q a join q b on a.ask = b.ask and a.facts = b.facts and a.split = 'train' and b.split in ('val', 'test'))"""
_REPEATED = f"""with w as (select doc_id, {_words("coalesce(text, '')", False)} as w from documents),
g as (select doc_id, unnest(range(1, len(w) - 4)) as i, unnest(list_transform(range(1, len(w) - 4), lambda i: list_slice(w, i, i + 5))) as g from w),
c as (select doc_id, i, count(*) over (partition by doc_id, g) as n from g),
k as (select doc_id, count(distinct p) as covered from (select doc_id, unnest(range(i, i + 6)) as p from c where n >= 3) group by doc_id),
m as (select w.doc_id, len(w.w)::bigint as n_words, coalesce(covered, 0)::bigint as covered from w left join k on w.doc_id = k.doc_id)"""

SQL = {
    "p1_found": f"{_STANDING} select distinct doc_id, line_no::int as line_no from z",
    "p1_cleaned": f"""{_STANDING}, gone as (select doc_id, list(distinct line_no) as gone from z group by 1)
select doc_id, case when gone is null then text else array_to_string(list_transform(list_filter(range(len(string_split(text, chr(10)))), lambda i: not list_contains(gone, i)), lambda i: string_split(text, chr(10))[i + 1]), chr(10)) end as text,
  coalesce(len(gone), 0)::int as n_removed from documents left join gone using (doc_id)""",
    "p2_found": f"with g as ({_grams('train', 'rec_id', 3)}), {_similar('g', 'g', 'rec_id', 'rec_id', 'and a.rec_id < b.rec_id')} select x as id_a, y as id_b from s",
    "p2_groups": f"""with recursive g as ({_grams('train', 'rec_id', 5)}), {_similar('g', 'g', 'rec_id', 'rec_id', 'and a.rec_id <> b.rec_id').replace('0.5', '0.8')},
r as (select distinct rec_id as x, rec_id as y from g union select r.x, s.y from r join s on s.x = r.y),
k as (select x, count(*) as k from s group by 1) select r.x as rec_id, min(r.y) as class_id, coalesce(any_value(k), 0)::bigint as n_links from r left join k on k.x = r.x group by 1""",
    "p3_classes": f"with f as (select rec_id, text, {_form()} as f from train where text is not null) select rec_id, min(rec_id) over w as class_id, count(*) over w as n_records, min(text) over w <> max(text) over w as mixed from f window w as (partition by f)",
    "p3_normalised": f"select rec_id, {_form()} as text from train",
    "p3_found": f"with f as (select rec_id, text, {_form()} as f from train where text is not null) select a.rec_id as id_a, b.rec_id as id_b from f a join f b on a.f = b.f and a.rec_id < b.rec_id and a.text <> b.text",
    "p4_found": f"""{_ACROSS} select field, least(train, held) as id_a, greatest(train, held) as id_b from x""",
    "p4_counts": f"""{_ACROSS}, a as (select 'text' as field, rec_id as held, split, source from holdout union all select 'prompt', ex_id, split, source from reasoning)
select field, split, source, count(*) as n_pairs, count(distinct held) as n_records from x join a using (field, held) group by all""",
    "p6_record_tokens": f"with {_tokens('train', 'rec_id')} select rec_id, source, lang, domain, coalesce(n, 0)::bigint as n_tokens from train left join s on key = rec_id",
    "p6_token_budget": f"with {_tokens('train', 'rec_id')} select source, lang, domain, count(*) as n_docs, coalesce(sum(n), 0)::bigint as n_tokens from train left join s on key = rec_id group by all",
    "p7_placed": f"with {_tokens('documents', 'doc_id')} select doc_id, coalesce(n, 0)::bigint as n_tokens, greatest(1, (coalesce(n, 0) + 511) // 512)::bigint as n_pieces, true as fits from documents left join s on key = doc_id",
    "p8_found": f"""with i as (select item_id, unnest(list_transform(range(1, len(w) - 8), lambda i: list_slice(w, i, i + 9))) as g from (select item_id, {_words('text', True)} as w from eval_items)),
d as (select doc_id, unnest(list_transform(range(1, len(w) - 8), lambda i: list_slice(w, i, i + 9))) as g from (select doc_id, {_words('text', True)} as w from documents where text is not null))
select distinct doc_id, item_id from d join i on d.g = i.g""",
    "p8_passages": f"""with recursive i as (select item_id, {_words('text', True)} as w, {_words("coalesce(answer, '')", True)} as a from eval_items where text is not null),
d as (select doc_id, {_words('text', True)} as w from documents where text is not null),
ig as (select item_id, unnest(list_transform(range(1, len(w) - 8), lambda i: list_slice(w, i, i + 9))) as g from i), dg as (select doc_id, unnest(list_transform(range(1, len(w) - 8), lambda i: list_slice(w, i, i + 9))) as g from d),
p as (select distinct doc_id, item_id from dg join ig on dg.g = ig.g),
q as (select doc_id, item_id, d.w as dw, i.w as iw, len(i.a) > 0 and list_has_all(d.w, i.a) as has_answer from p join d using (doc_id) join i using (item_id)),
r as (select doc_id, item_id, 0 as k, list_filter(dw, lambda x: list_contains(iw, x)) as dw, iw, list_transform(range(len(iw) + 1), lambda x: 0) as t from q union all
  select doc_id, item_id, k + 1, dw, iw, list_transform(range(1, len(iw) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda h: case when h > 1 and iw[h - 1] = dw[k + 1] then t[h - 1] + 1 else t[h] end))) from r where k < len(dw)),
lcs as (select doc_id, item_id, list_max(t) as common_words from r where k = len(dw)),
e as (select doc_id, item_id, x - y as diagonal, x from (select doc_id, item_id, iw, unnest(dw) as word, unnest(range(len(dw))) as x from q) join (select item_id as item, unnest(w) as other, unnest(range(len(w))) as y from i) on item = item_id and word = other),
g as (select doc_id, item_id, x - row_number() over (partition by doc_id, item_id, diagonal order by x) as run, diagonal from e),
n as (select doc_id, item_id, max(c) as run_words from (select doc_id, item_id, diagonal, run, count(*) as c from g group by all) group by all)
select doc_id, item_id, run_words::int as run_words, common_words::int as common_words, has_answer from q join lcs using (doc_id, item_id) join n using (doc_id, item_id)""",
    "p9_found": f"{_REPEATED} select doc_id from m where covered >= 0.35 * n_words and n_words > 0",
    "p9_shares": f"{_REPEATED} select doc_id, n_words, covered as repeated, round(case when n_words = 0 then 0 else covered / n_words end, 6)::double as share from m",
}
