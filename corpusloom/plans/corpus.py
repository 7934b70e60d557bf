"""Queries over documents: cleaning, deduplication, splits, ingest, crawled pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cleaning, dedup, ingest, splits, web
from ..session import table
from . import _sql as S

BUDGET = 400_000
_LABELLED = f"""
with c as (select doc_id, strlen(text) as n_bytes, {S.clean('text')} as clean from documents),
w as (select *, {S.words('clean')} as words from c),
labelled as (select *, case when clean is null then 'malformed'
  when length(clean) < 100 or len(words) < 10 then 'short'
  when len(list_filter(words, lambda x: length(x) > 30)) > 0 then 'word_length'
  when {S.punctuation('clean')} / length(clean) > 0.20 then 'noise'
  when {S.count_of('clean', T.LETTERS)} = 0 or {S.count_of('clean', T.SCRIPT)} / {S.count_of('clean', T.LETTERS)} < 0.95 then 'ratio' end as reason from w)
"""
_SHINGLES = f"""
with w as (select doc_id, {S.words('text')} as w from documents where text is not null),
s as (select doc_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as s from w where len(w) >= 3),
h as (select doc_id, list_transform(s, lambda x: ('0x' || substr(md5(x), 1, 8))::bigint % {dedup.PRIME}) as h from s),
sig as (select doc_id, list_transform(range(1, {dedup.PERMUTATIONS + 1}), lambda i: list_min(list_transform(h, lambda x: (x * (i * 48271 % {dedup.PRIME}) + (i * 69621 % {dedup.PRIME})) % {dedup.PRIME}))) as sig from h),
bands as (select doc_id, unnest(list_transform(range({dedup.BANDS}), lambda b: b || ':' || array_to_string(sig[b * {dedup.ROWS} + 1 : (b + 1) * {dedup.ROWS}], ','))) as k from sig)
"""


def docs(spark, d):
    return table(spark, d, "documents")


def exact_first(spark, d):
    return dedup.first_copies(docs(spark, d).where("text is not null").select("doc_id", "text"), F.md5("text"), ["doc_id"]).select("doc_id")


def budget_cut(spark, d):
    rows = ingest.within_budget(docs(spark, d).where("text is not null").select("doc_id", "source", "text"), table(spark, d, "source_manifest"), "source", "doc_id", ingest.estimated_tokens(F.col("text")), BUDGET)
    return rows.select("doc_id", F.col("rank").cast("int").alias("rank"))


def bucket_shuffle(spark, d):
    return splits.shuffled(docs(spark, d).select("doc_id"), "doc_id").select("doc_id", "bucket")


def urls(spark, d):
    p = table(spark, d, "crawl_pages").where("url is not null")
    u = web.normalised_url(F.col("url"))
    return p.select("page_id", u.alias("url"), web.host(F.col("url")).alias("host"), web.is_article_link(u, web.host(F.col("source"))).alias("is_article"))


def unseen_urls(spark, d):
    """URLs of crawled pages that no document comes from."""
    urls = lambda t: table(spark, d, t).where("url is not null").select(web.normalised_url(F.col("url")).alias("url"))
    return web.unseen(urls("crawl_pages"), urls("documents"))


def site_summary(spark, d):
    p = table(spark, d, "crawl_pages")
    return p.groupBy("source").agg(F.count("*").alias("n_pages"), F.count_distinct(web.normalised_url(F.col("url"))).alias("n_urls"), F.sum(F.when(F.length("text") > 80, 1).otherwise(0)).cast("long").alias("n_long"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("n_bytes"))


def stripped(spark, d):
    return table(spark, d, "train").select("rec_id", F.md5(T.strip_tags(F.col("text"))).alias("plain"))


def page_texts(spark, d):
    """The main text of pages that wrap each stored text in a menu, an article and a footer."""
    plain = F.translate(F.coalesce("text", F.lit("")), "<>&", "")
    page = F.concat(F.lit("<html><head><title>t</title></head><body><nav>" + "menu " * 20 + "</nav><article><p>"), plain, F.lit("</p></article><footer>" + "foot " * 20 + "</footer></body></html>"))
    return table(spark, d, "crawl_pages").select("page_id", F.md5(web.main_text(page)).alias("main"))


def newest_states(spark, d):
    """The stored state of the greatest step of each source, two spellings of the step mixed."""
    log = table(spark, d, "download_log").where("raw_records_seen is not null")
    path = F.concat("name", F.when(F.col("run_no") % 2 == 0, "/step_").otherwise("/checkpoint-"), F.col("raw_records_seen").cast("string"))
    return ingest.newest_file(log.select("name", path.alias("path")), ["name"]).select("name", "step")


def limit_messages(spark, d):
    """Scope and wait of refusals made of the log's numbers."""
    n = F.coalesce("n_bytes", F.lit(0))
    said = F.concat(F.lit("Rate limit reached, requests "), F.when(n % 3 == 0, "per day").when(n % 3 == 1, "per minute").otherwise("in all"), F.lit(". Please try again in "), (n % 4).cast("string"), F.lit("m"), (n % 50).cast("string"), F.lit(".5s."))
    rows = table(spark, d, "download_log").select(n.alias("n"), said.alias("said")).distinct()
    return rows.select("n", ingest.limit_scope(F.col("said")).alias("scope"), ingest.wait_seconds(F.col("said")).alias("wait"))


#: Sources that a run is told to leave out.
SKIPPED = ["mizebi_verified_hin", "https://www.mugure.example"]

QUERIES = {
    "cleaning_funnel": lambda s, d: cleaning.funnel(docs(s, d)),
    "cleaned_documents": lambda s, d: cleaning.cleaned(docs(s, d)).select("doc_id", F.md5("text").alias("text_md5"), "n_words"),
    "cleaning_reduction": lambda s, d: cleaning.reduction(docs(s, d)),
    "word_stats_by_lang": lambda s, d: cleaning.text_stats(docs(s, d), "lang"),
    "token_estimate_by_source": lambda s, d: ingest.totals(docs(s, d), "source", "text", 10_000_000),
    "source_order": lambda s, d: ingest.ordered_sources(table(s, d, "source_manifest")),
    "source_budget_cut": budget_cut,
    "shingle_counts": lambda s, d: docs(s, d).where("text is not null").select("doc_id", F.size(dedup.shingles(T.words(F.col("text")))).cast("long").alias("n_shingles")),
    "minhash_signatures": lambda s, d: dedup.signatures(docs(s, d)).select("doc_id", F.md5(F.array_join("signature", ",")).alias("signature_md5")),
    "lsh_candidate_pairs": lambda s, d: dedup.candidate_pairs(dedup.signatures(docs(s, d))),
    "near_dedup_greedy": lambda s, d: dedup.greedy_keep(dedup.signatures(docs(s, d))),
    "exact_dedup_first": exact_first,
    "split_assign": lambda s, d: splits.assign(docs(s, d).select("doc_id"), "doc_id"),
    "split_stats": lambda s, d: splits.stats(splits.assign(docs(s, d), "doc_id")),
    "bucket_shuffle": bucket_shuffle,
    "sample_documents": lambda s, d: splits.sample(docs(s, d).select("doc_id"), "doc_id", 50, 7),
    "url_normalise": urls,
    "unseen_urls": unseen_urls,
    "site_summary": site_summary,
    "strip_tags": stripped,
    "source_profile": lambda s, d: table(s, d, "train").agg(F.count("*").alias("n_rows"), F.sum(ingest.estimated_tokens(F.col("text"))).alias("tokens"), F.sum(F.octet_length("text")).cast("long").alias("n_bytes")),
    "latest_progress": lambda s, d: ingest.latest_records(table(s, d, "download_log")).select("name", "run_no", "status", "raw_records_seen", "tokens"),
    "page_texts": page_texts, "newest_states": newest_states, "limit_messages": limit_messages,
    "sources_kept": lambda s, d: ingest.without_skipped(table(s, d, "source_manifest"), SKIPPED).select("name"),
    "records_after": lambda s, d: ingest.after_records(docs(s, d).select("doc_id"), ["doc_id"], 100),
    "usable_files": lambda s, d: ingest.complete_files(table(s, d, "download_log").select("name", "n_bytes", "status"), docs(s, d).groupBy(F.col("source").alias("name")).agg(F.sum(F.octet_length("text")).cast("long").alias("n_bytes")), done="done").select("name", "usable"),
    "resume_points": lambda s, d: ingest.resume_points(table(s, d, "download_log"), table(s, d, "source_manifest")),
    "corpus_rollup": lambda s, d: docs(s, d).rollup("lang", "domain").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("n_chars"), F.grouping_id().alias("level")),
    "short_documents": lambda s, d: docs(s, d).where(F.length(T.strip(F.col("text"))) >= 10).groupBy("source").agg(F.count("*").alias("n_docs")),
    "human_sizes": lambda s, d: docs(s, d).groupBy("domain").agg(F.sum(F.octet_length("text")).alias("b")).select("domain", T.format_bytes(F.col("b")).alias("size"), T.format_tokens(F.floor(F.col("b") / 10)).alias("tokens")),
}



def _human(n: str, *units: str) -> str:
    cents = lambda size: f"(({n} * 100 + {size // 2}) // {size})"
    cases = " ".join(f"when {n} >= {s} then ({cents(s)} // 100) || '.' || lpad(({cents(s)} % 100)::varchar, 2, '0') || '{u}'" for s, u in zip((10**9, 10**6, 10**3), units[:0:-1]))
    return f"case {cases} else {n} || '{units[0]}' end"


_LATEST = "select name, run_no, arg_max({status: status, seen: raw_records_seen, tokens: tokens}, {logged: logged_at, seen: coalesce(raw_records_seen, -1)}) as r from download_log group by all"
SQL = {
    "cleaning_funnel": _LABELLED + "select coalesce(reason, 'kept') as outcome, count(*) as n_docs, sum(coalesce(n_bytes, 0))::bigint as n_bytes from labelled group by 1",
    "cleaned_documents": _LABELLED + "select doc_id, md5(clean) as text_md5, len(words)::bigint as n_words from labelled where reason is null",
    "cleaning_reduction": _LABELLED + "select count(*) as docs_read, count(*) filter (reason is null) as docs_kept, round(sum(coalesce(n_bytes, 0)) / 1048576, 4) as mb_read, round(100 * (1 - count(*) filter (reason is null) / count(*)), 4) as percent_lost from labelled",
    "word_stats_by_lang": f"select lang, count(*) as n_docs, sum(len({S.words('text')}))::bigint as n_words, coalesce(sum(length(text)), 0)::bigint as n_chars, coalesce(sum(strlen(text)), 0)::bigint as n_bytes from documents group by lang",
    "token_estimate_by_source": "with t as (select source, count(*) as n_rows, sum(case when text is null then 0 else greatest(1, strlen(text) // 10) end)::bigint as tokens, coalesce(sum(strlen(text)), 0)::bigint as n_bytes from documents group by source) select *, greatest(0, 10000000 - sum(tokens) over ())::bigint as missing, sum(tokens) over () >= 10000000 as reached from t",
    "source_order": "select name, row_number() over (order by coalesce(priority, 99), name)::int as rank from source_manifest",
    "source_budget_cut": f"with r as (select name, row_number() over (order by coalesce(priority, 99), name)::int as rank from source_manifest), t as (select doc_id, rank, coalesce(sum(greatest(1, strlen(text) // 10)) over (order by rank, doc_id rows between unbounded preceding and 1 preceding), 0) as before from documents join r on source = name where text is not null) select doc_id, rank from t where before < {BUDGET}",
    "shingle_counts": f"with w as (select doc_id, {S.words('text')} as w from documents where text is not null) select doc_id, case when len(w) < 3 then 0 else len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) end::bigint as n_shingles from w",
    "minhash_signatures": _SHINGLES + "select doc_id, md5(array_to_string(sig, ',')) as signature_md5 from sig",
    "lsh_candidate_pairs": _SHINGLES + "select distinct a.doc_id as id_a, b.doc_id as id_b from bands a join bands b on a.k = b.k and a.doc_id < b.doc_id",
    "near_dedup_greedy": _SHINGLES + ", e as (select doc_id, list(k) as keys from bands group by doc_id), r as (select list_reduce(list({ids: [doc_id], keys: keys} order by doc_id), lambda acc, x: case when list_has_any(acc.keys, x.keys) then acc else {ids: list_concat(acc.ids, x.ids), keys: list_concat(acc.keys, x.keys)} end) as r from e) select unnest(r.ids) as doc_id from r",
    "exact_dedup_first": "select min(doc_id) as doc_id from documents where text is not null group by text",
    "split_assign": f"select doc_id, case when {S.uniform('doc_id', 42)} < 0.95 then 'train' when {S.uniform('doc_id', 42)} < 0.975 then 'val' else 'test' end as split from documents",
    "split_stats": f"with s as (select case when {S.uniform('doc_id', 42)} < 0.95 then 'train' when {S.uniform('doc_id', 42)} < 0.975 then 'val' else 'test' end as split, text from documents) select coalesce(split, 'total') as split, count(*) as n_docs, coalesce(sum(strlen(text)), 0)::bigint as n_bytes from s group by rollup (split)",
    "bucket_shuffle": f"select doc_id, floor({S.uniform('doc_id', 43)} * 32)::int as bucket from documents",
    "sample_documents": f"select doc_id from documents order by {S.rank_hash('doc_id', 7)} limit 50",
    "url_normalise": r"""
with u as (select page_id, regexp_replace(regexp_replace(url, '[#?].*$', ''), '/+$', '') as u, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1) as host, regexp_extract(source, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1) as own from crawl_pages where url is not null),
p as (select *, lower(regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)', 1)) as path from u)
select page_id, u as url, host, regexp_matches(u, '^https?://') and regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1) = own and not regexp_matches(path, '(ENDINGS)$') and not regexp_matches(path, 'PARTS') as is_article from p
""".replace("ENDINGS", "|".join(e.replace(".", r"\.") for e in web.SKIPPED_ENDINGS)).replace("PARTS", "|".join(web.SKIPPED_PARTS)),
    "unseen_urls": "with n as (select regexp_replace(regexp_replace(url, '[#?].*$', ''), '/+$', '') as url from crawl_pages where url is not null), o as (select regexp_replace(regexp_replace(url, '[#?].*$', ''), '/+$', '') as url from documents where url is not null) select distinct url from n where url not in (select url from o)",
    "site_summary": "select source, count(*) as n_pages, count(distinct regexp_replace(regexp_replace(url, '[#?].*$', ''), '/+$', '')) as n_urls, coalesce(sum(case when length(text) > 80 then 1 else 0 end), 0)::bigint as n_long, coalesce(sum(strlen(text)), 0)::bigint as n_bytes from crawl_pages group by source",
    "strip_tags": f"select rec_id, md5({S.strip(f'''regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[{T.SPACE}]+', ' ', 'g')''')}) as plain from train",
    "source_profile": "select count(*) as n_rows, sum(case when text is null then 0 else greatest(1, strlen(text) // 10) end)::bigint as tokens, sum(strlen(text))::bigint as n_bytes from train",
    "latest_progress": f"select name, run_no, r.status as status, r.seen as raw_records_seen, r.tokens as tokens from ({_LATEST})",
    "page_texts": f"with l as (select page_id, list_filter(list_transform(regexp_split_to_array(translate(coalesce(text, ''), '<>&', ''), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: {S.strip('x')}), lambda x: length(x) > 25) as l from crawl_pages) select page_id, md5(array_to_string(l, chr(10))) as main from l",
    "newest_states": "select name, max(raw_records_seen) as step from download_log where raw_records_seen is not null group by 1",
    "limit_messages": "select distinct coalesce(n_bytes, 0) as n, case coalesce(n_bytes, 0) % 3 when 0 then 'day' when 1 then 'minute' else 'unknown' end as scope, ((coalesce(n_bytes, 0) % 4) * 60 + coalesce(n_bytes, 0) % 50 + 0.5)::double as wait from download_log",
    "sources_kept": "select name from source_manifest where name not in (" + ", ".join(f"'{x}'" for x in SKIPPED) + ")",
    "records_after": "select doc_id from documents order by doc_id offset 100",
    "usable_files": "with h as (select source as name, sum(strlen(text))::bigint as b from documents group by 1) select name, bool_or(coalesce(status = 'done' and n_bytes = b, false)) as usable from download_log left join h using (name) group by 1",
    "resume_points": f"with l as ({_LATEST}), n as (select name, arg_max(r, run_no) as r from l group by name) select m.name, coalesce(r.status, 'not_started') as status, coalesce(r.seen, 0)::bigint as raw_records_seen, coalesce(r.tokens, 0)::bigint as tokens from source_manifest m left join n on m.name = n.name",
    "corpus_rollup": "select lang, domain, count(*) as n_docs, coalesce(sum(length(text)), 0)::bigint as n_chars, grouping(lang, domain)::bigint as level from documents group by rollup (lang, domain)",
    "short_documents": f"select source, count(*) as n_docs from documents where length({S.strip('text')}) >= 10 group by source",
    "human_sizes": f"with b as (select domain, sum(strlen(text))::bigint as b, sum(strlen(text))::bigint // 10 as t from documents group by domain) select domain, {_human('b', ' B', ' KB', ' MB', ' GB')} as size, {_human('t', '', 'K', 'M', 'B')} as tokens from b",
}
