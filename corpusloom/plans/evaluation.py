"""Queries over token sequences, predictions, reasoning examples, attention and logits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import attention, bank, metrics, reasoning, reports, sampling, sequences, splits, vocabulary
from ..operators import examples as examples_
from ..session import materialise, spread_small, table
from . import _sql as S


def ids_of(s, d, text: str, lang: str = "lang"):
    return vocabulary.token_ids(vocabulary.encoders(table(s, d, "vocab")), F.col(text), F.col(lang))


def documents_ids(s, d):
    """(doc_id, ids, b): tokens and bytes of every document with a text, in one scan."""
    docs = spread_small(table(s, d, "documents").where("text is not null"))
    return docs.select("doc_id", ids_of(s, d, "text").alias("ids"), F.octet_length("text").alias("b"))


def pack_blocks(s, d):
    rows = sequences.pack(documents_ids(s, d), "doc_id", "ids", 512)
    return rows.select("block_no", F.md5(F.array_join("input_ids", ",")).alias("inputs"), F.md5(F.array_join("targets", ",")).alias("targets"))


def eval_chunks(s, d):
    rows = sequences.chunks(documents_ids(s, d), "doc_id", "ids", "b")
    return rows.select("doc_id", F.col("chunk_no").cast("int").alias("chunk_no"), F.md5(F.array_join("input_ids", ",")).alias("inputs"), F.md5(F.array_join("targets", ",")).alias("targets"), F.col("num_tokens").cast("int").alias("num_tokens"), "num_bytes")


def sft_mask(s, d):
    both = spread_small(table(s, d, "reasoning")).select("ex_id", ids_of(s, d, "prompt_text").alias("p"), ids_of(s, d, "target").alias("a"))
    rows = sequences.masked(both, "ex_id", "p", "a", 256)
    return rows.select("ex_id", F.md5(F.array_join("input_ids", ",")).alias("inputs"), F.md5(F.array_join("labels", ",")).alias("labels"))


def fertility(s, d):
    rows = spread_small(table(s, d, "train").where("text is not null")).select("lang", "text", ids_of(s, d, "text").alias("ids"))
    sized = rows.select("lang", "text", F.size("ids").alias("n"), vocabulary.unknown_count(F.col("ids")).alias("u"))
    return metrics.fertility(sized, ["lang"], "n", T.word_count(F.col("text")), F.length("text"), F.col("u"))


def unknown_characters(s, d):
    return vocabulary.first_unknown(table(s, d, "train"), table(s, d, "vocab"), "rec_id")


def lengths(s, d):
    return table(s, d, "reasoning").where("n_tokens is not null").select("ex_id", F.col("n_tokens").cast("int").alias("n_tokens"))


def once(s, d):
    """Predictions without repeated deliveries."""
    return table(s, d, "predictions").distinct()


def scored_pairs(s, d):
    p = once(s, d).where("predicted is not null")
    return p.select(F.concat_ws("/", "run_id", "id").alias("pair"), T.words(F.col("gold")).alias("ref"), T.words(F.col("predicted")).alias("hyp"), "gold", "predicted", "generated")


def answers(s, d):
    p = once(s, d).join(table(s, d, "reasoning").select("id", "answer_label"), "id")
    got = T.extract_answer(F.col("generated"), F.col("answer_label"))
    rows = p.where("generated is not null").select("run_id", "id", got.alias("extracted"), T.normalise_answer(F.col("gold")).alias("gold"))
    return rows.select("run_id", "id", "extracted", reports.lenient_match(F.col("extracted"), F.col("gold")).alias("lenient"), (F.col("extracted") == F.col("gold")).alias("strict"))


def error_classes(s, d):
    p = once(s, d).where("not correct and predicted is not null and generated is not null")
    return p.select("run_id", "id", reports.error_class(F.col("format_ok"), F.col("predicted"), F.col("prompt"), F.col("task"), F.col("generated")).alias("class"))


def arms(s, d):
    return reports.compare_runs(once(s, d), "run_id", "run_00", "task")


def losses(s, d, at: str = "day"):
    """Stand-in losses from the events: value as nats of 10 tokens and 40 bytes, one batch for each hour."""
    e = table(s, d, "events").where("value is not null")
    return e.select("event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("sec"), "user_id", "event_id", "value", F.lit(10).alias("tokens"), F.lit(40).alias("bytes"))


def forgetting(s, d):
    rows = losses(s, d)
    after = rows.withColumn("value", F.col("value") + 0.5)
    return metrics.forgetting(*(metrics.loss(r, ["event_type"], "value", "tokens", "bytes") for r in (rows, after)), "event_type")


def loss_curve(s, d):
    """One evaluation an hour: the mean value, as loss of the run of its event type."""
    hours = losses(s, d).groupBy("event_type", F.floor(F.col("sec") / 3600).alias("hour")).agg(F.round(F.avg("value"), 6).alias("loss"))
    return hours.withColumn("step", (F.row_number().over(Window.partitionBy("event_type").orderBy("hour")) * 50).cast("int")).select("event_type", "step", "loss")


def early_stop(s, d):
    r = sampling.early_stop(loss_curve(s, d), "event_type", "step", "loss")
    return r.select("event_type", "step", "best_before", "improved", "bad", "stop")


def head_weights(s, d, scale: float = 1.0):
    """Causal attention of two heads and two layers over all vectors, in sequences of 32: layer 1 sees them reversed."""
    x = F.transform("embedding", lambda v: v.cast("double") * scale)
    v = table(s, d, "embeddings").select(F.floor(F.col("vec_id") / 32).alias("seq"), "vec_id", x.alias("x"))
    one = attention.causal(v, "seq", "vec_id", "x", 2).withColumn("layer", F.lit(0))
    two = attention.causal(v.withColumn("x", F.reverse("x")), "seq", "vec_id", "x", 2).withColumn("layer", F.lit(1))
    return one.union(two)


def head_stats(s, d):
    return attention.stats(head_weights(s, d), "layer", "head")


def head_shift(s, d):
    """Entropies before and after the vectors become 1.5 times as long."""
    a, b = (attention.entropy(head_weights(s, d, k), "layer", "head") for k in (1.0, 1.5))
    return attention.shift(a, b, "entropy")


def logits(s, d):
    """Vectors as rows of logits: (vec_id, token, logit), the logit rounded so that ties occur."""
    return table(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("token", "x")).select("vec_id", F.col("token").cast("int").alias("token"), F.round(F.col("x").cast("double"), 2).alias("logit"))


def penalised(s, d):
    x = logits(s, d).withColumn("logit", sampling.repetition_penalty(F.col("logit"), F.col("token") % 3 == 0, 1.3))
    return sampling.softmax(x, ["vec_id"], "logit", 0.8).select("vec_id", "token", F.round("p", 8).alias("p"))


def rates(s, d):
    r = sampling.rate_window(losses(s, d), "user_id", "event_id", "sec", "value", 3600)
    return r.select("event_id", F.col("requests").cast("long").alias("requests"), F.round("spent", 4).alias("spent"))


def reasoning_df(s, d):
    return table(s, d, "reasoning")


def gold_in_prompt(s, d):
    r = reasoning_df(s, d)
    return r.where("fact_kind = 'relation'").groupBy("task").agg(F.count("*").alias("n"), F.sum(F.when(F.instr(F.col("prompt"), F.col("answer")) == 0, 1).otherwise(0)).cast("long").alias("missing"))


def names_in_prompt(s, d):
    """Whether each answer stands between word boundaries in its own prompt."""
    r = reasoning_df(s, d).where("prompt is not null and answer is not null")
    hit = F.rlike(F.concat(F.lit(" "), "prompt", F.lit(" ")), F.concat(F.lit(r"[\s,:]\Q"), "answer", F.lit(r"\E[\s,?।]")))
    return r.select("ex_id", hit.alias("stands"))


def yes_share(s, d):
    r = reasoning_df(s, d).where("task in ('compare_equal', 'verify_claim')")
    return r.groupBy("lang", "task").agg(F.round(F.avg(F.col("answer").isin("हाँ", "हो").cast("int")), 4).alias("yes_share")).withColumn("balanced", F.col("yes_share").between(0.35, 0.65))


def first_prompts(s, d):
    """The first of each repeated prompt, evaluation splits before training."""
    rank = F.when(F.col("split") == "test", 0).when(F.col("split") == "val", 1).otherwise(2)
    r = reasoning_df(s, d).where("prompt is not null").select("ex_id", "split", "prompt", rank.alias("rank"))
    best = r.groupBy(T.prompt_key(F.col("prompt")).alias("key")).agg(F.min(F.struct("rank", "ex_id")).alias("m"))
    return best.select(F.col("m.ex_id").alias("ex_id"))


#: What each split of the reasoning data should have.
_SPEC = [(split, kind, value) for split in ("train", "val", "test") for kind, values in (("task", [t[0] for t in reasoning.TASKS]), ("attribute", [a[0] for a in reasoning.ATTRIBUTES]), ("entity_pool", sorted({a[1] for a in reasoning.ATTRIBUTES}))) for value in values]


def gaps(s, d):
    """Tasks, attributes and pools of which a split has fewer than 40 examples."""
    spec = s.createDataFrame([(f"{a}/{b}", c) for a, b, c in _SPEC], "kind string, value string")
    r = reasoning_df(s, d)
    rows = r.select(F.explode(F.array(*(F.struct(F.concat(F.col("split"), F.lit(f"/{c}")).alias("kind"), F.col(c).alias("value")) for c in ("task", "attribute", "entity_pool")))).alias("x")).select("x.*")
    return reports.coverage(spec, rows, F.lit(40))


def pool_names(s, d):
    """Names of answers of each pool, wherever they stand in that pool's prompts."""
    r = reasoning_df(s, d)
    names = r.where("fact_kind = 'relation' and answer is not null").select("entity_pool", F.col("answer").alias("name")).distinct()
    found = reasoning.names_within(r, names, "ex_id", "prompt", "entity_pool")
    return found.groupBy("ex_id").agg(F.count("*").alias("n"), F.min("place").cast("int").alias("first"))


def merged_names(s, d):
    """Answers of the evaluation splits that a bank of the training answers would accept and reject, by pool."""
    r = reasoning_df(s, d).where("answer is not null").select(F.col("entity_pool"), F.col("answer"), "ex_id", "split")
    _, counts = reasoning.merged_phrases(r.where("split = 'train'"), r.where("split <> 'train'"), ["entity_pool", "answer"], "ex_id")
    return counts.select("entity_pool", F.col("accepted").cast("long").alias("accepted"), F.col("rejected").cast("long").alias("rejected"))


def previews(s, d):
    return reports.previews(once(s, d).where("generated is not null"), ["task"], ["run_id", "id"], 5, {"prompt": 200, "generated": 400})


def generation_parts(s, d):
    rows = sequences.continued(documents_ids(s, d), "doc_id", "ids", 256)
    return rows.select("doc_id", F.md5(F.array_join("prefix", ",")).alias("prefix"), F.md5(F.array_join("reference", ",")).alias("reference"))


def full_labels(s, d):
    given = F.when(F.col("answer_label").isNotNull(), F.create_map(F.lit("answer"), F.col("answer_label"))).otherwise(F.create_map().cast("map<string,string>"))
    m = reasoning.labels_for(given, {"question": "सवाल", "answer": "?"})
    return reasoning_df(s, d).select("ex_id", m["question"].alias("question"), m["answer"].alias("answer"))


SHARES = {"train": 0.6, "val": 0.15, "test": 0.25}


def generated(s, d, lang: str):
    """As many examples of each split as the reasoning table has of the language; names, wordings and prompts of one split only."""
    have = {r["split"]: r["count"] for r in reasoning_df(s, d).where(F.col("lang") == lang).groupBy("split").count().collect()}
    n = {k: have.get(k, 1) for k in SHARES}
    return examples_.dataset(s, bank.default_bank(lang), n, 1337, SHARES, 512, vocabulary.encoders(table(s, d, "vocab")).get(lang))


def dataset(s, d):
    return generated(s, d, "hi").unionByName(generated(s, d, "ne")).select("id", "lang", "split", "task", "style", "n_entities", "prompt", "answer", "target", "n_tokens")


def dataset_checks(s, d):
    """For each split its examples, their different prompts, answers that don't follow from their facts, and texts over 512 tokens."""
    out = None
    for lang in ("hi", "ne"):
        rows = materialise(generated(s, d, lang))
        right = rows.join(examples_.recomputed(rows).select("id", "right"), "id")
        part = right.groupBy("lang", "split").agg(F.count("*").alias("n"), F.count_distinct("prompt").alias("prompts"), F.sum(F.when(F.col("right"), 0).otherwise(1)).cast("long").alias("wrong"), F.sum(F.when(F.col("n_tokens") > 512, 1).otherwise(0)).cast("long").alias("too_long"))
        out = part if out is None else out.union(part)
    return out


def dataset_leakage(s, d):
    out = None
    for lang in ("hi", "ne"):
        part = examples_.leakage(bank.divided(bank.default_bank(lang), SHARES, 1337), generated(s, d, lang)).select(F.lit(lang).alias("lang"), "axis", "part_a", "part_b", "n_shared", "clean")
        out = part if out is None else out.union(part)
    return out


def partition(s, d):
    names = reasoning_df(s, d).where("fact_kind = 'relation' and answer is not null").select(F.col("entity_pool").alias("pool"), F.col("answer").alias("name"))
    return splits.disjoint(names, "pool", "name", {"train": 0.7, "val": 0.1, "test": 0.2}, 101, floor=2)


TEMPLATES = (
    ("fact", "{E} {poss} {noun} {v} {unit} {copula}।"), ("fact", "{E} {noun}"), ("fact", "x"), ("fact", "{E} {noun} {v} {cmp} है"), ("fact", "{E} {noun} {v} is है"), ("fact", "{E} {noun} {v}!!"),
    ("fact", "{E} {noun} {v} 5 है"), ("fact", "{E} {noun} {v} “है”"), ("fact", "{E} {noun} {v} वर्ष है"), ("rel_fact", "{A} {noun} {B} से {cmp} ज़्यादा है"), ("fact", "{E} {noun} {v} है {copula}"), ("fact", "{E} {noun} {v} है}"), ("q_middle", None), ("q_middle", "बीच में किसका {noun} है?"),
)
_REASONS = ("", "missing placeholder", "length", "unexpected placeholder", "latin", "no script", "digit", "typography", "literal word", "literal comparative", "doubled copula", "malformed braces", "not a string", "")


def templates(s, d):
    rows = s.createDataFrame([(i, *t) for i, t in enumerate(TEMPLATES)], "no int, slot string, text string")
    words = [w for r in reasoning.WORDS for w in (r[1], r[3])]
    reason = reasoning.template_reason(F.col("text"), F.col("required"), F.col("allowed"), sorted(set(words)), ["ज़्यादा", "कम"], ["है"])
    return rows.join(F.broadcast(reasoning.slot_table(s)), "slot").select("no", F.coalesce(reason, F.lit("")).alias("reason"))


def examples(s, d):
    """As many generated examples as the reasoning table has, over invented names."""
    return reasoning.examples(s, max(1, reasoning_df(s, d).count()), reasoning.default_pools(), 1337).drop("names", "values")


def sizes_by(s, d):
    return reports.length_table(reasoning_df(s, d), "split", "n_tokens")


_ONCE = "with o as (select distinct * from predictions) "
_GRAMS = lambda items, n: " || '\x1f' || ".join(f"{items}[i + {k}]" for k in range(n))


def _counts(items: str, orders: int, key: str = "pair", source: str = "t") -> str:
    each = " union all ".join(f"select {key}, {n} as n, unnest(list_transform(range(1, len({items}) - {n - 2}), lambda i: {_GRAMS(items, n)})) as g from {source}" for n in range(1, orders + 1))
    return f"select {key}, n, g, count(*) as c from ({each}) group by all"


def _match(ref: str, hyp: str, orders: int) -> str:
    return f"""h as ({_counts(hyp, orders)}), r as ({_counts(ref, orders)}),
m as (select coalesce(h.pair, r.pair) as pair, coalesce(h.n, r.n) as n, sum(least(coalesce(h.c, 0), coalesce(r.c, 0))) as matched, sum(coalesce(h.c, 0)) as n_hyp, sum(coalesce(r.c, 0)) as n_ref from h full join r on h.pair = r.pair and h.n = r.n and h.g = r.g group by 1, 2),
f as (select t.pair, u.n, coalesce(matched, 0) as matched, coalesce(n_hyp, 0) as n_hyp, coalesce(n_ref, 0) as n_ref from t cross join (select unnest(range(1, {orders + 1})) as n) u left join m on m.pair = t.pair and m.n = u.n)"""


_PAIRS = _ONCE + f", t as (select run_id || '/' || id as pair, {S.words('gold')} as ref, {S.words('predicted')} as hyp, {S.chars('gold')} as rc, {S.chars('predicted')} as hc, gold, predicted, {S.words('generated')} as gen from o where predicted is not null)"
_EVENTS = "with e as (select event_type, epoch(ts)::bigint as sec, user_id, event_id, value, 10 as tokens, 40 as bytes from events where value is not null)"
_LOSS = "select event_type, round(sum(value) / sum(tokens), 4) as cross_entropy, round(exp(least(sum(value) / sum(tokens), 20)), 2) as perplexity, round(sum(value) / (sum(bytes) * ln(2)), 4) as bits_per_byte, sum(tokens)::bigint as tokens from e"
_ATT = """with v as (select vec_id // 32 as seq, vec_id as pos, embedding from embeddings),
p as (select 0 as layer, seq, pos, unnest(range(64)) as i, unnest(embedding)::double as x from v union all select 1, seq, pos, unnest(range(64)), unnest(list_reverse(embedding))::double from v),
s as (select a.layer, a.seq, a.i // 32 as head, a.pos as q, b.pos as k, sum(a.x * b.x) / sqrt(32.0) as s from p a join p b on a.layer = b.layer and a.seq = b.seq and a.i = b.i and b.pos <= a.pos group by all),
w as (select layer::int as layer, seq, head::int as head, q, k, exp(s) / sum(exp(s)) over (partition by layer, seq, head, q) as w, exp(2.25 * s) / sum(exp(2.25 * s)) over (partition by layer, seq, head, q) as w2 from s),
"""
_ENT = "select layer, head, round(avg(h), 4) as entropy from (select layer, head, seq, q, -sum(greatest({w}, 1e-10) * ln(greatest({w}, 1e-10))) as h from w group by all) group by all"
_LOGITS = "with l as (select vec_id, unnest(range(64))::int as token, round(unnest(embedding)::double, 2) as logit from embeddings)"

QUERIES = {
    "pack_blocks": pack_blocks, "eval_chunks": eval_chunks, "sft_mask": sft_mask,
    "length_buckets": lambda s, d: sequences.length_buckets(lengths(s, d), "ex_id", "n_tokens", 32).select("ex_id", "batch_no", "batch_order"),
    "padding_waste": lambda s, d: sequences.padding_waste(sequences.length_buckets(lengths(s, d), "ex_id", "n_tokens", 32), "n_tokens"),
    "prompt_length_groups": lambda s, d: reasoning_df(s, d).groupBy(T.word_count(F.col("prompt")).cast("int").alias("length")).agg(F.count("*").alias("n")),
    "over_length": lambda s, d: reasoning_df(s, d).where("n_tokens > 60").select("ex_id"),
    "bleu4": lambda s, d: metrics.bleu(scored_pairs(s, d), "pair", "ref", "hyp"),
    "chrf": lambda s, d: metrics.chrf(scored_pairs(s, d), "pair", "gold", "predicted"),
    "rouge_l": lambda s, d: metrics.rouge_l(scored_pairs(s, d), "ref", "hyp"),
    "distinct_n": lambda s, d: metrics.diversity(scored_pairs(s, d).select("pair", T.words(F.col("generated")).alias("gen")), "pair", "gen"),
    "ngram_clip_matches": lambda s, d: metrics.matches(scored_pairs(s, d), "pair", "ref", "hyp", 2),
    "answer_extraction": answers, "error_classes": error_classes, "arm_compare": arms,
    "accuracy_by_group": lambda s, d: reports.accuracy(once(s, d), "task", "hops"),
    "error_taxonomy": lambda s, d: reports.error_shares(once(s, d).where("not correct")),
    "samples_per_task": lambda s, d: reports.first_of_each(reasoning_df(s, d), ["task"], ["ex_id"], 2).select("task", "ex_id", "rank"),
    "first_failures": lambda s, d: reports.first_of_each(once(s, d).where("not correct"), ["run_id", "task"], ["id"], 1).select("run_id", "task", "id"),
    "lm_metrics": lambda s, d: metrics.loss(losses(s, d), ["event_type"], "value", "tokens", "bytes"),
    "forgetting": forgetting,
    "validation_mean": lambda s, d: metrics.mean_of_means(losses(s, d).groupBy("event_type", "user_id").agg(F.avg("value").alias("mean"), F.count("*").alias("n")), ["event_type"], "mean", "n"),
    "validation_first": lambda s, d: metrics.mean_of_means(losses(s, d).groupBy("event_type", "user_id").agg(F.avg("value").alias("mean"), F.count("*").alias("n")), ["event_type"], "mean", "n", ["user_id"], 50),
    "over_samples": lambda s, d: attention.over_samples(losses(s, d).groupBy("event_type", "user_id").agg(F.avg("value").alias("value")), ["event_type"], "value"),
    "merged_names": merged_names,
    "early_stopping": early_stop,
    "lr_schedule": lambda s, d: s.range(0, 2001, 50).select(F.col("id").alias("step"), F.round(sampling.learning_rate(F.col("id"), 200, 1500), 8).alias("rate")),
    "rate_window": rates,
    "attention_stats": head_stats, "attention_shift": head_shift,
    "top_k": lambda s, d: sampling.top_k(logits(s, d), ["vec_id"], "logit", 5).select("vec_id", "token"),
    "top_p": lambda s, d: sampling.top_p(logits(s, d), ["vec_id"], "logit", "token", 0.9).select("vec_id", "token"),
    "softmax_temperature": penalised,
    "fertility": fertility, "unknown_characters": unknown_characters,
    "frequency_tables": lambda s, d: reports.frequencies(reasoning_df(s, d), "task", "fact_kind", "hops", "attribute", "style", "n_entities"),
    "distinct_counts": lambda s, d: reasoning_df(s, d).groupBy("split").agg(F.count_distinct("prompt").alias("prompts"), F.count_distinct("answer").alias("answers")),
    "token_lengths": sizes_by,
    "split_leakage": lambda s, d: reports.shared(reasoning_df(s, d), "split", T.prompt_key(F.col("prompt"))),
    "coverage_gaps": gaps, "gold_in_prompt": gold_in_prompt, "names_in_prompt": names_in_prompt, "yes_share": yes_share, "prompt_first": first_prompts,
    "reasoning_partition": partition, "template_validate": templates, "reasoning_examples": examples,
    "clean_names": lambda s, d: reasoning_df(s, d).select("ex_id", F.coalesce(reasoning.clean_phrase(F.col("answer")), F.lit("")).alias("name")),
    "digits_folded": lambda s, d: reasoning_df(s, d).where("answer is not null").select("ex_id", T.to_ascii_digits(F.col("answer")).alias("answer")),
    "prompt_wrap": lambda s, d: reasoning_df(s, d).where("prompt is not null").select("ex_id", F.md5(reasoning.wrapped(F.col("prompt"), F.lit("सवाल"), F.col("answer_label"))).alias("wrapped")),
    "weighted_draw": lambda s, d: splits.draw(reasoning_df(s, d).select("ex_id"), "ex_id", [(t[0], t[3]) for t in reasoning.TASKS], 5),
    "fitting_prompt": lambda s, d: reasoning.fitting_prompt(reasoning_df(s, d).where("n_tokens is not null").select("ex_id", "task", "n_tokens"), "task", "n_tokens", "ex_id", ["transitive_largest", "chain_largest"], 48),
    "pool_names": pool_names, "sample_previews": previews, "generation_parts": generation_parts, "full_labels": full_labels,
    "reasoning_dataset": dataset, "reasoning_dataset_checks": dataset_checks, "reasoning_leakage": dataset_leakage,
    "vocabulary_file": lambda s, d: __import__("corpusloom.sources.files", fromlist=["files"]).vocabulary_lines(table(s, d, "vocab")),
}


def _draw_sql() -> str:
    total, upto, out = sum(t[3] for t in reasoning.TASKS), 0.0, []
    for t in reasoning.TASKS[:-1]:
        upto += t[3] / total
        out.append(f"when u < {upto!r} then '{t[0]}'")
    return f"select ex_id, case {' '.join(out)} else '{reasoning.TASKS[-1][0]}' end as task from (select ex_id, {S.uniform('ex_id', 5)} as u from reasoning)"


SQL = {
    "pack_blocks": f"with {S.token_ids('documents', 'doc_id', 'text', 'text is not null')}, s as (select doc_id, unnest(list_append(ids, 3)) as t, unnest(range(len(ids) + 1)) as k from i), o as (select t, row_number() over (order by doc_id, k) - 1 as o from s), x as (select o // 512 as b, md5(string_agg(t, ',' order by o)) as inputs from o group by 1), y as (select (o - 1) // 512 as b, md5(string_agg(t, ',' order by o)) as targets from o where o > 0 group by 1) select x.b as block_no, inputs, targets from x join y on x.b = y.b where x.b < (select (count(*) - 1) // 512 from o)",
    "eval_chunks": f"with {S.token_ids('documents', 'doc_id', 'text', 'text is not null')}, t as (select i.doc_id, strlen(text) as b, list_append(ids, 3) as t from i join documents d on d.doc_id = i.doc_id where len(ids) >= 2), c as (select *, unnest(range(0, len(t) - 1, 512)) as s from t), x as (select *, t[s + 1 : s + 513] as x from c) select doc_id, (s // 512)::int as chunk_no, md5(array_to_string(list_resize(x[1 : len(x) - 1], 512, 0), ',')) as inputs, md5(array_to_string(list_resize(x[2 : len(x)], 512, 0), ',')) as targets, (len(x) - 1)::int as num_tokens, case when s = 0 then b else 0 end::bigint as num_bytes from x",
    "sft_mask": f"with {S.token_ids('reasoning', 'ex_id', 'prompt_text', name='p')}, {S.token_ids('reasoning', 'ex_id', 'target', name='a')}, f as (select ex_id, list_concat(p.ids, a.ids) as f, len(p.ids) as n from p join a using (ex_id)) select ex_id, md5(array_to_string(f[1 : len(f) - 1], ',')) as inputs, md5(array_to_string(list_transform(range(2, len(f) + 1), lambda i: case when i - 2 < n - 1 then -100 else f[i] end), ',')) as labels from f where len(f) between 2 and 256",
    "length_buckets": f"select ex_id, (row_number() over (order by n_tokens, {S.rank_hash('ex_id', 0)}) - 1) // 32 as batch_no, {S.rank_hash(f'''((row_number() over (order by n_tokens, {S.rank_hash('ex_id', 0)}) - 1) // 32)''', 1)} as batch_order from reasoning where n_tokens is not null",
    "padding_waste": f"with b as (select n_tokens, (row_number() over (order by n_tokens, {S.rank_hash('ex_id', 0)}) - 1) // 32 as b from reasoning where n_tokens is not null), p as (select max(n_tokens) * count(*) as padded, sum(n_tokens) as real from b group by b) select round(sum(padded) / sum(real), 4) as waste from p",
    "prompt_length_groups": f"select len({S.words('prompt')})::int as length, count(*) as n from reasoning group by 1",
    "over_length": "select ex_id from reasoning where n_tokens > 60",
    "bleu4": _PAIRS + "," + _match("ref", "hyp", 4) + ", p as (select n, sum(matched) / greatest(sum(n_hyp), 1) as p from f group by n), z as (select sum(len(ref)) as r, sum(len(hyp)) as c from t) select case when c = 0 then 0.0 else round(case when c < r then exp(1 - r / c) else 1.0 end * (select exp(sum(ln(greatest(p, 1e-10))) / 4) from p) * 100, 2) end as bleu from z",
    "chrf": _PAIRS + "," + _match("rc", "hc", 6) + ", a as (select avg(matched / greatest(n_hyp, 1)) as p, avg(matched / greatest(n_ref, 1)) as r from f) select case when p + r = 0 then 0.0 else round(5 * p * r / (4 * p + r) * 100, 2) end as chrf from a",
    "rouge_l": _PAIRS.replace("with o", "with recursive o", 1) + ", q as (select pair, 0 as k, ref, hyp, list_transform(range(len(ref) + 1), lambda x: 0) as row from t union all select pair, k + 1, ref, hyp, list_transform(range(1, len(ref) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda h: case when h > 1 and ref[h - 1] = hyp[k + 1] then row[h - 1] + 1 else row[h] end))) from q where k < len(hyp)), n as (select len(ref) as r, len(hyp) as h, list_max(row) as n from q where k = len(hyp)), f as (select n / greatest(h, 1) as p, n / greatest(r, 1) as r from n) select round(coalesce(avg(case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end), 0.0) * 100, 2) as rouge_l from f",
    "distinct_n": _PAIRS + ", c as (" + _counts("gen", 4) + "), d as (select n, count(*) as u, sum(k) as k from (select n, g, sum(c) as k from c group by all) group by n) select round((select u / k from d where n = 1), 4) as distinct_1, round((select u / k from d where n = 2), 4) as distinct_2, round((select sum(c - 1) / sum(c) from c where n = 4), 4) as repetition_4",
    "ngram_clip_matches": _PAIRS + "," + _match("ref", "hyp", 2) + " select pair, n::int as n, matched::bigint as matched, n_hyp::bigint as n_hyp, n_ref::bigint as n_ref from f",
    "answer_extraction": _ONCE + f", g as (select run_id, o.id, {S.strip('''case when contains(generated, answer_label || ':') then substr(generated, strpos(generated, answer_label || ':') + length(answer_label) + 1) else generated end''')} as g, {S.normalise_answer('gold')} as gold from o join reasoning r on o.id = r.id where generated is not null), a as (select run_id, id, {S.normalise_answer('''string_split(string_split(g, chr(10))[1], '।')[1]''')} as extracted, gold from g) select run_id, id, extracted, length(extracted) > 0 and (contains(gold, extracted) or contains(extracted, gold)) as lenient, extracted = gold as strict from a",
    "error_classes": _ONCE + r"select run_id, id, case when not format_ok then 'format_error' when not regexp_matches(predicted, '\p{Nd}') and length(predicted) > 1 and not contains(prompt, predicted) and predicted not in ('हाँ', 'हो', 'होइन', 'नही', 'नहीं', 'बराबर') then 'hallucination_error' when regexp_matches(predicted, '\p{Nd}') or regexp_matches(task, 'calc|age|distance') then 'calculation_error' when regexp_matches(generated, 'तर्क|कारण|भन्दा|से') then 'reasoning_step_error' else 'conclusion_error' end as class from o where not correct and predicted is not null and generated is not null",
    "arm_compare": _ONCE + ", a as (select run_id, task, avg(correct::int) as x from o group by all) select b.run_id, b.task, round(coalesce(a.x, 0.0), 4) as before, round(b.x, 4) as after, round(b.x - coalesce(a.x, 0.0), 4) as change from a b left join a on a.task = b.task and a.run_id = 'run_00'",
    "accuracy_by_group": _ONCE + "select task, hops, count(*) as n, round(avg(correct::int), 4) as accuracy, round(avg(format_ok::int), 4) as format_rate, round(avg(answer_in_text::int), 4) as in_text_rate from o group by grouping sets ((), (task), (hops))",
    "error_taxonomy": _ONCE + "select error_type, count(*) as n, round(count(*) / sum(count(*)) over (), 4) as share from o where not correct and error_type is not null group by error_type",
    "samples_per_task": "select task, ex_id, r::int as rank from (select task, ex_id, row_number() over (partition by task order by ex_id) as r from reasoning) where r <= 2",
    "first_failures": _ONCE + "select run_id, task, min(id) as id from o where not correct group by all",
    "lm_metrics": _EVENTS + _LOSS + " group by event_type",
    "forgetting": _EVENTS + f", b as ({_LOSS} group by event_type), a as ({_LOSS.replace('sum(value)', 'sum(value + 0.5)')} group by event_type), k as (select b.event_type, b.perplexity as pb, a.perplexity as pa, b.bits_per_byte as bb, a.bits_per_byte as ba, least(100.0, b.perplexity / greatest(a.perplexity, 0.001) * 100) as kept from a join b on a.event_type = b.event_type) select event_type, round(pa - pb, 4) as ppl_change, round(ba - bb, 4) as bpb_change, round(kept, 2) as retained, case when kept >= 90 then 'preserved' when kept >= 75 then 'partly forgotten' else 'forgotten' end as verdict from k",
    "validation_mean": _EVENTS + ", m as (select event_type, user_id, avg(value) as mean, count(*) as n from e group by all) select event_type, round(sum(mean * n) / sum(n), 6) as loss from m group by event_type",
    "validation_first": _EVENTS + ", m as (select event_type, user_id, avg(value) as mean, count(*) as n from e group by all), f as (select *, row_number() over (partition by event_type order by user_id) as r from m) select event_type, round(sum(mean * n) / sum(n), 6) as loss from f where r <= 50 group by event_type",
    "over_samples": _EVENTS + ", m as (select event_type, user_id, avg(value) as v from e group by all) select event_type, round(avg(round(v, 4)), 4) as value from m group by event_type",
    "merged_names": "with k as (select distinct entity_pool, answer from reasoning where split = 'train' and answer is not null), c as (select entity_pool, answer from reasoning where split <> 'train' and answer is not null), f as (select distinct entity_pool, answer from c where not exists (select 1 from k where k.entity_pool = c.entity_pool and k.answer = c.answer)), n as (select entity_pool, count(*) as a from f group by 1) select c.entity_pool, coalesce(any_value(a), 0)::bigint as accepted, (count(*) - coalesce(any_value(a), 0))::bigint as rejected from c left join n using (entity_pool) group by 1",
    "early_stopping": _EVENTS + ", h as (select event_type, sec // 3600 as hour, round(avg(value), 6) as loss from e group by all), s as (select event_type, (row_number() over (partition by event_type order by hour) * 50)::int as step, loss from h), b as (select *, min(loss) over (partition by event_type order by step rows between unbounded preceding and 1 preceding) as best_before from s), i as (select *, best_before is null or loss < best_before as improved from b), g as (select *, sum(improved::int) over (partition by event_type order by step) as g from i), n as (select *, row_number() over (partition by event_type, g order by step) - 1 as bad from g) select event_type, step, best_before, improved, bad, bad >= 6 and step > 200 as stop from n",
    "lr_schedule": "select s as step, round(case when s < 200 then s / 200.0 else greatest(0.1, 0.5 * (1 + cos(pi() * least(1.0, (s - 200) / 1300.0)))) end::double, 8) as rate from range(0, 2001, 50) t(s)",
    "rate_window": _EVENTS + "select event_id, count(*) over w as requests, round(sum(value) over w, 4) as spent from e window w as (partition by user_id order by sec range between 3599 preceding and current row)",
    "attention_stats": _ATT + "e as (" + _ENT.format(w="w") + "), d as (select layer, head, round(avg(d), 2) as distance from (select layer, head, seq, q, sum(w * abs(q - k)) as d from w group by all) group by all) select e.layer, e.head, entropy, distance from e join d on e.layer = d.layer and e.head = d.head",
    "attention_shift": _ATT + "a as (" + _ENT.format(w="w") + "), b as (" + _ENT.format(w="w2") + "), c as (select a.layer, a.head, round(b.entropy - a.entropy, 4) as change from a join b on a.layer = b.layer and a.head = b.head) select layer, head, change, round(avg(change) over (partition by layer), 4) as layer_mean, round(avg(change) over (), 4) as overall, row_number() over (order by change desc, layer, head)::int as from_top, row_number() over (order by change, layer, head)::int as from_bottom from c",
    "top_k": _LOGITS + "select vec_id, token from (select *, rank() over (partition by vec_id order by logit desc) as r from l) where r <= 5",
    "top_p": _LOGITS + ", p as (select *, exp(logit) / sum(exp(logit)) over (partition by vec_id) as p from l) select vec_id, token from (select *, coalesce(sum(p) over (partition by vec_id order by logit desc, token rows between unbounded preceding and 1 preceding), 0) as c from p) where c <= 0.9",
    "softmax_temperature": _LOGITS + ", q as (select vec_id, token, case when token % 3 = 0 and logit > 0 then logit / 1.3 when token % 3 = 0 then logit * 1.3 else logit end / 0.8 as z from l) select vec_id, token, round(exp(z) / sum(exp(z)) over (partition by vec_id), 8) as p from q",
    "fertility": f"with {S.token_ids('train', 'rec_id', 'text', 'text is not null')}, s as (select lang, sum(len(ids))::bigint as tokens, sum(len({S.words('text')}))::bigint as words, sum(length(text)) as chars, sum(len(list_filter(ids, lambda x: x = 1)))::bigint as unknown from i join train t on t.rec_id = i.rec_id group by lang) select lang, tokens, words, round(tokens / words, 4) as fertility, round(chars / tokens, 4) as chars_per_token, round(unknown / tokens, 8)::double as unknown_rate from s",
    "unknown_characters": f"with k as (select lang, string_agg(piece, '') as known from vocab where length(piece) = 1 group by 1), c as (select rec_id, unnest({S.chars('text')}) as c, unnest(range(len({S.chars('text')}))) as i, case when lang in (select lang from k) then lang else 'hi' end as lang from train where text is not null), u as (select rec_id, c, i from c join k on k.lang = c.lang where not contains(known, c) and not regexp_matches(c, '[{T.SPACE}]')) select rec_id, arg_min(c, i) as character, min(i)::int as place, count(*)::int as n from u group by 1",
    "frequency_tables": " union all ".join(f"select '{c}' as column, {c}::varchar as value, count(*) as n from reasoning group by {c}" for c in ("task", "fact_kind", "hops", "attribute", "style", "n_entities")).replace(" as column", ' as "column"'),
    "distinct_counts": "select split, count(distinct prompt) as prompts, count(distinct answer) as answers from reasoning group by split",
    "token_lengths": "with l as (select split, list_sort(list(n_tokens::bigint)) as a from reasoning where n_tokens is not null group by split) select split, len(a)::bigint as n, round(list_avg(a), 1) as mean, a[len(a) // 2 + 1] as median, a[floor(0.95 * (len(a) - 1))::int + 1] as p95, list_max(a) as max from l",
    "split_leakage": f"with k as (select distinct split, regexp_replace(prompt, '[{T.SPACE}]+', '', 'g') as v from reasoning where prompt is not null), p as (select distinct split from reasoning) select a.split as part_a, b.split as part_b, (select count(*) from k x join k y on x.v = y.v where x.split = a.split and y.split = b.split) as n from p a join p b on a.split < b.split",
    "coverage_gaps": "with s(kind, value) as (values " + ", ".join(f"('{a}/{b}', '{c}')" for a, b, c in _SPEC) + "), r as (select split || '/task' as kind, task as value from reasoning union all select split || '/attribute', attribute from reasoning union all select split || '/entity_pool', entity_pool from reasoning), n as (select kind, value, count(*) as n from r group by all) select kind, value, coalesce(n, 0)::bigint as n, 40 as least from s left join n using (kind, value) where coalesce(n, 0) < 40",
    "pool_names": r"with n as (select distinct entity_pool, answer as name from reasoning where fact_kind = 'relation' and answer is not null), p as (select ex_id, name, list_min(list_filter(list_transform([' ', '।', '?', ',', ':', chr(10)], lambda c: strpos(' ' || prompt, c || name)), lambda x: x > 0)) - 1 as place from reasoning r join n on n.entity_pool = r.entity_pool where prompt is not null), h as (select * from p where place is not null), o as (select *, max(length(name)) over (partition by ex_id, place) as longest from h) select ex_id, count(*) as n, min(place)::int as first from o where length(name) = longest group by 1",
    "sample_previews": _ONCE + "select task, run_id, id, r::int as rank, substr(prompt, 1, 200) as prompt, substr(generated, 1, 400) as generated from (select *, row_number() over (partition by task order by run_id, id) as r from o where generated is not null) where r <= 5",
    "generation_parts": f"with {S.token_ids('documents', 'doc_id', 'text', 'text is not null')}, c as (select doc_id, ids, least(greatest(5, len(ids) // 2), 246) as c from i where len(ids) >= 10) select doc_id, md5(array_to_string(ids[1 : c], ',')) as prefix, md5(array_to_string(ids[c + 1 : c + 100], ',')) as reference from c where len(ids) - c >= 5",
    "full_labels": "select ex_id, 'सवाल' as question, case when length(coalesce(answer_label, '')) > 0 then answer_label else '?' end as answer from reasoning",
    "reasoning_dataset_checks": "with s as (select unnest(['train', 'val', 'test']) as split), l as (select unnest(['hi', 'ne']) as lang), n as (select lang, split, count(*) as n from reasoning group by all) select l.lang, s.split, coalesce(n, 1)::bigint as n, coalesce(n, 1)::bigint as prompts, 0::bigint as wrong, 0::bigint as too_long from l cross join s left join n on n.lang = l.lang and n.split = s.split",
    "reasoning_leakage": "select lang, axis, a as part_a, b as part_b, 0::bigint as n_shared, true as clean from (select unnest(['hi', 'ne']) as lang) cross join (select unnest(['names', 'templates', 'prompts']) as axis) cross join (values ('test', 'train'), ('test', 'val'), ('train', 'val')) p(a, b)",
    "gold_in_prompt": "select task, count(*) as n, sum(case when strpos(prompt, answer) = 0 then 1 else 0 end)::bigint as missing from reasoning where fact_kind = 'relation' group by task",
    "names_in_prompt": r"select ex_id, regexp_matches(' ' || prompt || ' ', '[\s,:]' || regexp_escape(answer) || '[\s,?।]') as stands from reasoning where prompt is not null and answer is not null",
    "yes_share": "select lang, task, round(avg((answer in ('हाँ', 'हो'))::int), 4) as yes_share, round(avg((answer in ('हाँ', 'हो'))::int), 4) between 0.35 and 0.65 as balanced from reasoning where task in ('compare_equal', 'verify_claim') group by lang, task",
    "prompt_first": f"select ex_id from (select ex_id, row_number() over (partition by regexp_replace(prompt, '[{T.SPACE}]+', '', 'g') order by case split when 'test' then 0 when 'val' then 1 else 2 end, ex_id) as r from reasoning where prompt is not null) where r = 1",
    "reasoning_partition": f"with n as (select distinct entity_pool as pool, answer as name from reasoning where fact_kind = 'relation' and answer is not null), r as (select *, row_number() over (partition by pool order by {S.rank_hash('name', 101)}) - 1 as r, count(*) over (partition by pool) as n from n) select pool, name, case when r < 2 + floor((n - 6) * {0.7 / (0.7 + 0.1 + 0.2)!r}) then 'train' when r < 4 + floor((n - 6) * {0.7 / (0.7 + 0.1 + 0.2)!r}) + floor((n - 6) * {0.1 / (0.7 + 0.1 + 0.2)!r}) then 'val' else 'test' end as split from r where n >= 6",
    "template_validate": "select no::int as no, reason from (values " + ", ".join(f"({i}, '{r}')" for i, r in enumerate(_REASONS)) + ") t(no, reason)",
    "clean_names": f"with t as (select ex_id, {S.strip(f'''regexp_replace(answer, '[{T.SPACE}]+', ' ', 'g')''')} as t from reasoning) select ex_id, case when length(t) between 1 and 30 and not regexp_matches(t, '[A-Za-z0-9०-९]') and regexp_matches(t, '{T.SCRIPT}') and not regexp_matches(t, '{reasoning.SMART}') and not regexp_matches(t, '[{{}}\\[\\]()\"''|/\\\\,]') then t else '' end as name from t",
    "digits_folded": f"select ex_id, {S.ascii_digits('answer')} as answer from reasoning where answer is not null",
    "prompt_wrap": "select ex_id, md5(case when starts_with(prompt, 'सवाल:') then prompt else 'सवाल: ' || prompt || chr(10) || answer_label || ': ' end) as wrapped from reasoning where prompt is not null",
    "weighted_draw": _draw_sql(),
    "fitting_prompt": "select ex_id, task, n_tokens from reasoning where n_tokens <= 48 order by case when task in ('transitive_largest', 'chain_largest') then 0 else 1 end, ex_id limit 1",
    "vocabulary_file": "select lang, token_id, replace(replace(replace(piece, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r') as line from vocab",
}
