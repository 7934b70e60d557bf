"""Reasoning examples whose labels are known by construction: specifications, validation of phrases, generation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..functions import substrings
from ..functions import text as T
from .splits import draw, rank_hash, uniform

# Attribute, pool of names, least and greatest value, step.
ATTRIBUTES = (
    ("age", "people", 4, 90, 1), ("height", "people", 95, 195, 1), ("weight", "people", 18, 110, 1), ("price", "objects", 25, 4000, 5), ("quantity", "fruits", 2, 80, 1),
    ("distance", "cities", 10, 900, 5), ("population", "cities", 2, 95, 1), ("speed", "animals", 6, 115, 1), ("temperature", "cities", 2, 45, 1),
)
# Task, kind of facts, hops, weight.
TASKS = (
    ("compare_two_more", "value", 1, 1.0), ("compare_two_less", "value", 1, 1.0), ("compare_equal", "value", 1, 0.8), ("numeric_difference", "value", 1, 0.8), ("verify_claim", "value", 1, 0.8),
    ("middle_entity", "value", 2, 0.8), ("order_ascending", "value", 2, 0.9), ("order_descending", "value", 2, 0.9), ("transitive_relation", "relation", 2, 1.3), ("transitive_largest", "relation", 2, 1.1),
    ("transitive_smallest", "relation", 2, 1.1), ("chain_relation", "relation", 3, 1.2), ("chain_largest", "relation", 3, 1.0), ("chain_smallest", "relation", 3, 1.0), ("mixed_direction_chain", "relation", 3, 1.2),
)
# Placeholders that a template of each slot must have, and those it may have besides.
SLOTS = {
    "fact": ("E noun v", "poss unit copula"), "rel_fact": ("A B noun cmp", "poss poss_obl copula"), "q_which_of_two": ("A B noun cmp", "poss whose copula"), "q_extreme": ("noun cmp", "poss whose copula"),
    "q_equality": ("A B noun", "poss copula"), "q_difference": ("A B noun", "poss poss_obl howmuch cmp copula"), "q_ordering": ("noun cmp_from cmp_to", "poss copula"), "q_middle": ("noun", "poss whose copula"),
    "q_verify": ("A B noun cmp", "poss poss_obl copula"), "fact_step": ("E noun v", "poss unit"), "rel_step": ("A B noun cmp", "poss poss_obl copula"), "deduce_step": ("A B C noun cmp", "poss poss_obl copula"),
    "flip_step": ("A B noun cmp_from cmp_to", "poss poss_obl copula"), "diff_step": ("vA vB d", "unit noun"), "order_step": ("ordered", "poss noun"), "equal_step": ("noun", "A B poss v unit copula"), "conclusion_step": ("answer", ""),
}
# Typographic signs that look like plain ones.
SMART = r"[\x{2010}-\x{2015}\x{2018}-\x{201b}\x{201c}-\x{201f}\x{2026}\x{a0}\x{202f}]"
PLACEHOLDER = r"\{[A-Za-z_]+\}"
#: Characters behind which a word begins, and binary logarithm of the most bits (32 MB) that tell names from other substrings.
WORD_BEGINS, MOST_BITS = " ।?,:\n", 28
#: Words of a bank's attributes: attribute, noun, possessive, unit, more, less.
WORDS = (
    ("age", "आयु", "की", "वर्ष", "ज़्यादा", "कम"), ("height", "लंबाई", "की", "सेंटीमीटर", "ज़्यादा", "कम"), ("weight", "वज़न", "का", "किलो", "ज़्यादा", "कम"), ("price", "दाम", "का", "रुपये", "ज़्यादा", "कम"),
    ("quantity", "भंडार", "का", "किलो", "ज़्यादा", "कम"), ("distance", "फ़ासला", "का", "किलोमीटर", "ज़्यादा", "कम"), ("population", "आबादी", "की", "लाख", "ज़्यादा", "कम"),
    ("speed", "रफ़्तार", "की", "किमी प्रति घंटा", "ज़्यादा", "कम"), ("temperature", "तापमान", "का", "डिग्री", "ज़्यादा", "कम"),
)


def default_pools(n: int = 60) -> dict[str, list[str]]:
    """Invented names of each pool, by a rule; a bank of one's own replaces them."""
    first, second = "कगचजटडतदनपबमरलसह", ("ा", "ि", "ी", "ु", "े", "ो")
    ending = {"people": "न", "cities": "पुर", "objects": "ड़ा", "animals": "या", "fruits": "ला"}
    name = lambda i: first[i % 16] + second[i % 6] + first[(5 * i + 3) % 16] + second[(i // 6) % 6]
    return {pool: sorted({name(i) + end for i in range(n)}) for pool, end in ending.items()}


def slot_table(spark: SparkSession) -> DataFrame:
    rows = [(k, must.split(), must.split() + may.split()) for k, (must, may) in SLOTS.items()]
    return spark.createDataFrame(rows, "slot string, required array<string>, allowed array<string>")


def template_reason(text: Column, required: Column, allowed: Column, nouns: list[str] = (), comparatives: list[str] = (), copulas: list[str] = (), probe: dict[str, str] | None = None, characters: str | None = None) -> Column:
    """The first rule that a template breaks, or null.

    Word lists are the bank's words that must come by placeholder.  With ``probe`` (a value for each placeholder)
    the template is filled, and must have no placeholder left and some text; with ``characters`` (those of the
    vocabulary) what it says must have a token for each character.
    """
    t = T.strip(text)
    found = F.transform(F.regexp_extract_all(t, F.lit(PLACEHOLDER), F.lit(0)), lambda p: F.regexp_replace(p, r"[{}]", ""))
    bare = F.regexp_replace(t, PLACEHOLDER, "")
    tokens = F.split(bare, r"[\s।?,:=%()\-]+")

    def states(words: list[str]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | (F.contains(bare, F.lit(w)) if " " in w else F.array_contains(tokens, w))
        return out

    doubled = F.lit(False)
    for c in copulas:
        doubled = doubled | F.rlike(t, F.lit(rf"\{{copula\}}\s*{c}($|[\s।?,])")) | F.rlike(t, F.lit(rf"(^|[\s।?,]){c}\s*\{{copula\}}"))
    filled = t
    for k, v in (probe or {}).items():
        filled = F.replace(filled, F.lit("{" + k + "}"), F.lit(v))
    opens, closes = (T.count_of(t, c) for c in (r"\{", r"\}"))
    return (
        F.when(text.isNull(), "not a string")
        .when(~F.length(t).between(4, 400), "length")
        .when(F.size(F.array_except(required, found)) > 0, "missing placeholder")
        .when(F.size(F.array_except(found, allowed)) > 0, "unexpected placeholder")
        .when((opens != F.size(found)) | (opens != closes), "malformed braces")
        .when(F.rlike(bare, F.lit("[A-Za-z]")), "latin")
        .when(~F.rlike(bare, F.lit(T.SCRIPT)), "no script")
        .when(F.rlike(bare, F.lit("[0-9०-९]")), "digit")
        .when(F.rlike(bare, F.lit(SMART)), "typography")
        .when(states(list(nouns)), "literal word")
        .when(F.rlike(t, F.lit(r"\{cmp(_from|_to)?\}")) & states(list(comparatives)), "literal comparative")
        .when(doubled, "doubled copula")
        .when(F.rlike(filled, F.lit(PLACEHOLDER)) if probe is not None else F.lit(False), "does not render")
        .when(F.length(T.strip(filled)) == 0 if probe is not None else F.lit(False), "renders empty")
        .when(F.length(F.translate(F.regexp_replace(filled, rf"[{T.SPACE}]", ""), characters, "")) > 0 if characters is not None else F.lit(False), "unknown characters")
    )


def clean_phrase(text: Column, most: int = 30, name: bool = True) -> Column:
    """A usable entity name (or attribute word, with name=False), white space collapsed; null if it is not usable."""
    t = T.strip(F.regexp_replace(text, rf"[{T.SPACE}]+", " "))
    bad = F.rlike(t, F.lit(r"[A-Za-z0-9०-९]")) | ~F.rlike(t, F.lit(T.SCRIPT)) | F.rlike(t, F.lit(SMART))
    if name:
        bad = bad | F.rlike(t, F.lit(r"[{}\[\]()\"'|/\\,]"))
    return F.when(F.length(t).between(1, most) & ~bad, t)


def merged_phrases(known: DataFrame, candidates: DataFrame, by: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """Candidates that are new, each once; and how many of each slot were accepted and rejected."""
    fresh = candidates.groupBy(*by).agg(F.min(order).alias(order), F.count("*").alias("_n")).join(known.select(*by).distinct(), by, "left_anti")
    every = candidates.groupBy(by[0]).agg(F.count("*").alias("offered"))
    counts = every.join(fresh.groupBy(by[0]).agg(F.count("*").alias("accepted")), by[0], "left").select(by[0], F.coalesce("accepted", F.lit(0)).alias("accepted"), (F.col("offered") - F.coalesce("accepted", F.lit(0))).alias("rejected"))
    return fresh.drop("_n"), counts


def examples(spark: SparkSession, n: int, pools: dict[str, list[str]], seed: int, words: tuple = WORDS, yes: str = "हाँ", no: str = "नहीं") -> DataFrame:
    """n examples of the 15 tasks, with names, values, prompt and answer; a pure function of the seed.

    Values of one example lie in separate parts of the attribute's range, two steps apart at least, in hashed
    order; so labels follow from the ranks alone.  Names of relation tasks are ranked by their place in ``names``:
    the first has most.
    """
    pools = {k: sorted(set(v)) for k, v in pools.items()}
    attrs = F.array(*(F.struct(F.lit(a[0]).alias("attribute"), F.lit(a[1]).alias("pool"), F.lit(a[2]).alias("low"), F.lit(a[3]).alias("high"), F.lit(a[4]).alias("step"), *(F.lit(w[i]).alias(k) for i, k in enumerate(("key", "noun", "poss", "unit", "more", "less")))) for a in ATTRIBUTES for w in words if w[0] == a[0] and a[1] in pools))
    pool_map = F.create_map(*(x for k, v in pools.items() for x in (F.lit(k), F.array(*(F.lit(s) for s in v)))))
    rows = draw(spark.range(n).withColumnRenamed("id", "ex_id"), "ex_id", [(t[0], t[3]) for t in TASKS], seed)
    specs = F.create_map(*(x for t in TASKS for x in (F.lit(t[0]), F.struct(F.lit(t[1]).alias("fact_kind"), F.lit(t[2]).alias("hops")))))
    u = lambda k: uniform(F.col("ex_id"), seed + k)
    size = F.when(F.col("hops") == 3, 4 + (u(1) * 2).cast("int")).when(F.col("task").rlike("order"), 3 + (u(1) * 2).cast("int")).when(F.col("task").rlike("middle|transitive"), 3).otherwise(2)
    rows = rows.select("ex_id", "task", specs[F.col("task")].alias("s")).select("ex_id", "task", "s.*")
    rows = rows.select("*", size.alias("n_entities"), F.element_at(attrs, (u(2) * F.size(attrs)).cast("int") + 1).alias("a")).select("ex_id", "task", "fact_kind", "hops", "n_entities", "a.*").drop("key")
    pick = lambda items, k: F.slice(F.transform(F.array_sort(F.transform(items, lambda x: F.struct(rank_hash(F.concat_ws("/", F.col("ex_id").cast("string"), x.cast("string")), seed + k).alias("h"), x.alias("x")))), lambda s: s["x"]), F.lit(1), F.col("n_entities"))
    slots = ((F.col("high") - F.col("low")) / F.col("step")).cast("int")
    part = F.floor(slots / F.col("n_entities"))
    value = lambda j: (F.col("low") + F.col("step") * (j * part + F.floor(uniform(F.concat_ws("/", F.col("ex_id").cast("string"), j.cast("string")), seed + 4) * (part - 1)))).cast("long")
    rows = rows.withColumn("names", pick(pool_map[F.col("pool")], 3)).withColumn("values", pick(F.transform(F.sequence(F.lit(0), F.col("n_entities") - 1), value), 5))
    same = (F.col("task") == "compare_equal") & (u(6) < 0.5)
    rows = rows.withColumn("values", F.when(same, F.array_repeat(F.element_at("values", 1), F.col("n_entities"))).otherwise(F.col("values")))
    claim_more, flip = u(7) < 0.5, u(8) < 0.5
    name = lambda i: F.element_at("names", i)
    val = lambda i: F.element_at("values", i)
    facts = F.transform(F.sequence(F.lit(1), F.col("n_entities")), lambda i: F.concat_ws(" ", F.element_at("names", i), F.col("poss"), F.col("noun"), F.element_at("values", i).cast("string"), F.col("unit"), F.lit("है।")))
    edge = lambda i: F.when((F.col("task") == "mixed_direction_chain") & (uniform(F.concat_ws("/", F.col("ex_id").cast("string"), i.cast("string")), seed + 9) < 0.5), F.concat(F.element_at("names", i + 1), F.lit(" "), F.col("poss"), F.lit(" "), F.col("noun"), F.lit(" "), F.element_at("names", i), F.lit(" से "), F.col("less"), F.lit(" है।"))).otherwise(F.concat(F.element_at("names", i), F.lit(" "), F.col("poss"), F.lit(" "), F.col("noun"), F.lit(" "), F.element_at("names", i + 1), F.lit(" से "), F.col("more"), F.lit(" है।")))
    links = F.transform(F.sequence(F.lit(1), F.col("n_entities") - 1), edge)
    shuffled = F.transform(F.array_sort(F.transform(F.when(F.col("fact_kind") == "value", facts).otherwise(links), lambda x: F.struct(rank_hash(F.concat_ws("/", F.col("ex_id").cast("string"), x), seed + 10).alias("h"), x.alias("x")))), lambda s: s["x"])
    ranked = F.array_sort(F.zip_with("values", "names", lambda v, x: F.struct(v.alias("v"), x.alias("x"))))
    ordered = F.transform(ranked, lambda s: s["x"])
    last = F.col("n_entities")
    t = F.col("task")
    pair = F.when(flip, F.concat(name(last), F.lit(" और "), name(1))).otherwise(F.concat(name(1), F.lit(" और "), name(last)))
    listing = F.array_join(F.array_sort("names"), ", ")
    word = F.when(t.rlike("less|smallest"), F.col("less")).when((t == "verify_claim") & ~claim_more, F.col("less")).otherwise(F.col("more"))
    ask = (
        F.when(t == "compare_equal", F.concat(F.lit("क्या दोनों "), F.col("noun"), F.lit(" एक बराबर हैं?")))
        .when(t == "numeric_difference", F.concat(F.lit("दोनों "), F.col("noun"), F.lit(" में कितना फ़र्क़ है?")))
        .when(t == "verify_claim", F.concat(F.lit("क्या यह सच है कि "), name(1), F.lit(" "), F.col("poss"), F.lit(" "), F.col("noun"), F.lit(" "), name(2), F.lit(" से "), word, F.lit(" है?")))
        .when(t == "middle_entity", F.concat(F.col("noun"), F.lit(" के क्रम में बीच का नाम कौन सा है?")))
        .when(t == "order_ascending", F.concat(F.col("noun"), F.lit(" के बढ़ते क्रम में नाम लिखिए?")))
        .when(t == "order_descending", F.concat(F.col("noun"), F.lit(" के घटते क्रम में नाम लिखिए?")))
        .when(t.rlike("relation|mixed"), F.concat(pair, F.lit(" की तुलना में किस "), F.col("poss"), F.lit(" "), F.col("noun"), F.lit(" ज़्यादा है?")))
        .otherwise(F.concat(F.lit("इनमें किस "), F.col("poss"), F.lit(" "), F.col("noun"), F.lit(" सबसे "), word, F.lit(" है: "), listing, F.lit("?")))
    )
    answer = (
        F.when(t == "compare_two_more", F.element_at(ordered, -1)).when(t == "compare_two_less", F.element_at(ordered, 1))
        .when(t == "compare_equal", F.when(val(1) == val(2), yes).otherwise(no))
        .when(t == "numeric_difference", F.concat_ws(" ", F.abs(val(1) - val(2)).cast("string"), F.col("unit")))
        .when(t == "verify_claim", F.when((val(1) > val(2)) == claim_more, yes).otherwise(no))
        .when(t == "middle_entity", F.element_at(ordered, 2)).when(t == "order_ascending", F.array_join(ordered, ", ")).when(t == "order_descending", F.array_join(F.reverse(ordered), ", "))
        .when(t.rlike("smallest"), name(last)).otherwise(name(1))
    )
    prompt = T.tidy(F.concat(F.array_join(shuffled, " "), F.lit(" "), ask))
    return rows.select("ex_id", "task", "fact_kind", "hops", "attribute", F.col("pool").alias("entity_pool"), "n_entities", "names", F.when(F.col("fact_kind") == "value", F.col("values")).alias("values"), prompt.alias("prompt"), answer.alias("answer"))


def wrapped(prompt: Column, question_label: Column, answer_label: Column) -> Column:
    """A prompt with its labels, unless it begins with the question label already."""
    return F.when(F.startswith(prompt, F.concat(question_label, F.lit(":"))), prompt).otherwise(F.concat(question_label, F.lit(": "), prompt, F.lit("\n"), answer_label, F.lit(": ")))


def labels_for(given: Column, defaults: dict[str, str]) -> Column:
    """A map of labels: the given ones over the defaults, null and empty ones left out."""
    base = F.create_map(*(F.lit(x) for kv in defaults.items() for x in kv))
    own = F.map_filter(F.coalesce(given, F.create_map().cast("map<string,string>")), lambda _, v: F.length(F.coalesce(v, F.lit(""))) > 0)
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k)), own)


def names_within(df: DataFrame, names: DataFrame, key: str, prompt: str, pool: str) -> DataFrame:
    """(key, name, place): the pool's names that stand at the start of a word in each prompt, first places from 0.

    names has (pool, name).  Of the names of a key that have the same first place only the longest count.

    Substrings at word starts that have a name's length and its bits in a bitmap of all names are joined with the
    names, so the work follows the prompts and the names and not their product.  The bitmap only leaves out what
    is no name: with far more names than MOST_BITS / 16 it leaves out less, which costs time and no result.
    """
    known = names.where(F.col(pool).isNotNull() & F.col("name").isNotNull()).select(pool, "name").distinct()
    have = known.agg(F.count("*").alias("n"), F.collect_set(F.octet_length("name")).alias("lengths")).first()
    bits = min(max((16 * have["n"]).bit_length(), 15), MOST_BITS)
    lengths = sorted(have["lengths"])

    def slots(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part, data, off in substrings.slices(batch, 1):
                h = substrings.Hashes(data).of(off[:-1], off[1:], part.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([substrings.slot(h, i, bits) for i in range(substrings.SLOTS)]))], ["slot"])

    parts = known.select(F.xxhash64(pool), "name").mapInArrow(slots, "slot long").groupBy(F.shiftright("slot", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(32767)).alias("bits"))
    table = np.zeros(1 << bits - 3, np.uint8)
    for r in parts.collect():
        table[r["part"] << 12 : r["part"] + 1 << 12] = np.frombuffer(r["bits"], np.uint8)
    bitmap = df.sparkSession.sparkContext.broadcast(table)
    fields = Y.StructType([df.schema[key], df.schema[pool], Y.StructField("name", Y.StringType()), Y.StructField("place", Y.IntegerType())])

    def find(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part, data, off in substrings.slices(batch, 3):
                text, place, found = substrings.candidates(data, off, part.column(2).to_numpy(zero_copy_only=False).view(np.uint64), WORD_BEGINS, lengths, bitmap.value, bits)
                at = pa.array(text, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(found, pa.binary()).view(pa.string()), pa.array(place, pa.int32())], fields.names)

    rows = df.where(F.col(prompt).isNotNull() & F.col(pool).isNotNull()).select(key, pool, F.xxhash64(pool), prompt)
    hits = rows.mapInArrow(find, fields).join(known, [pool, "name"], "left_semi").repartition(key)
    longest = F.max(F.length("name")).over(Window.partitionBy(key, "place"))
    return hits.select(key, "name", "place", longest.alias("_longest")).where(F.length("name") == F.col("_longest")).drop("_longest")


def fitting_prompt(df: DataFrame, task: str, length: str, order: str, preferred: list[str], most: int) -> DataFrame:
    """One row: the first prompt of a preferred task that fits, else the first that fits."""
    rank = F.when(F.col(task).isin(*preferred), 0).otherwise(1)
    return df.where(F.col(length) <= most).agg(F.min_by(F.struct(*df.columns), F.struct(rank, F.col(order))).alias("r")).where("r is not null").select("r.*")
