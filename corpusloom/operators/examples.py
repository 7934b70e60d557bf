"""Reasoning examples to the end: facts, question, steps, answer, and the text a model is trained on.

Each candidate is a pure function of seed, language, split and number, so tasks make them in any order and again
after a loss.  Repeated prompts and texts over the length are left out afterwards, over all splits at once, and
each split keeps its first ``n``.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialise
from .bank import Bank, divided
from .ordered import row_index
from .reasoning import ATTRIBUTES, TASKS

_DIGITS = str.maketrans("0123456789", "०१२३४५६७८९")
_PLACE = re.compile(r"\{(\w+)\}")
_GAP = re.compile(r"\s+([।?,])|\s+")
SCHEMA = pa.schema([
    ("number", pa.int64()), ("lang", pa.string()), ("split", pa.string()), ("task", pa.string()), ("fact_kind", pa.string()), ("hops", pa.int32()), ("style", pa.string()), ("attribute", pa.string()), ("entity_pool", pa.string()),
    ("n_entities", pa.int32()), ("names", pa.list_(pa.string())), ("values", pa.list_(pa.int64())), ("asked", pa.list_(pa.string())), ("prompt", pa.string()), ("reasoning", pa.string()), ("answer", pa.string()), ("prompt_text", pa.string()), ("target", pa.string()),
    ("answer_label", pa.string()), ("text", pa.string()), ("n_tokens", pa.int32()),
])
_DDL = "number long, lang string, split string, task string, fact_kind string, hops int, style string, attribute string, entity_pool string, n_entities int, names array<string>, values array<long>, asked array<string>, prompt string, reasoning string, answer string, prompt_text string, target string, answer_label string, text string, n_tokens int"


class Scene:
    """One example's choices: attribute, names in falling order, their values, and how sentences are worded."""

    def __init__(self, rng: random.Random, bank: Bank, n: int, valued: bool, equal: bool = False):
        self.rng, self.bank = rng, bank
        self.attribute, self.pool, low, high, step = rng.choice([a for a in ATTRIBUTES if a[0] in bank.words and a[1] in bank.names])
        self.words = bank.words[self.attribute]
        self.names = rng.sample(bank.names[self.pool], n)
        # two steps apart at least: distinct cells of a grid twice as coarse
        cells = sorted(rng.sample(range((high - low) // (2 * step) + 1), n), reverse=True)
        values = [low + 2 * step * c for c in cells]
        self.values = [values[0]] * n if equal else values if valued else []
        self.asked: list[str] = []

    def number(self, v: int) -> str:
        return str(v).translate(_DIGITS) if self.bank.devanagari else str(v)

    def say(self, slot: str, **extra) -> str:
        """A wording of the slot with its placeholders filled."""
        filled = self.words | {k: self.number(v) if isinstance(v, int) else v for k, v in extra.items()}
        wording = self.rng.choice(self.bank.templates[slot])
        return _GAP.sub(lambda m: m.group(1) or " ", _PLACE.sub(lambda m: filled.get(m.group(1), ""), wording)).strip()

    def mixed(self, items: list) -> list:
        return self.rng.sample(items, len(items))

    def coin(self) -> bool:
        return self.rng.random() < 0.5

    def pair(self, i: int, j: int) -> tuple[str, str]:
        self.asked = self.mixed([self.names[i], self.names[j]])
        return tuple(self.asked)


Told = tuple[list[str], list[str]]
Asked = tuple[str, list[str], str]


def _stated(s: Scene) -> Told:
    """Every value is a fact; the steps note them."""
    known = list(zip(s.names, s.values))
    return s.mixed([s.say("fact", E=e, v=v) for e, v in known]), [s.say("fact_step", E=e, v=v) for e, v in s.mixed(known)]


def _chained(s: Scene, turned: bool, first: int, last: int) -> Told:
    """Neighbours are compared, some from below if ``turned``; the steps set these right and go from first to last."""
    w, facts, steps, right = s.words, [], [], set()
    for k, (up, down) in enumerate(zip(s.names, s.names[1:])):
        if turned and s.coin():
            facts.append(s.say("rel_fact", A=down, B=up, cmp=w["less"]))
            steps.append(s.say("flip_step", A=down, B=up, cmp_from=w["less"], cmp_to=w["more"]))
            right.add(k)
        else:
            facts.append(s.say("rel_fact", A=up, B=down, cmp=w["more"]))
    steps += [s.say("rel_step", A=s.names[k], B=s.names[k + 1], cmp=w["more"]) for k in range(first, last) if k not in right]
    steps += [s.say("deduce_step", A=s.names[first], B=s.names[k], C=s.names[k + 1], cmp=w["more"]) for k in range(first + 1, last)]
    return s.mixed(facts), steps


def _which(s: Scene, i: int, j: int, more: bool) -> tuple[str, str]:
    a, b = s.pair(i, j)
    return s.say("q_which_of_two", A=a, B=b, cmp=s.words["more" if more else "less"]), s.names[i if more else j]


def _ordered(s: Scene, up: bool) -> Asked:
    names = s.names[::-1] if up else s.names
    low, high = s.words["less"], s.words["more"]
    listed = ", ".join(names)
    return s.say("q_ordering", cmp_from=low if up else high, cmp_to=high if up else low), [s.say("order_step", ordered=listed)], listed


def _value_question(s: Scene, task: str) -> Asked:
    """Question, closing steps and answer of the tasks over stated values."""
    top = lambda: s.say("rel_step", A=s.names[0], B=s.names[1], cmp=s.words["more"])
    if task.startswith("order"):
        return _ordered(s, task == "order_ascending")
    if task == "middle_entity":
        return s.say("q_middle"), [s.say("order_step", ordered=", ".join(s.names))], s.names[1]
    if task == "numeric_difference":
        d = s.values[0] - s.values[1]
        s.asked = s.names[:2]
        return s.say("q_difference", A=s.names[0], B=s.names[1], cmp=s.words["more"]), [s.say("diff_step", vA=s.values[0], vB=s.values[1], d=d)], f"{s.number(d)} {s.words['unit']}"
    if task == "compare_equal":
        a, b = s.pair(0, 1)
        same = s.values[0] == s.values[1]
        return s.say("q_equality", A=a, B=b), [s.say("equal_step", A=a, B=b, v=s.values[0]) if same else top()], s.bank.yes if same else s.bank.no
    if task == "verify_claim":
        a, b = s.pair(0, 1)
        more = s.coin()
        s.asked = [a, b, "more" if more else "less"]
        return s.say("q_verify", A=a, B=b, cmp=s.words["more" if more else "less"]), [top()], s.bank.yes if (a == s.names[0]) == more else s.bank.no
    question, answer = _which(s, 0, 1, task == "compare_two_more")
    return question, [top()], answer


def _relation(s: Scene, task: str) -> tuple[list[str], str, list[str], str]:
    turned, n = task.startswith("mixed"), len(s.names)
    if task.endswith("relation") or turned and s.coin():
        first, last = s.rng.choice([(i, j) for i in range(n) for j in range(i + 2, n)])
        facts, steps = _chained(s, turned, first, last)
        question, answer = _which(s, first, last, s.coin())
    else:
        more = s.coin() if turned else task.endswith("largest")
        facts, steps = _chained(s, turned, 0, n - 1)
        question, answer = s.say("q_extreme", cmp=s.words["more" if more else "less"]), s.names[0 if more else -1]
    return facts, question, steps, answer


#: Task -> numbers of names. A task of one's own needs an entry here and in ``make``'s ``tasks``.
SIZES = {"middle_entity": (3,), "order_ascending": (3, 4), "order_descending": (3, 4), "transitive_relation": (3,), "transitive_largest": (3,), "transitive_smallest": (3,), "chain_relation": (4, 5), "chain_largest": (4, 5), "chain_smallest": (4, 5), "mixed_direction_chain": (3, 4, 5)}


def example(rng: random.Random, bank: Bank, task: tuple, direct: float, number: int, split: str) -> dict:
    """One example of a task (name, kind of facts, hops, weight); without steps for the share ``direct``."""
    name, kind, hops, _ = task
    valued = kind == "value"
    s = Scene(rng, bank, rng.choice(SIZES.get(name, (2,))), valued, name == "compare_equal" and rng.random() < 0.5)
    if valued:
        facts, steps = _stated(s)
        question, closing, answer = _value_question(s, name)
        steps += closing
    else:
        facts, question, steps, answer = _relation(s, name)
    steps.append(s.say("conclusion_step", answer=answer))
    prompt, reasoning = " ".join([*facts, question]), " ".join(steps)
    label = bank.labels
    told = rng.random() >= direct
    head = f"{label['question']}: {prompt}\n{label['reasoning' if told else 'answer']}:"
    target = f" {reasoning}\n{label['answer']}: {answer}" if told else f" {answer}"
    return {
        "number": number, "lang": bank.lang, "split": split, "task": name, "fact_kind": kind, "hops": hops, "style": "cot" if told else "direct", "attribute": s.attribute, "entity_pool": s.pool, "n_entities": len(s.names), "names": s.names,
        "values": s.values or None, "asked": s.asked or None, "prompt": prompt, "reasoning": reasoning, "answer": answer, "prompt_text": head, "target": target, "answer_label": label["answer"], "text": head + target,
    }


def candidates(spark: SparkSession, banks: dict[str, Bank], numbers: dict[str, int], seed: int, tasks: tuple = TASKS, weights: dict[str, float] | None = None, direct: float = 0.2, encoder=None) -> DataFrame:
    """The first ``numbers`` candidates of each split; weights replace those of the tasks (0 leaves a task out)."""
    chosen = [(t, w) for t in tasks if (w := (weights or {}).get(t[0], t[3])) > 0]
    if not chosen:
        raise ValueError("every task's weight is 0")
    kinds, odds = [t for t, _ in chosen], [w for _, w in chosen]
    grid = None
    for split, n in numbers.items():
        part = spark.range(n).select(F.lit(split).alias("split"), F.col("id").alias("number"))
        grid = part if grid is None else grid.union(part)

    def make(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            out = []
            for split, number in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                bank = banks[split]
                rng = random.Random(f"{seed}/{bank.lang}/{split}/{number}")
                e = example(rng, bank, rng.choices(kinds, odds)[0], direct, number, split)
                e["n_tokens"] = len(encoder.encode(e["text"])) if encoder is not None else None
                out.append(e)
            yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)

    return grid.mapInArrow(make, _DDL)


def dataset(spark: SparkSession, bank: Bank, n: dict[str, int], seed: int, shares: dict[str, float] | None = None, most_tokens: int | None = None, encoder=None, tries: int = 60, **how) -> DataFrame:
    """n[split] examples of each split, with ids; no prompt occurs twice, in one split or over splits.

    Of equal prompts the one of the earlier split (in the order of n) and lower number stays.  Candidates are made
    half as many again as wanted, then twice as many, up to ``tries`` a wanted one; a bank that can't express so
    many prompts gives fewer examples.
    """
    banks = divided(bank, shares or {s: 1.0 for s in n}, seed)
    rank = F.create_map(*(x for i, s in enumerate(n) for x in (F.lit(s), F.lit(i))))
    made = {s: k + k // 2 + 20 for s, k in n.items()}
    while True:
        rows = candidates(spark, banks, made, seed, encoder=encoder, **how)
        if most_tokens is not None:
            rows = rows.where(F.col("n_tokens").isNull() | (F.col("n_tokens") <= most_tokens))
        key = T.tidy(F.col("prompt"))
        first = F.struct(rank[F.col("split")].alias("r"), "number")
        kept = rows.groupBy(F.xxhash64(key).alias("_k"), F.md5(key).alias("_m")).agg(F.min_by(F.struct(*rows.columns), first).alias("e")).select("e.*")
        kept = materialise(kept)
        have = {r["split"]: r["count"] for r in kept.groupBy("split").count().collect()}
        short = [s for s, k in n.items() if have.get(s, 0) < k and made[s] < tries * k + 2000]
        if not short:
            break
        made = {s: min(2 * k, tries * n[s] + 2000) if s in short else k for s, k in made.items()}
    out = None
    for split, k in n.items():
        part = row_index(kept.where(F.col("split") == split), ["number"], "_i").where(F.col("_i") < k)
        part = part.withColumn("id", F.concat(F.lit(f"{bank.lang}-{split}-"), F.lpad(F.col("_i").cast("string"), 8, "0"))).drop("_i", "number")
        out = part if out is None else out.unionByName(part)
    return out


def recomputed(df: DataFrame) -> DataFrame:
    """(id, task, right): whether each answer follows from the stored facts, computed by sorting or by walking the chain anew."""
    facts = F.array_sort(F.zip_with("values", "names", lambda v, x: F.struct(v.alias("v"), x.alias("x"))))
    up = F.transform(facts, lambda f: f["x"])
    said = lambda x: F.array_contains("asked", x)
    digits = F.translate("answer", "०१२३४५६७८९", "0123456789")
    t, first, last = F.col("task"), F.element_at("names", 1), F.element_at("names", -1)
    asked = F.array_sort(F.transform("asked", lambda x: F.array_position("names", x)))
    ends = [F.element_at("names", F.element_at(asked, k).cast("int")) for k in (1, -1)]
    right = (
        F.when(t == "compare_two_more", F.col("answer") == F.element_at(up, -1)).when(t == "compare_two_less", F.col("answer") == F.element_at(up, 1))
        .when(t == "compare_equal", (F.array_max("values") == F.array_min("values")) == F.col("answer").isin("हाँ", "हो"))
        .when(t == "numeric_difference", F.regexp_extract(digits, "^[0-9]+", 0).cast("long") == F.array_max("values") - F.array_min("values"))
        .when(t == "verify_claim", ((F.element_at("values", F.array_position("names", F.col("asked")[0]).cast("int")) > F.element_at("values", F.array_position("names", F.col("asked")[1]).cast("int"))) == (F.col("asked")[2] == "more")) == F.col("answer").isin("हाँ", "हो"))
        .when(t == "middle_entity", F.col("answer") == F.element_at(up, 2)).when(t == "order_ascending", F.col("answer") == F.array_join(up, ", ")).when(t == "order_descending", F.col("answer") == F.array_join(F.reverse(up), ", "))
        .when(F.col("asked").isNotNull(), said(F.col("answer")) & ((F.col("answer") == ends[0]) | (F.col("answer") == ends[1])) & (F.element_at(asked, -1) - F.element_at(asked, 1) >= 2))
        .when(t.endswith("largest"), F.col("answer") == first).when(t.endswith("smallest"), F.col("answer") == last).otherwise((F.col("answer") == first) | (F.col("answer") == last))
    )
    shown = F.aggregate(F.transform("names", lambda x: F.instr(F.col("prompt"), x) > 0), F.lit(True), lambda a, b: a & b)
    return df.select("id", "task", (F.coalesce(right, F.lit(False)) & shown & F.endswith(F.col("target"), F.col("answer"))).alias("right"))


def leakage(banks: dict[str, Bank], rows: DataFrame) -> DataFrame:
    """(axis, part_a, part_b, n_shared, clean): names, divided wordings and prompts that two splits share."""
    from .bank import DIVIDED
    from .reports import shared

    spark = rows.sparkSession
    values = [(s, "names", f"{p}/{x}") for s, b in banks.items() for p, v in b.names.items() for x in v] + [(s, "templates", f"{k}/{x}") for s, b in banks.items() for k in DIVIDED for x in b.templates.get(k, ())]
    every = spark.createDataFrame(values, "split string, axis string, value string").unionByName(rows.select("split", F.lit("prompts").alias("axis"), T.prompt_key(F.col("prompt")).alias("value")))
    parts = [shared(every.where(F.col("axis") == axis), "split", F.col("value")).select(F.lit(axis).alias("axis"), "part_a", "part_b", F.col("n").alias("n_shared")) for axis in ("names", "templates", "prompts")]
    return parts[0].union(parts[1]).union(parts[2]).withColumn("clean", F.col("n_shared") == 0)
