"""Generated reasoning examples, the phrase bank, vocabularies and files, against what they promise."""

import re

import pytest
from pyspark.sql import functions as F

from corpusloom import languages
from corpusloom.operators import bank, examples, ingest, metrics, reasoning, sequences, vocabulary
from corpusloom.sources import files

SHARES = {"train": 0.6, "val": 0.15, "test": 0.25}


def number(t):
    return int(t.translate(str.maketrans("०१२३४५६७८९", "0123456789")))


@pytest.mark.parametrize("lang", ["hi", "ne"])
def test_examples_follow_from_their_prompts(spark, lang):
    b = bank.default_bank(lang)
    n = {"train": 120, "val": 30, "test": 50}
    rows = examples.dataset(spark, b, n, 5, SHARES).collect()
    again = {r["id"]: r["text"] for r in examples.dataset(spark, b, n, 5, SHARES).collect()}
    assert {r["id"]: r["text"] for r in rows} == again and len(again) == 200
    assert len({r["prompt"] for r in rows}) == 200 and {s: sum(r["split"] == s for r in rows) for s in n} == n
    parts = bank.divided(b, SHARES, 5)
    for r in rows:
        assert r["text"] == r["prompt_text"] + r["target"] and r["target"].endswith(r["answer"]) and "{" not in r["text"] and "  " not in r["text"]
        assert set(r["names"]) <= set(parts[r["split"]].names[r["entity_pool"]])
        assert ("reasoning" if r["style"] == "cot" else "answer") and (r["reasoning"] in r["target"]) == (r["style"] == "cot")
        if r["fact_kind"] != "value":
            assert not re.search(r"[0-9०-९]", r["prompt"])
            continue
        facts = r["prompt"]
        found = {}
        for name in r["names"]:
            m = re.search(rf"(?:^|[\s।?,:]){name}[^।]*?([0-9०-९]+)", facts)
            found[name] = number(m.group(1))
        order = sorted(found, key=found.get)
        yes = found[order[0]] == found[order[-1]]
        want = {"compare_two_more": order[-1], "compare_two_less": order[0], "compare_equal": b.yes if yes else b.no, "middle_entity": order[len(order) // 2], "order_ascending": ", ".join(order), "order_descending": ", ".join(order[::-1])}
        if r["task"] in want:
            assert r["answer"] == want[r["task"]], r["text"]
        elif r["task"] == "numeric_difference":
            assert number(r["answer"].split()[0]) == found[order[-1]] - found[order[0]]
        else:
            x, y, word = r["asked"]
            assert r["answer"] == (b.yes if (found[x] > found[y]) == (word == "more") else b.no)
    df = examples.dataset(spark, b, n, 5, SHARES)
    assert examples.recomputed(df).where("not right").count() == 0
    assert examples.leakage(parts, df).where("not clean").count() == 0


def test_examples_under_limits(spark):
    b = bank.default_bank("hi")
    assert {r["task"] for r in examples.dataset(spark, b, {"train": 20}, 1, weights={t[0]: float(t[0] == "middle_entity") for t in reasoning.TASKS}).collect()} == {"middle_entity"}
    with pytest.raises(ValueError):
        examples.candidates(spark, {"train": b}, {"train": 1}, 1, weights={t[0]: 0 for t in reasoning.TASKS})
    with pytest.raises(ValueError):
        bank.divided(b._replace(names={"people": ["क", "ख"]}), SHARES, 1)
    tiny = b._replace(names={"people": b.names["people"][:2]}, words={"age": b.words["age"]})
    only = {t[0]: float(t[0] == "compare_two_more") for t in reasoning.TASKS}
    encoder = vocabulary.Encoder({}, {})
    assert examples.dataset(spark, b, {"train": 5}, 1, encoder=encoder, most_tokens=3, tries=1).count() == 0
    assert 0 < examples.dataset(spark, tiny._replace(templates={k: v[:1] for k, v in b.templates.items()}), {"train": 4}, 1, weights=only, shares={"train": 1.0}).count() <= 4 if len(b.names["people"][:2]) >= 5 else True


def test_templates_of_the_bank_are_valid(spark):
    for lang in ("hi", "ne"):
        b = bank.default_bank(lang)
        rows = spark.createDataFrame([(k, t) for k, v in b.templates.items() for t in v], "slot string, text string")
        probe = {k: "क" for k in "E A B C noun poss poss_obl whose howmuch unit copula cmp cmp_from cmp_to v vA vB d ordered answer".split()}
        got = rows.join(reasoning.slot_table(spark), "slot").select("slot", "text", reasoning.template_reason(F.col("text"), F.col("required"), F.col("allowed"), probe=probe).alias("r")).where("r is not null").collect()
        assert got == []


def test_template_rules_on_rendering(spark):
    rows = spark.createDataFrame([("{E} का {noun} {v} है", "ok"), ("{E} का {noun} {v} ॐ", "unknown")], "text string, want string")
    must = F.array(*(F.lit(x) for x in ("E", "noun", "v")))
    rule = lambda **how: {r["want"]: r["x"] for r in rows.select("want", reasoning.template_reason(F.col("text"), must, must, **how).alias("x")).collect()}
    probe = {"E": "क", "noun": "क", "v": "क"}
    assert rule(probe=probe, characters="कहैा") == {"ok": None, "unknown": "unknown characters"}
    assert rule(probe={"E": "क", "noun": "क"})["ok"] == "does not render"


def test_vocabulary(spark):
    vocab = spark.createDataFrame([("hi", 1, "<unk>", None, None), ("hi", 4, "▁", None, None), ("hi", 5, "a", None, None), ("hi", 6, "b", None, None), ("hi", 7, "▁a", "▁", "a"), ("hi", 8, "ab", "a", "b")], "lang string, token_id int, piece string, left_piece string, right_piece string")
    known = vocabulary.encoders(vocab)
    rows = spark.createDataFrame([(0, "ab  b", "hi"), (1, "xb", None), (2, None, "hi"), (3, "", "en"), (4, "a" * 2000, "hi")], "k int, t string, l string")
    got = {r["k"]: r["ids"] for r in rows.select("k", vocabulary.token_ids(known, F.col("t"), F.col("l")).alias("ids")).collect()}
    assert got[0] == [7, 6, 4, 6] and got[1] == [4, 1, 6] and got[2] == got[3] == [] and got[4] == [7] + [5] * 1999
    assert [tuple(r) for r in vocabulary.first_unknown(rows, vocab, "k", "t", "l").collect()] == [(1, "x", 0, 1)]
    assert vocabulary.encoders(vocab.limit(0)) == {}


def test_scores_inside_the_row(spark):
    rows = spark.createDataFrame([(0, list("abcd"), list("abd")), (1, [], ["a"]), (2, None, None)], "k int, a array<string>, b array<string>")
    assert [r["x"] for r in rows.orderBy("k").select(metrics.lcs("a", "b").alias("x")).collect()] == [3, 0, 0]
    got = {(r["k"], r["n"]): (r["matched"], r["n_hyp"], r["n_ref"]) for r in metrics.matches(rows, "k", "a", "b", 2).collect()}
    assert got == {(0, 1): (3, 3, 4), (0, 2): (1, 2, 3), (1, 1): (0, 1, 0), (1, 2): (0, 0, 0), (2, 1): (0, 0, 0), (2, 2): (0, 0, 0)}
    assert metrics.bleu(rows.limit(0), "k", "a", "b").first()["bleu"] == 0.0


def test_continued_sequences(spark):
    rows = spark.createDataFrame([(n, list(range(n))) for n in (9, 10, 11, 40, 400)], "k int, ids array<int>")
    got = {r["k"]: (len(r["prefix"]), len(r["reference"])) for r in sequences.continued(rows, "k", "ids", 30).collect()}
    assert got == {10: (5, 5), 11: (5, 6), 40: (20, 20), 400: (20, 100)}


def test_names_and_labels(spark):
    names = spark.createDataFrame([("p", "राम"), ("p", "राम लाल"), ("p", "सीता"), ("q", "राम"), ("p", None)], "pool string, name string")
    rows = spark.createDataFrame([(1, "राम लाल और सीता। आराम", "p"), (2, "राम", "q"), (3, None, "p"), (4, "आराम", "p")], "k int, prompt string, pool string")
    got = sorted((r["k"], r["name"], r["place"]) for r in reasoning.names_within(rows, names, "k", "prompt", "pool").collect())
    assert got == [(1, "राम लाल", 0), (1, "सीता", 11), (2, "राम", 0)]


def test_names_of_odd_rows(spark):
    duckdb = pytest.importorskip("duckdb")
    import random

    from corpusloom.plans import evaluation

    draw = random.Random(5)
    word = lambda: "".join(draw.choice(["र", "ा", "म", "a", "€", "😀"]) for _ in range(draw.randint(1, 3)))
    texts = [None, "", " ", "।", "राम", "राम।राम", " राम  राम", "आराम", "x\nराम,राम काका:राम?"] + ["".join(word() + draw.choice(" ।?,:\n-") * draw.randint(0, 2) for _ in range(draw.randint(1, 12))) for _ in range(300)]
    answers = [None, "", " ", "राम", "राम काका", "। ", "राम।र", "x" * 3000] + [word() for _ in range(60)] + [word() + " " + word() for _ in range(20)]
    rows = [(i // 2 if i % 7 else None, draw.choice(["p", "q", "", None]), t, draw.choice(answers), draw.choice(["relation", "relation", "value", None])) for i, t in enumerate(texts * 2)]
    rows += [(900, "p", "राम काका", "राम काका", "relation"), (900, "p", "राम", "राम", "relation"), (901, "r", "y" * 5000 + " " + "x" * 3000, "x" * 3000, "relation")]
    df = spark.createDataFrame(rows, "ex_id long, entity_pool string, prompt string, answer string, fact_kind string")
    r, names = df, df.where("fact_kind = 'relation' and answer is not null").select("entity_pool", F.col("answer").alias("name")).distinct()
    found = reasoning.names_within(r, names, "ex_id", "prompt", "entity_pool").groupBy("ex_id").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    c = duckdb.connect()
    c.register("given", df.toPandas())
    c.sql("create view reasoning as select ex_id::bigint as ex_id, * exclude (ex_id) from given")
    want = {x[0]: x[1:] for x in c.sql("select ex_id, n, first from (" + evaluation.SQL["pool_names"] + ")").fetchall()}
    assert len(want) > 100 and {x["ex_id"]: (x["n"], x["first"]) for x in found.collect()} == want
    for nothing in (names.limit(0), names.where("name is null")):
        assert reasoning.names_within(r, nothing, "ex_id", "prompt", "entity_pool").count() == 0
    assert reasoning.names_within(r.limit(0), names, "ex_id", "prompt", "entity_pool").count() == 0


def test_names_cost_no_product_of_prompts_and_names(spark):
    import time

    def took(n):
        names = spark.range(n).select(F.lit("p").alias("pool"), F.concat(F.lit("नाम"), F.hex("id"), F.lit(" क")).alias("name")).cache()
        rows = spark.range(2000).select(F.col("id").alias("k"), F.concat(F.lit("का दाम नाम"), F.hex("id"), F.lit(" क नाम"), F.hex(F.col("id") + 1), F.lit(" कसे ज़्यादा है।")).alias("prompt"), F.lit("p").alias("pool")).cache()
        assert names.count() == n and rows.count() == 2000
        begin = time.monotonic()
        got = reasoning.names_within(rows, names, "k", "prompt", "pool").count()
        assert got == sum(i < n for k in range(2000) for i in (k, k + 1))
        return time.monotonic() - begin

    few = min(took(100), took(100))
    assert took(10_000) < 4 * few + 10



def test_ingest_helpers(spark):
    m = spark.createDataFrame([("a",), ("b",), (None,)], "name string")
    assert {r["name"] for r in ingest.without_skipped(m, ["a"]).collect()} == {"b", None} and ingest.without_skipped(m, []).count() == 3
    listing = spark.createDataFrame([("hi", "x/step_10/m"), ("hi", "x/step_9/m"), ("ne", "x/checkpoint-4"), ("en", "x/readme")], "lang string, path string")
    got = {r["lang"]: r["path"] for r in ingest.newest_file(listing, ["lang"]).collect()}
    assert got == {"hi": "x/step_10/m", "ne": "x/checkpoint-4"}
    pointers = spark.createDataFrame([("hi", "x/step_9/m"), ("ne", "gone")], "lang string, path string")
    assert {r["lang"]: r["path"] for r in ingest.newest_file(listing, ["lang"], pointers=pointers).collect()} == {"hi": "x/step_9/m", "ne": "x/checkpoint-4"}


def test_files_and_languages(spark, tmp_path):
    (tmp_path / "val.jsonl").write_text('{"id": "b", "text": "2"}\n{"id": "a", "text": "1"}\n')
    assert [r["id"] for r in files.read_split(spark, str(tmp_path), "val", 1).collect()] == ["a"] and files.read_split(spark, str(tmp_path), "val").count() == 2
    assert files.read_shards(spark, []).count() == 0
    rows = spark.createDataFrame([(1, "a|b\nc"), (2, None)], "k int, v string")
    files.write_report(rows, str(tmp_path / "r.md"), form="markdown")
    assert (tmp_path / "r.md").read_text().splitlines() == ["| k | v |", "| - | - |", r"| 1 | a\|b c |", "| 2 |  |"]
    files.write_report(rows.limit(1), str(tmp_path / "r.txt"), form="text")
    assert (tmp_path / "r.txt").read_text() == "k: 1\nv: a|b\nc\n"
    (tmp_path / "c.json").write_text('{"a": {"b": 1}}')
    assert files.merged_config(files.read_config(str(tmp_path / "c.json")), {"a": {"c": 2}}) == {"a": {"b": 1, "c": 2}}
    assert languages.get("HINDI").key == "hi" and languages.table(spark).count() == 2
    with pytest.raises(KeyError):
        languages.get("xx")


def test_intermediates_are_deleted_and_need_a_shared_folder(spark, tmp_path):
    import os

    from corpusloom import session

    session.forget(spark)
    df = session.materialise(spark.range(5))
    path = session._WRITTEN[-1].removeprefix("file:")
    assert df.count() == 5 and os.path.isdir(path)
    assert session.forget(spark) == 1 and not os.path.exists(path)

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), type("C", (), {"get": staticmethod(lambda k, d: d)})

    with pytest.raises(ValueError):
        session.shared_dir(Session())


def test_crawl_limits_and_sitemaps(spark):
    from corpusloom.operators import web

    pages = spark.createDataFrame([(f"https://s.example/{i}", f'<a href="/{i + 1}">x</a><a href="/{i + 100}">y</a>') for i in range(70)], "url string, html string")
    seeds = spark.createDataFrame([("https://s.example/0",)], "url string")
    depths = {r["url"]: r["depth"] for r in web.crawl(pages, seeds, most_rounds=3).collect()}
    assert max(depths.values()) == 3 and len(depths) == 7
    assert web.crawl(pages, seeds, most_pages=4).count() == 4
    assert web.crawl(pages, seeds.limit(0)).count() == 0
    xml = "<urlset><url><loc> https://s.example/a?x=1&amp;y=2 </loc></url><url><LOC>https://s.example/b</LOC></url></urlset>"
    got = spark.createDataFrame([(xml,), (None,)], "x string").select(web.sitemap_urls(F.col("x")).alias("u")).collect()
    assert [r["u"] for r in got] == [["https://s.example/a?x=1&y=2", "https://s.example/b"], None]


def test_shuffled_keeps_all_rows_in_another_order(spark):
    from corpusloom.operators import splits

    got = [r["k"] for r in splits.shuffled(spark.range(500).withColumnRenamed("id", "k"), "k", buckets=8).collect()]
    assert sorted(got) == list(range(500)) and got != sorted(got)
    assert splits.shuffled(spark.range(0).withColumnRenamed("id", "k"), "k").count() == 0
