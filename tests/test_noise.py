import pytest
from pyspark.sql import functions as F

from onggi.functions import draws, hangul
from onggi.operators import noise

TEXT = "나는 학교에 갔다. Hello 의사와 여행, 않돼요!"


def one(spark, f, text=TEXT, key="k"):
    df = spark.createDataFrame([(key, text)], "k string, t string")
    return df.select(f(F.col("t"), draws.base(1, F.col("k"))).alias("x")).first().x


@pytest.mark.parametrize("f", [noise.vowel, noise.consonant, noise.final, noise.jamo, noise.light_spacing, noise.pronunciation])
def test_no_noise_is_the_identity(spark, f):
    assert one(spark, lambda t, b: f(t, b, 0.0)) == TEXT
    assert one(spark, lambda t, b: f(t, b, 0.5), "") == ""
    assert one(spark, lambda t, b: f(t, b, 0.5), None) is None


def test_full_noise_changes_every_eligible_character(spark):
    assert one(spark, lambda t, b: noise.jamo(t, b, 1.0), "한a글") == "ㅎㅏㄴaㄱㅡㄹ"
    assert one(spark, lambda t, b: noise.vowel(t, b, 1.0), "개네") == "게내"
    assert one(spark, lambda t, b: noise.consonant(t, b, 1.0), "나사") == "라싸"
    assert one(spark, lambda t, b: noise.spacing(t, b, 1.0, 0.0), "가 나\t다") == "가나다"
    assert one(spark, lambda t, b: noise.spacing(t, b, 0.0, 1.0), "가나. 다") == "가 나. 다"
    assert one(spark, lambda t, b: noise.pronunciation(t, b, 1.0), "왜 돼") == "외 돼"


def test_rates_are_near_their_probability(spark):
    df = spark.createDataFrame([(i, "가" * 200) for i in range(200)], "k int, t string")
    out = df.select(noise.jamo(F.col("t"), draws.base(3, F.col("k")), 0.12).alias("x")).select(F.sum(F.length("x")).alias("n")).first().n
    assert abs((out - 40_000) / 40_000 - 0.12) < 0.01


def test_results_do_not_depend_on_partitions_or_order(spark):
    rows = [(i, f"안녕하세요 세계 {i} 학교", None, "답") for i in range(60)]
    df = spark.createDataFrame(rows, "rec_id int, instruction string, input string, output string")
    a = {r.pair_id: r.noisy_instruction for r in noise.noisy_pairs(df.repartition(1)).collect()}
    b = {r.pair_id: r.noisy_instruction for r in noise.noisy_pairs(df.orderBy(F.desc("rec_id")).repartition(7)).collect()}
    assert a == b and a


def test_pair_filters(spark):
    rows = [(1, None, None, "답"), (2, "질문이다", "", ""), (3, "가", None, "답"), (4, "나" * 5000, None, "답"), (5, "abcd", None, "답"), (6, "질문이다", None, "답")]
    df = spark.createDataFrame(rows, "rec_id int, instruction string, input string, output string")
    kept = noise.noisy_pairs(df, keep_unchanged=True, all_types=True).groupBy("rec_id").count().collect()
    assert {r.rec_id: r["count"] for r in kept} == {5: 5, 6: 5}
    with pytest.raises(ValueError):
        noise.noisy_pairs(df, noise_types=("nothing",))


def test_jamo_substitution_counts_and_copies(spark):
    df = spark.createDataFrame([(1, "한글 abc", None, "답")], "rec_id int, instruction string, input string, output string")
    r = noise.substitute_jamo(df, input_ratio=1.0).first()
    assert (r.instruction, r.instruction_hangul, r.instruction_changed, r.input, r.jamo_changed) == ("ㅎㅏㄴㄱㅡㄹ abc", 2, 2, "", True)
    copies = noise.substitute_jamo(df, input_ratio=1.0, clean_copies=True).orderBy("copy").collect()
    assert [(c.copy, c.instruction, c.jamo_substitution) for c in copies] == [(0, "한글 abc", False), (1, "ㅎㅏㄴㄱㅡㄹ abc", True)]
    with pytest.raises(ValueError):
        noise.substitute_jamo(df, input_ratio=1.5)


def test_composition_undoes_jamo_noise_without_ambiguity(spark):
    assert one(spark, lambda t, b: hangul.compose_text(noise.jamo(t, b, 1.0)), "한글 없다") == "한글 없다"
