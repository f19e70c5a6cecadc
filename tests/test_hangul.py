import random

from pyspark.sql import functions as F

from onggi.functions import hangul
from onggi.functions.hangul import FINALS, INITIALS, VOWELS


def test_every_syllable_comes_apart_and_back(spark):
    df = spark.range(0xAC00, 0xD7A4).select(F.col("id").alias("cp"), F.element_at(hangul.letters_of(hangul._SYLLABLES), (F.col("id") - 0xAC00 + 1).cast("int")).alias("c"))
    rows = df.select("cp", "c", hangul.initial_of(F.col("c")).alias("i"), hangul.vowel_of(F.col("c")).alias("v"), hangul.final_of(F.col("c")).alias("f")).withColumn("back", hangul.compose(F.col("i"), F.col("v"), F.col("f"))).collect()
    assert len(rows) == 11172
    for r in rows:
        assert r.c == chr(r.cp) == r.back
        assert (r.i, r.v, r.f) == ((r.cp - 0xAC00) // 588, (r.cp - 0xAC00) % 588 // 28, (r.cp - 0xAC00) % 28)


def test_bounds_and_other_characters(spark):
    df = spark.createDataFrame([("가",), ("힣",), ("꯿",), ("힤",), ("a",), ("ㄱ",), ("",), ("😀",)], "c string")
    assert [r[0] for r in df.select(hangul.is_syllable(F.col("c"))).collect()] == [True, True, False, False, False, False, False, False]


def _compose(s: str) -> str:
    """The rule as a scan."""
    out, i = [], 0
    while i < len(s):
        if s[i] in INITIALS and i + 1 < len(s) and s[i + 1] in VOWELS:
            f, step = 0, 2
            if i + 2 < len(s) and s[i + 2] in FINALS[1:] and not (i + 3 < len(s) and s[i + 3] in VOWELS):
                f, step = FINALS.index(s[i + 2]), 3
            out.append(chr(0xAC00 + (INITIALS.index(s[i]) * 21 + VOWELS.index(s[i + 1])) * 28 + f))
            i += step
        else:
            out.append(s[i])
            i += 1
    return "".join(out)


def test_composition_equals_the_scan(spark):
    rng = random.Random(1)
    alphabet = "ㄱㄴㄸㅃㅉㅏㅑㅣㄳㅄ가a "
    texts = ["", None, "ㅎㅏㄴㄱㅡㄹ", "ㅇㅓㅄㄷㅏ", "ㄱㅏㄴㅏ"] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(hangul.compose_text(F.col("t"))).collect()]
    assert got == [None if t is None else _compose(t) for t in texts]
    assert got[2:5] == ["한글", "없다", "가나"]


def test_patterns_and_their_limit(spark):
    df = spark.createDataFrame([("각나",), ("가" * 16,), ("가" * 17,), ("abc",), (None,)], "t string")
    rows = df.select(*[hangul.pattern(k, F.col("t"), 16).alias(k) for k in hangul.KINDS]).collect()
    assert tuple(rows[0]) == ("<CHO:ㄱㄴ>", "<JUNG:ㅏㅏ>", "<JONG:ㄱ_>")
    assert rows[1].CHO is not None and all(tuple(r) == (None, None, None) for r in rows[2:])
