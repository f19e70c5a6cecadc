import unicodedata

import pytest

from onggi.llm import lookalikes as lk

CASES = [
    ("привет", 0), ("Ехрlаіn", 1), ("x̄ 3×4 ½컵 №7 ① 5㎏ m²", 0), ("❤️ 👨‍👩‍👧 모임", 0), ("café", 0), ("café", 1), ("a​b", 1), ("理", 0), ("理", 1), ("서술하세요．", 1),
    (unicodedata.normalize("NFD", "한글"), 1), ("ㅋㅋㅋ ㅁㅏㄹ", 0), ("α = 0.05 β", 0), ("СРС온도", 1), ("спасибо라", 0), ("a b", 1), ("a\tb\r\n", 0), ("a\x00", 1), ("große Übung", 0), ("aㅤ", 1), ("", 0), ("カタカナ、漢字。", 0),
]


@pytest.mark.parametrize(("text", "expected"), CASES)
def test_values(text, expected):
    assert lk.stands_for_another(text) == bool(expected)


def test_skeletons():
    assert lk.skeleton("Ехрlаіn") == "Explain" and lk.skeleton("ｘ　y") == "x y" and lk.skeleton("a​b") == "ab"
    assert lk.skeleton("한글") == lk.skeleton(unicodedata.normalize("NFD", "한글")) != lk.skeleton("한국")
    for t, _ in CASES:
        assert lk.skeleton(lk.skeleton(t)) == lk.skeleton(t)


def test_tables(spark):
    df = spark.createDataFrame([(1, "a b", None), (2, "a b", "привет"), (2, "a b", ""), (3, None, "x" * 20000 + "​")], "rec_id int, instruction string, input string")
    got = {(r.row_key, r.field_name) for r in lk.lookalike_values(df, "rec_id", ["instruction", "input"], "t").collect()}
    assert got == {("1", "instruction"), ("3", "input")}
    groups = lk.skeleton_groups(lk.skeletons(df, "rec_id", ["instruction"], "t")).collect()
    assert [(r.n_forms, r.n_values) for r in groups] == [(2, 3)]
    assert lk.lookalike_values(df.limit(0), "rec_id", ["input"], "t").count() == 0


@pytest.mark.parametrize(("text", "expected"), [("А등급", 1), ("2О24년", 1), ("Ε열", 1), ("2ο24", 1), ("e‑mail", 1), ("A‐1", 1), ("χ2 검정", 0), ("κ값", 0), ("и с о", 0), ("3–5 −2", 0), ("ㅋㅋ", 0), ("ᄒ", 1)])
def test_skeleton_candidates(spark, text, expected):
    """Values come from the skeleton; the context rule only rejects."""
    df = spark.createDataFrame([(1, text)], "rec_id int, instruction string")
    assert lk.lookalike_values(df, "rec_id", ["instruction"], "t").count() == expected
    assert lk.differs(text) or not expected


def test_nothing_is_reported_without_the_skeleton(monkeypatch):
    monkeypatch.setattr(lk, "skeleton", lambda text: unicodedata.normalize("NFD", text))
    assert not lk.differs("Ехрlаіn")


def test_skeleton_keeps_all_cases():
    assert all(lk.differs(t) for t, found in CASES if found)


@pytest.mark.parametrize(("text", "expected"), [("Ꭺpple", 1), ("ꓮpple", 1), ("Հello", 1), ("pհone", 1), ("tℎis", 1), ("bⅰt", 1), ("TypeⅡ", 0), ("Ⅱ장", 0), ("500mℓ", 0), ("ℝ", 0), ("ᏣᎳᎩ", 0), ("Հայերեն", 0), ("ⲀⲂ계획", 1), ("ｱｲｳ", 1), ("Åland", 1)])
def test_wider_scripts(spark, text, expected):
    assert lk.stands_for_another(text) == bool(expected)
    assert lk.differs(text) or not expected


def test_the_skeleton_runs_for_every_value_that_is_reported(spark, monkeypatch):
    seen = []
    own = lk.skeleton
    monkeypatch.setattr(lk, "skeleton", lambda t: seen.append(t) or own(t))
    found = [t for t, _ in CASES if lk.differs(t) and lk.stands_for_another(t)]
    assert found and set(found) <= set(seen) | {t for t in found if t.isascii()}
    assert lk.skeleton("Ꭺꓮpple") == "AApple" and lk.latin_words("привет Ехрlаіn") == "привет Explain"
