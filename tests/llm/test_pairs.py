import pytest

from onggi.llm import pairs

CTX = {"니다": (100, 1), "마다": (0, 50), "행렬": (0, 20), "archive": (30, 30), "the": (0, 99)}
Q = "도서관을 소개해 주세요."
CASES = [
    (Q, None, None, ["empty"]), (Q, None, " \n", ["empty"]), (Q, None, "없음", ["empty"]), (Q, None, "(빈칸)", ["empty"]), (Q, None, "...", ["empty"]), (Q, None, "​", ["empty"]), (Q, None, "N/A", ["empty"]), (None, None, None, ["empty"]),
    (Q, None, Q, ["echo"]), (Q, None, "질문: " + Q, ["echo"]), (Q, "책이 많다.", Q + "\n책이 많다.", ["echo"]), (Q, None, "도서관을  소개해 주세요\n", ["echo"]), ("그대로 따라 쓰세요.", "책이 많습니다.", "책이 많습니다.", []),
    ("그대로 따라 쓰세요.", "책이 많습니다.", "그대로 따라 쓰세요.", ["echo"]), ("요약하세요.", "첫 문장이 여기에 있습니다. 둘째 문장도 있습니다.", "첫 문장이 여기에 있습니다.", []),
    (Q, None, "죄송하지만 그 요청은 도와드릴 수 없습니다.", ["refusal"]), (Q, None, "I'm sorry, but I can't help with that.", ["refusal", "wrong_language"]), (Q, None, "먼저 '도와드릴 수 없습니다'라는 안내문이 나오는 까닭부터 밝힙니다.", []),
    (Q, None, "늦어서 죄송합니다. 바로 설명합니다. 도서관은 조용합니다.", []), (Q, None, "규정에 따라 벌금을 새해초에 배포할 수 없습니다.", []),
    (Q, None, "The library has many books and it is open for all of us.", ["wrong_language"]), ("다음 문장을 영어로 옮기세요.", "책이 많다.", "There are many books in the library.", []), ("다음을 일본어로 번역하세요.", "책이 많다.", "There are many books in the library.", ["wrong_language"]),
    ("함수를 작성하세요.", None, "```python\ndef f(x):\n    return x\n```", []), ("함수를 작성하세요.", None, "```python\ndef f(x):\n    ret", ["truncated"]), ("나열하세요.", None, "1. 하얀 책\n2. 낡은 책\n3. ", ["truncated"]), ("나열하세요.", None, "1. 하얀 책\n2. 낡은 책", []),
    ("나열하세요.", None, "하얀 책, 낡은 책, 젖은 메모리", []), (Q, None, "도서관은 조용합니다. 값비싼 구문 하나가 전체의 행렬", ["truncated"]), (Q, None, "도서관은 조용합니다. 새해마다", ["truncated"]), (Q, None, "도서관은 조용합니다", []), (Q, None, "도서관은 조용합니다. ㅎㅎ", []),
    (Q, None, "5 + 6 = 11", []), ("감성을 쓰세요.", "좋다.", "긍정", []),
]


@pytest.mark.parametrize(("instruction", "inp", "output", "expected"), CASES)
def test_defects(instruction, inp, output, expected):
    assert pairs.defects_of(instruction, inp, output, CTX) == expected


def test_copies_need_next_to_nothing_beside_their_dictionary():
    text = "도서관에서 학생들이 조용히 책을 읽고 있었다. 창밖에는 비가 내렸다."
    assert pairs.dictionary_share(text, text) < 0.15 < pairs.dictionary_share("전혀 다른 글이다.", text)


def test_table(spark):
    rows = [(i, a, b, o, "x") for i, (a, b, o, _) in enumerate(CASES)] + [(0, Q, None, None, "x"), (99, "설명하세요. " * 3000, None, "설명합니다. " * 5000, "x")]
    df = spark.createDataFrame(rows, "rec_id bigint, instruction string, input string, output string, defect string")
    got = pairs.broken_pairs(df).collect()
    assert sum(r.rec_id == 0 for r in got) == 2 and not [r for r in got if r.rec_id == 99]
    assert pairs.broken_pairs(df.limit(0)).count() == 0


def test_every_response_is_compressed_with_its_prompt(monkeypatch):
    seen = []
    measure = pairs.dictionary_bytes
    monkeypatch.setattr(pairs, "dictionary_bytes", lambda prompt, output: seen.append(output) or measure(prompt, output))
    assert pairs.defects_of("책을 읽으세요.", None, "책을 읽으세요.", CTX) == ["echo"] and seen


@pytest.mark.parametrize(("instruction", "output", "expected"), [(Q, "도서관을 소개헤 주세요.", ["echo"]), (Q, "도서관을 소개해 주세오", ["echo"]), ("7번 문제를 푸세요.", "8번 문제를 푸세요.", []), (Q, "도서관을 설명해 주세요.", [])])
def test_short_near_copies(instruction, output, expected):
    assert pairs.defects_of(instruction, None, output, CTX) == expected


REASONS = "죄송합니다. 이 주제는 매우 민감합니다. 저희 정책에 따라 위험한 내용은 다루지 않습니다. "
ANSWER = "도서관은 마을 한가운데 있습니다. 아침 아홉 시에 문을 엽니다. 책은 열흘 동안 빌립니다. 신문도 함께 읽습니다. "


@pytest.mark.parametrize(("output", "expected"), [
    ("그 요청은 도와드릴 수 없습니다. " + REASONS * 10, True), (REASONS + "그 요청은 도와드릴 수 없습니다.", True), (REASONS * 10 + "그 요청은 도와드릴 수 없습니다.", True),
    (ANSWER + "다만 예약은 도와드릴 수 없습니다.", False), (ANSWER * 10 + "다만 예약은 도와드릴 수 없습니다.", False), ("안내문 '도와드릴 수 없습니다'가 보입니다. " + ANSWER, False), ("예약은 도와드릴 수 없습니다. " + ANSWER * 10, False),
    ("안내문 '도와드릴 수 없습니다'가 보입니다. 저는 그 요청을 도와드릴 수 없습니다.", True),
])
def test_refusals_of_any_length(output, expected):
    assert pairs.is_refusal(output) == expected


def test_contexts_do_not_depend_on_the_size(spark):
    """A context that ends five sentences is known beside a million other occurrences."""
    many = "the big red dog and the old cat saw " * 12000
    rows = [(i, Q, f"It was read by all of us in the small archive. We read it {i} times.") for i in range(6)] + [(50 + i, Q, many + ".") for i in range(10)] + [(99, Q, "It is a big house. We all went with them to the small archive")]
    df = spark.createDataFrame(rows, "rec_id bigint, instruction string, output string").selectExpr("*", "CAST(NULL AS string) AS input")
    got = {(r.rec_id, r.defect) for r in pairs.broken_pairs(df).collect()}
    assert (99, "truncated") not in got and (99, "wrong_language") in got


@pytest.mark.parametrize(("lang", "output"), [
    ("fr", "Le chat dort dans la maison parce qu'il fait froid. Les enfants jouent avec leurs amis."), ("es", "El gato duerme en la casa porque hace frío. Los niños juegan con sus amigos y no quieren volver."),
    ("zh", "猫在房子里睡觉，因为天气很冷。孩子们在公园里和朋友们一起玩。"), ("ru", "Кошка спит в доме, потому что на улице холодно."),
])
def test_further_languages(lang, output):
    assert pairs.language(output) == lang
    assert pairs.defects_of("Explain why the cat sleeps in the house.", None, output, CTX) == pairs.defects_of("고양이가 왜 집에서 자는지 설명하세요.", None, output, CTX) == ["wrong_language"]
    asked = {"fr": "프랑스어로", "es": "Translate into Spanish:", "zh": "중국어로", "ru": "Übersetze ins Russische, russisch:"}[lang]
    assert pairs.defects_of(f"{asked} the cat sleeps in the house", None, output, CTX) == []
