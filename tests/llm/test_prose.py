import pytest

from onggi.llm import prose

SENTENCE = "그리고 학생들은 도서관에서 새로운 책을 천천히 읽었습니다. 결국 선생님은 우리에게 중요한 이야기를 들려주었다. "
KINDS = [
    (SENTENCE * 2, "prose"), ("오늘은 정말 더웠어요 ㅠㅠ\n그래서 친구와 함께 바다에 갔어요 ㅋㅋㅋ\n물이 차가워서 좋았어요", "prose"), ("- 하얀 장갑\n- 낡은 지도\n- 작은 우산\n- 푸른 담요", "list"),
    ("하얀 장갑, 낡은 지도, 작은 우산, 푸른 담요, 얇은 공책, 느린 시계", "list"), ("이름\t나이\t도시\n민수\t12\t서울\n영희\t11\t부산", "table"), ("이름: 민수\n나이: 12\n\n이름: 영희\n나이: 11", "table"),
    ("| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |", "table"), ("최고의 상품 지금 클릭!! " * 20, "junk"), ("7a5722e5e3df6401 b7870d601038d8b1 40692b2948029a9f b8d9cbe56734d4f2", "junk"), ("$}!~@~/=/?##^ ##>{^:&\\_?:-]]|(&>))<~ |! >; ]% +~?", "junk"),
    ("뵕왬 푭 쿴녺쓺 욄 웄튈풡 깚쫽똃쯣쟨슢먍쩠뺟샕쏞혧둑뽙", "junk"), (SENTENCE + "\n- 하나\n- 둘\n" + SENTENCE, "prose"), ("The students of the school read the book, and then they went to the library. It was a long day for all of them.", "prose"),
    ("しかし学生たちは図書館で新しい本を読みました。その後、先生は大切な話をしてくれました。", "prose"), ("", None), (None, None), (" \n", None),
]


@pytest.mark.parametrize(("text", "kind"), KINDS)
def test_kinds(text, kind):
    assert prose.kind_of(text) == kind


def test_divergence():
    assert prose.divergence((0.5, 0.5), (0.5, 0.5)) == 0 and prose.divergence((1.0, 0.0), (0.0, 1.0)) == pytest.approx(1.0)


def test_tables(spark):
    df = spark.createDataFrame([(i, t, "ko", "x") for i, (t, _) in enumerate(KINDS)] + [(0, KINDS[0][0], "ko", "again")], "doc_id bigint, text string, lang string, kind string")
    got = prose.structural_kinds(df).collect()
    assert len(got) == len(KINDS) - 3 + 1
    words = spark.createDataFrame([("ko", "그리고", 1)], "lang string, word string, rank_no int")
    stats = {r.doc_id: r for r in prose.text_statistics(df, words).collect()}
    assert stats[14].n_words == 0 and stats[14].mean_word_len is None and stats[0].common_share > 0
    assert prose.structural_kinds(df.limit(0)).count() == 0


OTHER = {
    "es": "El gato duerme en la casa porque hace mucho frío. Los niños juegan en el parque con sus amigos y no quieren volver. Mañana iremos al mercado para comprar pan.",
    "fr": "Le chat dort dans la maison parce qu'il fait froid. Les enfants jouent avec leurs amis et ne veulent pas rentrer. Demain nous irons au marché pour acheter du pain.",
    "zh": "猫在房子里睡觉，因为天气很冷。孩子们在公园里和朋友们一起玩，他们不想回家。明天我们要去市场买面包。",
    "ru": "Кошка спит в доме, потому что на улице холодно. Дети играют в парке с друзьями и не хотят идти домой. Завтра мы пойдём на рынок, чтобы купить хлеб.",
    "nl": "De kat slaapt in het huis omdat het koud is. De kinderen spelen met hun vrienden en willen niet naar huis. Morgen gaan we naar de markt om brood te kopen.",
}


@pytest.mark.parametrize("lang", sorted(OTHER))
def test_prose_of_further_languages(lang):
    assert prose.kind_of(OTHER[lang]) == "prose"


def test_lists_of_further_languages():
    assert prose.kind_of("苹果\n香蕉\n橙子\n葡萄\n西瓜\n") == prose.kind_of("pan\nleche\nhuevos\naceite\nsal\n") == "list"
