import os

import pytest

from onggi.llm import tokenization as tk

pytestmark = pytest.mark.skipif(not os.path.exists(tk.BYTE_BPE), reason="no vocabulary files")
TEXTS = [
    "<|endoftext|> a", None, "", "x" * 3000, "  \n\n a b 　한글 ​"[:9] * 50, "aaaa" * 300, "a\x1c b\x1d\x1ec  \x85 it's 's 　d", "다음 글을 요약하세요.", "ㅋㅋㅋ 👨‍👩‍👧",
    "word " * 500, "\r\n\t x", "1234567890 12.5%", "ÄÖÜ ñ é", " ", "\n",
]


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tk.BYTE_BPE)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_equal_the_library_and_decode_back():
    enc = tk.Encoder(tk.BYTE_BPE)
    offsets, ids = enc.encode(TEXTS)
    mine = [ids[offsets[i] : offsets[i + 1]].tolist() for i in range(len(TEXTS))]
    assert mine == library(TEXTS)
    assert [enc.automaton.decode(x) for x in mine] == [t or "" for t in TEXTS]
    assert enc.counts_of(TEXTS).tolist() == [len(x) for x in mine]


def test_random_texts():
    import random

    rng = random.Random(2)
    texts = ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(97, 110), rng.randint(0xAC00, 0xD7A3), rng.randint(0x80, 0x3000)])) for _ in range(rng.randint(1, 50))) for _ in range(3000)]
    offsets, ids = tk.Encoder(tk.BYTE_BPE).encode(texts)
    assert [ids[offsets[i] : offsets[i + 1]].tolist() for i in range(len(texts))] == library(texts)


def test_small_automaton_follows_the_merges():
    vocab = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"aab": 257, b"ba": 258}
    a = tk.TokenizationAutomaton(vocab, [(b"a", b"a"), (b"aa", b"b"), (b"b", b"a")])
    assert a.path(b"aaa") == [256, 97] and a.path(b"aab") == [257] and a.path(b"ba") == [258] and a.path(b"aaba") == [257, 97]


def test_tables(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "again")], "doc_id bigint, text string, ids string")
    got = tk.encode_documents(df).collect()
    assert len(got) == len(TEXTS) + 1 and {tuple(r.ids) for r in got if r.doc_id in (1, 2)} == {()}
    back = tk.decode_documents(tk.encode_documents(df.where("doc_id > 2")))
    assert {r.doc_id: r.text for r in back.collect()} == {i: t for i, t in enumerate(TEXTS) if i > 2}
    assert tk.encode_documents(df.limit(0)).count() == 0
    assert all(r.same for r in tk.roundtrip(df).collect())
