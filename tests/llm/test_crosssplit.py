import difflib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from onggi.llm import bloom
from onggi.llm import crosssplit as cs
from onggi.llm import queries as q

A = ("가람도서관을 소개해 주세요.", None, "가람도서관에는 하얀 책이 312권 있으며 그 가운데 45권은 학생들이 함께 읽었습니다. 결국 가람도서관은 새해초에 넓어졌습니다.")


def test_chunks_are_cut_alike_wherever_they_stand():
    rng = random.Random(1)
    text = "".join(chr(rng.randint(0xAC00, 0xD7A3)) for _ in range(400))
    d, n, ends = cs.chunk([text, "가나다" + text, ""])
    assert n[: ends[1]].sum() == 400 and ends[3] == ends[2]
    shared = set(d[: ends[1]].tolist()) & set(d[ends[1] : ends[2]].tolist())
    assert len(shared) >= 0.9 * ends[1]
    alone, _, _ = cs.chunk([text])
    assert alone.tolist() == d[: ends[1]].tolist()
    assert cs.chunk([])[0].size == 0 and np.array_equal(cs.chunk(["", ""])[2], [0, 0, 0])


def test_misspelling_leaves_the_coarse_form():
    code = lambda t: cs.coarse(np.array([ord(c) for c in t], np.uint32)).tolist()
    assert code("각낙다") == code("객넉따") != code("각막다")


def table(spark, rows):
    schema = "rec_id bigint, split string, instruction string, input string, output string, e_id string"
    return spark.createDataFrame([(*r, "x") for r in rows], schema)


def found(spark, rows):
    return {(min(r.e_id, r.r_id), max(r.e_id, r.r_id)) for r in cs.same_exchanges(table(spark, rows)).collect()}


def noise_rows(n=60):
    rng = random.Random(5)
    w = lambda: "".join(rng.choice("가나다라마바사아자차카타파하") for _ in range(3))
    return [(100 + i, "train", f"{w()}을 함께 설명하세요.", None, f"{w()}에는 {w()}이 {rng.randint(10, 999)}개 있으며 {w()}이 함께 {w()}했습니다. 하지만 {w()}은 없습니다.") for i in range(n)]


def test_pairs(spark):
    a, b, c = A
    rows = [
        (1, "test", a, b, c), (2, "train", a, b, c), (3, "train", a, b, c), (4, "train", None, a, c), (5, "train", "Q. " + a, "", c + " 도움이 되었기를 바랍니다."), (6, "train", a, b, c.replace("학생들이", "학쌩들이").replace("하얀", "햐얀").replace("함께", "함꼐")),
        (7, "train", a.replace("가람", "소라"), b, c.replace("가람", "소라")), (8, "train", a, b, c.replace("312", "313")), (9, "train", a, b, "전혀 다른 답을 여기에 길게 적어 두었습니다. 비가 내리고 바람이 붑니다."),
        (10, "train", a, b, c.replace("함께", "더불어")), (12, "other", a, b, c), (13, "test", None, " ", None), (14, "train", None, None, ""),
    ]
    got = found(spark, rows + noise_rows())
    assert {(1, k) for k in (2, 3, 4, 5, 6, 10)} <= got and not {(1, k) for k in (7, 8, 9, 12)} & got and not {p for p in got if 13 in p or 14 in p}


def test_a_sentence_elsewhere(spark):
    """Records of several sentences keep enough chunks when one moves."""
    a, _, c = A
    more = ["하지만 저녁에는 소리마을 사람들이 호수 앞에서 긴 노래를 불렀습니다.", "다만 비 오는 날에는 창문 28개를 모두 닫고 조용히 기다렸습니다.", "특히 느린 편지는 우체국의 낡은 자전거보다 19배나 늦게 도착했습니다."]
    rows = [(1, "test", a, None, " ".join([c, *more])), (2, "train", a, None, " ".join([*more, c]))]
    assert (1, 2) in found(spark, rows + noise_rows())


def test_empty_table(spark):
    assert found(spark, []) == set()


def test_brute_force_finds_no_more(spark):
    """All pairs of a small table are compared directly; chunks must lose none that the comparison accepts."""
    base = noise_rows(25)
    rows = base + [(1000 + r[0], "test", *r[2:]) for r in base[:8]] + [(2000 + r[0], "validation", r[2], None, r[4].replace("함께", "더불어")) for r in base[8:16]]
    texts = {r[0]: cs.Known([cs.composed(t) for t in r[2:5]]) for r in rows}
    split = {r[0]: r[1] for r in rows}
    direct = set()
    for e in texts:
        for t in texts:
            if split[e] != "train" and split[t] == "train":
                ok, subs = cs.compare(texts[e], texts[t])
                if ok and all({"함께", "더불어"} >= set(g) or {"함께", "더불어"} >= set(h) for g, h in zip(subs[::2], subs[1::2], strict=True)):
                    direct.add((min(e, t), max(e, t)))
    assert direct <= found(spark, rows) and len(direct) == 16


def test_query_is_registered():
    assert "p1_found" in q.queries()


def test_short_edited_records_of_a_large_group(spark):
    """Half of the table are near copies of each other, so what they share weighs nothing; an edit beside the only word
    that differs leaves an evaluation record some common chunks only."""
    rng = random.Random(8)
    w = lambda: "".join(chr(rng.randint(0xAC00, 0xD7A3)) for _ in range(3))
    names = [w() for _ in range(150)]
    text = lambda name, usual: ["도서관의 하얀 창문을 천천히 소개해 주세요.", "", f"조용한 마을의 {name} {usual} 낡은 자전거를 고쳤습니다. 저녁에는 모두 돌아갔습니다."]
    rows = [(i, "train", *text(n, "함께")) for i, n in enumerate(names)] + [(1000 + i, "test", *text(n, "더불어")) for i, n in enumerate(names[:40])] + noise_rows(100)
    mates = {(i, 1000 + i) for i in range(40) if cs.compare(*(cs.Known([cs.composed(t) for t in text(names[i], u)]) for u in ("더불어", "함께")))[0]}
    assert len(mates) == 40
    assert len(mates & found(spark, rows)) >= 38


def test_overlap_is_the_share_of_chunk_lengths(spark):
    a, b, c = A
    rows = [(1, "test", a, b, c), (2, "train", a, b, c), (6, "train", a, b, c.replace("함께", "더불어")), (7, "train", "Q. " + a, b, c)]
    got = {r.r_id: r.overlap for r in cs.same_exchanges(table(spark, rows + noise_rows())).collect() if r.e_id == 1}
    texts = {r[0]: cs.letters("".join(map(cs.composed, r[2:5]))) for r in rows}
    for k in (2, 6, 7):
        d, n, ends = cs.chunk([texts[1], texts[k]])
        other = set(d[ends[1] :].tolist())
        assert abs(got[k] - sum(x for y, x in zip(d[: ends[1]].tolist(), n[: ends[1]].tolist()) if y in other) / len(texts[1])) < 1e-9
    assert got[2] == 1.0 and got[6] < 1.0


def test_recall_of_the_candidates(spark):
    """Against every pair that shares a chunk, on short edited records of one template."""
    rng = random.Random(3)
    w = lambda: "".join(chr(rng.randint(0xAC00, 0xD7A3)) for _ in range(3))
    rows = []
    for i in range(120):
        a, b = f"{w()} 마을의 {w()}을 두 문장으로 설명하세요.", f"{w()}에는 {w()}이 {rng.randint(10, 999)}개 있으며 {w()}이 함께 {w()}했습니다. 하지만 {w()}은 없습니다."
        rows += [(i, "train", a, None, b), (1000 + i, "test", a, None, b.replace("함께", rng.choice(["더불어", "함꼐", "다 함께"])))]
    exact = {(r.e_id, r.r_id) for r in cs.same_exchanges(table(spark, rows), threshold=0.0, whole=0.0, least=0.0).collect()}
    got = {(r.e_id, r.r_id) for r in cs.same_exchanges(table(spark, rows)).collect()}
    assert got <= exact and len(exact) >= 110 and len(got) >= 0.95 * len(exact)


def test_links_are_counted_by_class(spark):
    a, b, c = A
    rows = [(1, "test", a, b, c), (2, "test", a, b, c), (5, "test", "다른 것", None, "없는 답을 적었습니다."), *[(10 + i, "train", a, b, c) for i in range(7)], (30, "train", a, b, c.replace("함께", "더불어"))]
    got = {r.rec_id: (r.n_links, r.overlap) for r in cs.matched_records(table(spark, rows + noise_rows())).collect()}
    assert got == {1: (8, 1.0), 2: (8, 1.0)}


def test_pairs_whose_numbers_differ_leave_before_they_are_summed(spark):
    """Records of one template that each have a number of their own are no candidates; more numbers on one side are none against."""
    said = "이 마을의 창고에는 지난 가을에 거둔 쌀이 {} 가마 있으며 주민들은 이를 겨울까지 나누어 쓰기로 했다".format
    rows = [(k, "train" if k % 2 else "test", said(1000 + k), "", "") for k in range(60)]
    rows += [(100, "test", said(7), "모두 옳다", ""), (101, "train", said(7), "모두 옳다고 한다", "2024년 3월에 쓴 글")]
    df = spark.createDataFrame(rows, "rec_id bigint, split string, instruction string, input string, output string")
    pairs = {(r.e_id, r.r_id) for r in cs.candidate_classes(cs.chunk_table(df, "rec_id", "split", ("instruction", "input", "output")), threshold=0.0, whole=0.0, least=0.0).collect()}
    assert (100, 101) in pairs and len(pairs) < 100
    bits = [cs.number_bits(t) for t in ("3 4 3", "3 3", "4 없음", "없음")]
    assert all(bits[0] & b == b for b in bits) and bits[1] & bits[2] != bits[2] and bits[3] == 0


def test_matching_blocks_are_those_of_difflib():
    rng = random.Random(2)
    w = lambda k, n: "".join(rng.choice("가나다라마바사아자차"[:k]) for _ in range(rng.randint(0, n)))
    for k in range(600):
        a, b = w(1 + k % 10, 50), w(1 + k % 10, 50)
        b = b if k % 3 else a[k % 7 :] + b[:9] + a[: k % 20]
        theirs = difflib.SequenceMatcher(None, a, b, autojunk=False)
        blocks = [tuple(m) for m in theirs.get_matching_blocks()]
        assert cs.matching_blocks(a, b) == blocks and all(cs._alike(a, b, x) == (theirs.ratio() >= x) for x in (0.3, 0.6, 0.75) if a or b)
        #: The bounds are none below what they bound.
        pairs = [{t[i : i + 2] for i in range(len(t) - 1)} for t in (a, b)]
        assert sum(n for _, _, n in blocks) <= cs._in_common(a, b) and sum(n for _, _, n in blocks if n >= 2) <= min(cs._covered(a, pairs[1]), cs._covered(b, pairs[0]))


def test_a_batch_is_cut_as_each_of_its_records():
    """Records side by side in a batch: numbers end with their record, and letters are those of the definition."""
    odd = [None, "", " _ ", "가1 2\u0663 12", "\uff11\uff12 a", "\uff48ello 1", "\U00020000字 5\U0001d7d9", "Ⅻ ½ 2", "12", "3", "\U0001f600 9", "ß İ", "\u1100\u1161\u11a8 7"]
    rows = [(odd[i], odd[(i * 5 + j) % 13], odd[(2 * i + j) % 13]) for i in range(13) for j in range(13)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(169)), pa.array([False] * 169), *(pa.array([r[k] for r in rows], pa.string()) for k in range(3))], names=list("abcde"))
    got = {r["id"]: r for part in cs._chunker(None)([batch]) for r in part.to_pylist()}
    wholes = [" ".join(map(cs.composed, r)) for r in rows]
    texts = list(map(cs.letters, wholes))
    assert set(got) == {i for i, t in enumerate(texts) if t}
    for i, r in got.items():
        d, n, _ = cs.chunk([texts[i]])
        assert r["numbers"] == cs.number_bits(wholes[i]) and dict(zip(r["digests"], r["lens"], strict=True)) == dict(zip(d.view(np.int64).tolist(), n.tolist(), strict=True))
    assert all((got[i]["cls"] == got[j]["cls"]) == (texts[i] == texts[j]) for i in got for j in got)


def test_only_sought_forms_leave_the_count_of_words(spark):
    texts = ["함께 갔다. 함께 함께, 왔다", "더불어 (함께)", None, "", "새로 왔다"]
    hashes = spark.createDataFrame([("함께",), ("왔다",)], "w string").select(F.xxhash64("w").alias("h"))
    assert sorted(cs.spark_hashes(["함께", "왔다"]).view(np.int64).tolist()) == sorted(r.h for r in hashes.collect())

    class Sought:
        value = bloom.build(hashes)

    counts: dict[str, int] = {}
    for part in cs._form_counter(Sought())([pa.RecordBatch.from_arrays([pa.array(texts[a : a + 2], pa.string())], names=["t"]) for a in (0, 2, 4)]):
        for r in part.to_pylist():
            counts[r["form"]] = counts.get(r["form"], 0) + r["n"]
    assert counts == {"함께": 3, "왔다": 2}


def test_nothing_is_found_that_the_comparison_does_not_need():
    a, b = (cs.Known([cs.composed(t) for t in (f"마을에 쌀이 {n} 가마 있다", "", "그렇다")]) for n in (3, 4))
    assert cs.compare(a, b) == (False, []) and not {"runs", "at", "parts"} & (vars(a).keys() | vars(b).keys())
