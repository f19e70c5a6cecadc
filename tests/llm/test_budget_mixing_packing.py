import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from onggi.llm import budget, mixing, packing
from onggi.llm import tokenization as tk


@pytest.mark.skipif(not os.path.exists(tk.BYTE_BPE), reason="no vocabulary files")
def test_updates_equal_a_full_count(spark, tmp_path):
    info = spark.createDataFrame([("news_a", "news")], "source string, domain_name string")

    def docs(rows):
        df = spark.createDataFrame([(*r, "x") for r in rows], "id string, text string, source string, lang string, key string")
        return budget.sliced(df, df["id"], df["text"], df["source"], df["lang"], info)

    one = [("1", "하나 둘 셋", "News-A ", "KO"), ("2", "하나 둘 셋", "news_a", "ko-KR"), ("3", None, None, None), ("4", "alpha beta", "other", "kor"), ("5", "지워질 글", "news_a", "ko")]
    two = [("1", "하나 둘 셋", "news_a", "ko"), ("2", "바뀐 글", "news_a", "ko"), ("3", None, None, None), ("4", "alpha beta", "news_a", "en"), ("6", "새 글", "other", "ko")]
    b = budget.TokenBudget(spark, f"file://{tmp_path}/a")
    first = {(r.source, r.lang, r.domain_name): (r.n_docs, r.n_tokens) for r in b.update(docs(one)).collect()}
    enc = tk.Encoder(tk.BYTE_BPE)
    n = lambda t: int(enc.counts_of([t])[0])
    assert first == {("news_a", "ko", "news"): (3, 2 * n("하나 둘 셋") + n("지워질 글")), ("unknown", "unknown", "unknown"): (1, 0), ("other", "ko", "unknown"): (1, n("alpha beta"))}
    second = {tuple(r) for r in b.update(docs(two)).collect()}
    assert second == {tuple(r) for r in budget.TokenBudget(spark, f"file://{tmp_path}/b").update(docs(two)).collect()}
    fresh = spark.read.parquet(f"file://{tmp_path}/a/counts/v000002")
    assert fresh.count() == 2
    assert b.update(docs(two).limit(0)).count() == 0


def sources(spark, seed=3):
    rng = random.Random(seed)
    rows = [(i, s, rng.randint(1, 400)) for i, s in enumerate(["big"] * 3000 + ["mid"] * 700 + ["tiny"] * 20 + ["none"] * 50)]
    return spark.createDataFrame(rows, "id bigint, source string, size bigint")


def test_shares_and_caps(spark):
    targets = spark.createDataFrame([("big", 0.5, 1), ("MID", 0.3, 2), ("tiny", 0.1, 4), ("absent", 0.1, 3)], "source string, target_share double, max_repeats int")
    chosen = mixing.mix(sources(spark), targets, block_rows=500)
    rep = {r.source: r for r in mixing.mixing_report(chosen, targets).collect()}
    assert rep["absent"].n_records == 0 and rep["absent"].actual_share == 0
    for s, share in (("big", 0.5), ("mid", 0.3), ("tiny", 0.1)):
        assert rep[s].actual_share == pytest.approx(share / 0.9, abs=0.005)
    caps = {"big": 1, "mid": 2, "tiny": 4}
    rows = chosen.collect()
    assert all(1 <= r.repeats <= caps[r.source] for r in rows) and len({r.id for r in rows}) == len(rows)
    assert {tuple(r) for r in mixing.mix(sources(spark).repartition(7), targets, block_rows=500).collect()} == {tuple(r) for r in rows}
    assert mixing.mix(sources(spark).limit(0), targets).count() == 0 and mixing.mix(sources(spark), targets.limit(0)).count() == 0


def test_blank_outputs_have_no_size(spark):
    df = spark.createDataFrame([(1, "A-b", "글"), (2, "a_b", " \n"), (3, "a_b", None)], "rec_id int, source string, output string")
    assert [tuple(r) for r in mixing.sized_records(df).collect()] == [(1, "a_b", 1)]


def test_flight_keeps_the_totals():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 500, 4000).astype(float)
    p = np.full(4000, 0.37)
    out = mixing.flight(p, size, rng)
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum(), abs=1e-4) and (out * size).sum() == pytest.approx((p * size).sum(), rel=1e-6)


def test_inclusion_probabilities_stay_as_they_are():
    size = np.array([5.0, 9.0, 2.0, 7.0, 7.0, 1.0])
    mean = np.mean([mixing.flight(np.full(6, 0.4), size, np.random.default_rng(s)) for s in range(4000)], axis=0)
    assert np.allclose(mean, 0.4, atol=0.04)


def test_bounds_and_fits():
    rng = random.Random(4)
    for _ in range(200):
        cap = rng.choice([10, 37, 100])
        s = np.array(sorted((rng.randint(1, cap - 1) for _ in range(rng.randint(1, 60))), reverse=True))
        b = packing.best_fit_decreasing(s, cap)
        used = np.bincount(b, weights=s)
        assert used.max() <= cap and packing.lower_bound(s, cap) <= len(used)
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3 and packing.lower_bound(np.array([], int), 10) == 0


def test_packing_tables(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([0, 1, 5, 64, 100, 128, 129, 256, 300, 1000, 50, 77]), "x") for i in range(3000)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, size string")
    packs = spark.createDataFrame([("a", 128), ("b", 512)], "pack_name string, capacity int")
    packed = packing.pack(sizes, packs, block_pieces=400)
    got = packed.collect()
    for name, cap in (("a", 128), ("b", 512)):
        mine = [r for r in got if r.pack_name == name]
        assert {d: sum(r.size for r in mine if r.doc_id == d) for d in range(0, 3000, 97)} == {d: n for d, n, _ in rows if d % 97 == 0 and n} | {d: 0 for d, n, _ in rows if d % 97 == 0 and not n}
        assert sum(r.size for r in mine) == sum(n for _, n, _ in rows)
        pieces = {}
        for r in mine:
            pieces.setdefault(r.doc_id, []).append(r)
        assert all(len(p) == max(1, -(-sum(x.size for x in p) // cap)) for p in pieces.values())
    fills = packing.container_fills(packed).collect()
    assert all(r.used <= r.capacity for r in fills) and len({(r.pack_name, r.container) for r in fills}) == len(fills)
    assert np.mean([r.fill_share for r in fills]) > 0.97
    assert {(r.pack_name, r.container): r.used for r in fills} == {(r.pack_name, r.container): r.fill for r in got}
    assert packing.pack(sizes.limit(0), packs).count() == 0
    assert packed.select(F.countDistinct("pack_name", "doc_id", "piece_no")).first()[0] == len(got)


def test_every_capacity_is_packed(spark):
    sizes = spark.createDataFrame([(i, 3 + i % 5) for i in range(6)], "doc_id bigint, n_tokens bigint")
    packs = spark.range(1500).selectExpr("concat('p', id) AS pack_name", "cast(8 + id % 7 AS int) AS capacity")
    got = packing.pack(sizes, packs).groupBy("pack_name").agg(F.count_distinct("doc_id").alias("n"), F.sum("size").alias("s")).collect()
    assert len(got) == 1500 and {(r.n, r.s) for r in got} == {(6, sum(3 + i % 5 for i in range(6)))}


def test_too_many_capacities_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_PACKS", 2)
    with pytest.raises(ValueError):
        packing.pieces(spark.createDataFrame([(1, 2)], "doc_id bigint, n_tokens bigint"), spark.range(3).selectExpr("cast(id AS string) AS pack_name", "4 AS capacity"))


def test_certificates_of_the_whole_packing(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(1, 140)) for i in range(2000)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint"), spark.createDataFrame([("a", 100)], "pack_name string, capacity int"), block_pieces=300)
    r = packing.certificates(packed).first()
    sizes = np.array([x.size for x in packed.collect()])
    assert r.bound == packing.lower_bound(sizes, 100) and r.n_containers == len({x.container for x in packed.collect()}) and 0 <= r.n_above <= 0.02 * r.bound
    c = np.unique(sizes, return_counts=True)
    assert packing.lower_bound(c[0], 100, c[1]) == r.bound
