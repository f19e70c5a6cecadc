from pyspark.sql import functions as F

from onggi.operators import noise
from onggi.operators.noise import bench_variants
from onggi.sources import records, sinks
from onggi.streaming import windows


def test_line_positions_and_limits(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 2}\n{"a": 3}\n', encoding="utf-8")
    url = f"file://{p}"
    idx = lambda df: [r.idx for r in df.orderBy("idx").collect()]
    assert idx(records.jsonl(spark, url)) == [0, 2, 3]
    assert idx(records.jsonl(spark, url, 2, "index")) == [0]
    assert idx(records.jsonl(spark, url, 2, "rows")) == [0, 2]
    odd = records.field(F.col("record"), "a", "int") % 2 == 1
    assert idx(records.jsonl(spark, url, 2, "kept", odd)) == [0, 3]
    assert idx(records.text_lines(spark, url)) == [0, 2, 3]


def test_positions_over_many_parts(spark, tmp_path):
    p = tmp_path / "b.txt"
    p.write_text("\n".join(f"line {i}" for i in range(3000)), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = records.indexed_lines(spark, f"file://{p}").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.idx, r.line) for r in rows) == [(i, f"line {i}") for i in range(3000)]


def test_csv_dialects_and_encodings(spark, tmp_path):
    for name, enc, sep in (("a", "utf-8-sig", ","), ("b", "cp949", ";"), ("c", "utf-8", "\t")):
        p = tmp_path / f"{name}.csv"
        p.write_bytes(f"질문{sep}답\n하나{sep}둘\n셋{sep}넷\n".encode(enc))
        df = records.sniffed_csv(spark, f"file://{p}")
        assert df.columns == ["질문", "답"] and [tuple(r) for r in df.collect()] == [("하나", "둘"), ("셋", "넷")]


def test_sinks_and_stored_stages(spark, tmp_path):
    items = spark.createDataFrame([("1", "t", "질문 하나", ["가", "나"])], "id string, task string, question string, choices array<string>")
    counts = sinks.write_variants(bench_variants(items), f"file://{tmp_path}/out")
    assert {r.noise_type: r.n_rows for r in counts.collect()} == dict.fromkeys(("clean", "spacing", "jamo", "pronunciation", "mixed"), 1)
    back = records.jsonl(spark, f"file://{tmp_path}/out/task=t/noise_type=clean")
    assert back.select(records.field(F.col("record"), "question")).first()[0] == "질문 하나"
    sinks.write_corpus(spark.createDataFrame([("a", "", "b\r\nc"), (None, None, "")], "instruction string, input string, output string"), f"file://{tmp_path}/corpus")
    assert sorted(r.line for r in records.text_lines(spark, f"file://{tmp_path}/corpus").collect()) == ["a", "b", "c"]
    calls = []
    build = lambda: calls.append(1) or items
    for _ in range(2):
        assert records.stored(spark, "s", {"x": 1}, build, f"file://{tmp_path}/stages").count() == 1
    assert len(calls) == 1
    table = sinks.markdown(items, [("id", F.col("id")), ("n", F.size("choices"))], ["n"]).orderBy("pos").collect()
    assert [r.value for r in table] == ["| id | n |", "|---|---:|", "| 1 | 2 |"]


def test_streams_give_the_same_rows(spark, tmp_path):
    src = spark.createDataFrame([(i, f"안녕하세요 세계 {i}", None, "답") for i in range(20)], "rec_id int, instruction string, input string, output string")
    src.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).parquet(f"file://{tmp_path}/in")
    q = noise.noisy_pairs(stream).writeStream.format("memory").queryName("pairs").trigger(availableNow=True).start()
    q.awaitTermination(120)
    from onggi.operators.noise import noisy_pairs

    expected = {(r.pair_id, r.noisy_instruction) for r in noisy_pairs(src).collect()}
    assert {(r.pair_id, r.noisy_instruction) for r in spark.table("pairs").collect()} == expected


def test_accuracy_per_window_counts_deliveries_once(spark, tmp_path):
    rows = [("r", "a", "jamo", 1, 1, "2024-01-01 01:00:00"), ("r", "a", "jamo", 1, 1, "2024-01-01 01:00:00"), ("r", "b", "jamo", 1, 0, "2024-01-01 02:00:00"), ("r", "c", "jamo", 1, None, "2024-01-02 02:00:00")]
    df = spark.createDataFrame(rows, "run_id string, id string, noise_type string, gold int, pred int, t string").selectExpr("run_id", "id", "noise_type", "gold", "pred", "cast(t AS timestamp) AS scored_at")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = windows.windowed_accuracy(stream).writeStream.format("memory").queryName("acc").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.n, r.accuracy) for r in spark.table("acc").collect()) == [(1, 0.0), (2, 0.5)]


def test_configurations_and_pointers(spark, tmp_path):
    for c, split in (("a", "test"), ("b", "dev"), ("c", "other")):
        (tmp_path / c / split).mkdir(parents=True)
        (tmp_path / c / split / "x.jsonl").write_text(f'{{"q": "{c}"}}\n\n', encoding="utf-8")
    got = records.all_configurations(spark, f"file://{tmp_path}", "set").collect()
    assert sorted((r.subset, r.source) for r in got) == [("a", "set:a:test"), ("b", "set:b:dev")]
    assert records.first_split(spark, f"file://{tmp_path}/c") is None
    (tmp_path / "latest").write_text("/data/run-1\n")
    assert records.pointed(spark, f"file://{tmp_path}/latest") == "/data/run-1"


def test_metric_files_and_token_lists(spark, tmp_path):
    for n, v in (("one", 1.5), ("two", 2.5)):
        (tmp_path / f"{n}.json").write_text(f'{{"ppl": {v}}}')
    got = {r.name: r.value for r in records.metric_table(spark, f"file://{tmp_path}/*.json", ["one", "two", "three"]).collect()}
    assert got == {"one": 1.5, "two": 2.5, "three": None}
    sinks.write_token_list(spark.createDataFrame([("b",), ("a",)], "token string"), f"file://{tmp_path}/v")
    assert spark.read.text(f"file://{tmp_path}/v").first()[0] == '["a","b"]'
    m, g, e = spark.createDataFrame([(2, 0.5)], "n int, accuracy double"), spark.createDataFrame([("s", 0.5)], "subset string, accuracy double"), spark.createDataFrame([(2, "b"), (1, "a")], "i int, t string")
    doc = sinks.metric_document(m, g, e, "i", 1).first()[0]
    assert '"metrics": {"n":2,"accuracy":0.5}' in doc and '"examples": [{"i":1,"t":"a"}]' in doc
