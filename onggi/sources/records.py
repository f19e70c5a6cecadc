"""Record sources: JSON lines with positions, CSV with an unknown dialect, plain text, result files, stored stages."""

from __future__ import annotations

import codecs
import csv
import hashlib
import io
import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onggi.functions.text import as_text, normalize_lines, strip
from onggi.operators.mcq import limited
from onggi.session import checkpoint_folder

ENCODINGS = ("utf-8-sig", "utf-8", "cp949")


def indexed_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, idx, line): every physical line with its position in its file.

    Positions within a part of a file come from the order in which it is read; parts are ordered by where they begin.
    Only the numbers of lines per part are collected to rows, never lines, and ranks are per file."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("m"), F.col("value").alias("line"))
    first = raw.groupBy("path", "start").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("first"))
    from pyspark.sql import Window

    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = first.select("path", "start", (before - F.col("first")).alias("shift"))
    return raw.join(offsets, ["path", "start"]).select("path", (F.col("m") + F.col("shift")).alias("idx"), "line")


def jsonl(spark: SparkSession, path: str | list[str], most: int | None = None, rule: str = "index", keep: Column | None = None) -> DataFrame:
    """(path, idx, record): a variant per non-blank line; malformed lines are an error.

    Limits count positions (`index`), non-blank lines (`rows`) or records that pass `keep` (`kept`), per file."""
    lines = indexed_lines(spark, path)
    if rule == "index":
        lines = limited(lines, "idx", most, "index")
    lines = lines.where(strip(F.col("line")) != "")
    if rule == "rows":
        lines = limited(lines, "idx", most, "rows", by=("path",))
    out = lines.select("path", "idx", F.parse_json("line").alias("record"))
    return limited(out, "idx", most, "kept", keep, by=("path",)) if rule == "kept" else out if keep is None else out.where(keep)


def field(record: Column, key: str, kind: str = "string") -> Column:
    """A field of a record; null if missing or of another kind."""
    return F.try_variant_get(record, f"$.{key}", kind)


def text_lines(spark: SparkSession, path: str | list[str], most: int | None = None) -> DataFrame:
    """(path, idx, line) of a plain text corpus: stripped, without blank lines; characters that cannot be decoded are removed."""
    lines = limited(indexed_lines(spark, path), "idx", most, "index")
    return lines.withColumn("line", strip(F.regexp_replace("line", "�", ""))).where("line <> ''")


def first_bytes(spark: SparkSession, path: str, n: int) -> bytes:
    """The first bytes of a file on any file system that the cluster reaches."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)  # type: ignore[union-attr]
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def sniffed_csv(spark: SparkSession, path: str, sample_bytes: int = 16_384) -> DataFrame:
    """A CSV file as strings. Encoding and separator are told from its first bytes; a file in none of the encodings is
    empty. The file is read where it lies, by the executors."""
    head = first_bytes(spark, path, sample_bytes)
    for encoding in ENCODINGS:
        try:
            #: A character may be cut at the end of the sample.
            sample = codecs.getincrementaldecoder(encoding)().decode(head, final=len(head) < sample_bytes)
            break
        except UnicodeDecodeError:
            continue
    else:
        return spark.createDataFrame([], "empty string")
    try:
        separator = csv.Sniffer().sniff(sample[:4096], delimiters=",;\t|").delimiter
    except csv.Error:
        separator = ","
    if encoding == "cp949":
        return _decoded_csv(spark, path, separator, encoding, next(csv.reader(io.StringIO(sample, newline=""), delimiter=separator), []))
    df = spark.read.option("header", True).option("sep", separator).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.removeprefix("\ufeff") for c in df.columns])


def _decoded_csv(spark: SparkSession, path: str, separator: str, encoding: str, names: list[str]) -> DataFrame:
    """A CSV file in an encoding that the built-in reader does not take; a file is one task, as with multi-line CSV."""

    def run(batches):  # type: ignore[no-untyped-def]
        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = list(csv.DictReader(io.StringIO(content.decode(encoding), newline=""), delimiter=separator))
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], pa.string()) for n in names], names=names)

    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def _file_system(spark: SparkSession, path: str):  # type: ignore[no-untyped-def]
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # type: ignore[union-attr]
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def only_file(spark: SparkSession, folder: str) -> str:
    """The path of the first data file in a folder that a sink has written."""
    fs, p = _file_system(spark, folder)
    return min(str(x.getPath()) for x in fs.listStatus(p) if x.isFile() and not x.getPath().getName().startswith(("_", ".")))


def first_split(spark: SparkSession, folder: str, split: str = "test", exists: Callable[[str], bool] | None = None) -> DataFrame | None:
    """The first split of an ordered list that a folder has, each as <folder>/<split>; with `split`, its name."""

    def on_file_system(p: str) -> bool:
        fs, q = _file_system(spark, p)
        return bool(fs.exists(q))

    for name in dict.fromkeys((split, "validation", "test", "dev", "train")):
        if (exists or on_file_system)(f"{folder}/{name}"):
            return jsonl(spark, f"{folder}/{name}").withColumn("split", F.lit(name))
    return None


def all_configurations(spark: SparkSession, folder: str, name: str, split: str = "test") -> DataFrame | None:
    """(path, idx, record, split, subset, source) of every configuration <folder>/<configuration>/<split> of a data set,
    each by its first split; source is name:configuration:split. Configurations without a split are left out."""
    fs, p = _file_system(spark, folder)
    out = None
    for c in sorted(x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()):
        rows = first_split(spark, f"{folder}/{c}", split)
        if rows is not None:
            rows = rows.withColumns({"subset": F.lit(c), "source": F.concat_ws(":", F.lit(name), F.lit(c), F.col("split"))})
            out = rows if out is None else out.unionByName(rows)
    return out


def corpus_texts(df: DataFrame, include_prompt: bool = False) -> DataFrame:
    """(text) for vocabulary building: the output, or all fields that are not null joined by line ends; empty ones leave."""
    text = F.concat_ws("\n", "instruction", "input", "output") if include_prompt else F.col("output")
    return df.select(normalize_lines(text).alias("text")).where("text <> ''")


def results(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, n, accuracy, pos, correct) of evaluation result files."""
    raw = spark.read.option("multiLine", True).schema("metrics struct<n: int, accuracy: double>, examples array<struct<correct: boolean>>").json(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), "metrics.n", "metrics.accuracy", F.posexplode("examples").alias("pos", "x")).select("path", "n", "accuracy", "pos", "x.correct")


def metric_table(spark: SparkSession, path: str, names: Sequence[str], key: str = "ppl") -> DataFrame:
    """(name, value) of named metric files <path>/<name>.json; null where a file is missing."""
    wanted = spark.createDataFrame([(n,) for n in names], "name string")
    found = spark.read.option("multiLine", True).schema(f"{key} double").json(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)
    return wanted.join(found.select(name.alias("name"), F.col(key).alias("value")), "name", "left")


def pointed(spark: SparkSession, path: str) -> str:
    """The path that a pointer file holds, on any file system."""
    return first_bytes(spark, path, 65_536).decode("utf-8").strip()


def stored(spark: SparkSession, name: str, settings: dict[str, object], build: Callable[[], DataFrame], folder: str | None = None, overwrite: bool = False) -> DataFrame:
    """A stage's table, kept under the hash of all its settings: read if it is there, else built and written."""
    checkpoint_folder(spark)
    root = folder or f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stages"
    key = hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{root}/{name}-{key}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")  # type: ignore[union-attr]
    if overwrite or not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


__all__ = ["all_configurations", "as_text", "corpus_texts", "field", "first_bytes", "first_split", "indexed_lines", "jsonl", "metric_table", "only_file", "pointed", "results", "sniffed_csv", "stored", "text_lines"]
