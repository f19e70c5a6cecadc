"""Sinks: JSON lines, one folder per task and noise type, corpora, statistics beside outputs, CSV and Markdown tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onggi.functions.text import corpus_text


def as_json(df: DataFrame, keep_nulls: bool = True) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": str(not keep_nulls).lower()}).alias("value"))


def write_jsonl(df: DataFrame, path: str, keep_nulls: bool = True) -> None:
    as_json(df, keep_nulls).write.mode("overwrite").text(path)


def write_variants(df: DataFrame, path: str, by: Sequence[str] = ("task", "noise_type")) -> DataFrame:
    """One folder of JSON lines per task and noise type; returns their row counts."""
    lines = df.select(*[F.col(c).alias(f"__{c}") for c in by], F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    lines.toDF(*by, "value").write.mode("overwrite").partitionBy(*by).text(path)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))


def write_stats(stats: DataFrame, path: str) -> None:
    """A few aggregated rows as one JSON file beside an output."""
    as_json(stats).coalesce(1).write.mode("overwrite").text(f"{path}.stats")


def write_token_list(tokens: DataFrame, path: str, token: str = "token") -> None:
    """A vocabulary as one JSON list in order. The list is one value, so it is for vocabularies, not for texts."""
    one = tokens.agg(F.to_json(F.array_sort(F.collect_set(token))).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)


def write_corpus(df: DataFrame, path: str, fields: Sequence[str] = ("instruction", "input", "output")) -> None:
    df.select(corpus_text(*[F.col(f) for f in fields]).alias("value")).where("value IS NOT NULL").write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    out = df.select(*columns).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"')
    out.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def markdown(df: DataFrame, cells: Sequence[tuple[str, Column]], numeric: Sequence[str] = ()) -> DataFrame:
    """(pos, value): the lines of a Markdown table; cells are text columns with their headings."""
    names = [n for n, _ in cells]
    head = "| " + " | ".join(names) + " |"
    rule = "|" + "|".join("---:" if n in numeric else "---" for n in names) + "|"
    bar = F.lit(" | ")
    parts = [x for _, c in cells for x in (F.coalesce(c.cast("string"), F.lit("")), bar)][:-1]
    body = df.select(F.lit(2).alias("pos"), F.concat(F.lit("| "), *parts, F.lit(" |")).alias("value"))
    top = df.sparkSession.createDataFrame([(0, head), (1, rule)], "pos int, value string")
    return top.unionByName(body)


def metric_document(metrics: DataFrame, groups: DataFrame, examples: DataFrame, order: str, most: int = 50) -> DataFrame:
    """One JSON document: metrics, metrics per group, and the first examples in order (a bounded number)."""
    first = examples.orderBy(order).limit(most)
    m = metrics.select(F.to_json(F.struct("*")).alias("m"))
    g = groups.agg(F.to_json(F.collect_list(F.struct(*groups.columns))).alias("g"))
    e = first.agg(F.to_json(F.array_sort(F.collect_list(F.struct(order, *[c for c in examples.columns if c != order])))).alias("e"))
    return m.crossJoin(g).crossJoin(e).select(F.concat(F.lit('{"metrics": '), "m", F.lit(', "groups": '), "g", F.lit(', "examples": '), "e", F.lit("}")).alias("value"))
