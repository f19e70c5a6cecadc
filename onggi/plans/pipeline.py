"""The data side of continued pre-training and instruction tuning as one chain of stored stages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onggi.functions.text import corpus_text, infer_template, rate_tag
from onggi.operators import noise, pack, tokens
from onggi.sources.records import stored


@dataclass(frozen=True)
class PipelineSettings:
    """Every setting that changes a stage's rows; each is part of the key under which its stage is kept."""

    input_ratio: float = 0.05
    output_ratio: float = 0.0
    include_output: bool = False
    clean_copies: bool = False
    seed: int = 42
    block_size: int = 1024
    min_tail: int = 16
    max_length: int = 1024
    template: str = "auto"
    model_name: str = ""
    eos: str = "</s>"
    skip_long_prompts: bool = True
    longest_pattern: int = 16


def run(spark: SparkSession, records: DataFrame, name: str, settings: PipelineSettings | None = None, key: str = "rec_id", folder: str | None = None, overwrite: bool = False) -> dict[str, DataFrame]:
    """The stages of a named set of records: substituted, corpus, vocabulary, blocks, examples.

    A stage that exists under its settings is read, not built. Required columns are checked before anything runs."""
    s = settings or PipelineSettings()
    missing = [c for c in (key, "instruction", "input", "output") if c not in records.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    everything = {"name": name, **asdict(s)}
    keep = lambda stage, build: stored(spark, f"{name}-{stage}", everything | {"stage": stage}, build, folder, overwrite)
    substituted = keep(
        "substituted",
        lambda: noise.substitute_jamo(records, key, input_ratio=s.input_ratio, output_ratio=s.output_ratio, include_output=s.include_output, clean_copies=s.clean_copies, seed=s.seed).select(key, "instruction", "input", "output"),
    )
    corpus = keep("corpus", lambda: substituted.select(key, corpus_text(F.col("instruction"), F.col("input"), F.col("output")).alias("text")).where("text IS NOT NULL"))
    vocab = keep("vocabulary", lambda: tokens.label_ids(tokens.vocabulary(tokens.distinct_tokens(corpus, "text"), longest=s.longest_pattern)))
    blocks = keep("blocks", lambda: pack.pack_blocks(corpus, key, tokens.word_tokens(F.col("text")), s.eos, s.block_size, s.min_tail))
    template = infer_template(s.template, s.model_name)
    examples = keep("examples", lambda: pack.sft_examples(substituted, key, template, s.eos, s.max_length, s.skip_long_prompts))
    return {"substituted": substituted, "corpus": corpus, "vocabulary": vocab, "blocks": blocks, "examples": examples}


def sweep(spark: SparkSession, name: str, rates: Sequence[str], seeds: Sequence[int]) -> DataFrame:
    """(rate, seed, run): every combination of a sweep with the name of its run."""
    grid = spark.createDataFrame([(r, s) for r in rates for s in seeds], "rate string, seed int")
    return grid.withColumn("run", F.concat(F.lit(f"{name}_lr"), rate_tag(F.col("rate")), F.lit("_seed"), F.col("seed").cast("string")))
