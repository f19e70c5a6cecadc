"""Scores of texts: an interface for models, and a unigram model that is a plain aggregation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from onggi.operators.tokens import Tokenizer, character_tokens

#: A continuation of which nothing remains to be scored.
UNSCORABLE = -1e9


def with_scores(df: DataFrame, prefix: str, text: str, out: str, scorer: Callable[[Sequence[str], Sequence[str]], Sequence[float]]) -> DataFrame:
    """Adds scorer(prefixes, texts), called per Arrow batch; the only place where a model is called."""
    schema = StructType([*df.schema, StructField(out, DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[out] = scorer(b[prefix].tolist(), b[text].tolist())
            yield b

    return df.mapInPandas(run, schema)


def unigram_counts(df: DataFrame, text: str, tokenizer: Tokenizer = character_tokens) -> DataFrame:
    """(token, n) of a corpus, combined before the shuffle."""
    return df.select(F.explode(tokenizer(F.col(text))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def unigram_scores(df: DataFrame, key: str, text: str, counts: DataFrame, tokenizer: Tokenizer = character_tokens) -> DataFrame:
    """(key, n_tokens, sum_logprob, avg_logprob) with add-one smoothing; below two tokens -inf and 0 tokens.

    Tokens of a text are counted first, so the join sees one row per text and distinct token."""
    total = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    per_text = df.select(F.col(key).alias("key"), F.explode(tokenizer(F.col(text))).alias("token")).groupBy("key", "token").agg(F.count(F.lit(1)).alias("m"))
    known = per_text.join(counts, "token", "left").crossJoin(F.broadcast(total))
    log_p = F.ln((F.coalesce("n", F.lit(0)) + 1) / (F.col("total") + F.col("kinds") + 1))
    sums = known.groupBy("key").agg(F.sum("m").alias("n"), F.sum(F.col("m") * log_p).alias("s"))
    rows = df.select(F.col(key).alias("key")).join(sums, "key", "left")
    enough = F.coalesce("n", F.lit(0)) >= 2
    return rows.select(
        F.col("key").alias(key), F.when(enough, F.col("n")).otherwise(F.lit(0)).alias("n_tokens"), F.when(enough, F.col("s")).otherwise(F.lit(float("-inf"))).alias("sum_logprob"),
        F.when(enough, F.col("s") / F.col("n")).otherwise(F.lit(float("-inf"))).alias("avg_logprob"),
    )


def block_losses(blocks: DataFrame, counts: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(block, n_tokens, loss): the summed loss of every token of a block but its first, under smoothed unigram counts.

    The first token of a block has no context and is not predicted. Tokens of a block are counted first, so the join sees
    one row per block and distinct token; a model goes in the same place through with_scores."""
    total = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    seen = blocks.select("block", F.explode(F.slice(F.col(tokens), F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))).alias("token")).groupBy("block", "token").agg(F.count(F.lit(1)).alias("m"))
    loss = -F.ln((F.coalesce("n", F.lit(0)) + 1) / (F.col("total") + F.col("kinds") + 1))
    known = seen.join(counts, "token", "left").crossJoin(F.broadcast(total))
    return known.groupBy("block").agg(F.sum("m").alias("n_tokens"), F.sum(F.col("m") * loss).alias("loss"))
