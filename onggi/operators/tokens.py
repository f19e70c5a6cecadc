"""Tokenizers, jamo vocabularies, labels aligned with tokens, and how much of a text a vocabulary covers.

A token is decoded and taken apart once, not once per occurrence: token ids are reduced to the distinct ones first, the
result is joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onggi.functions.hangul import KINDS, NO_FINAL, code_point, pattern

IGNORED = -100

#: A tokenizer gives the tokens of a text as an array. These two are expressions; others come as Arrow functions.
Tokenizer = Callable[[Column], Column]


def word_tokens(text: Column) -> Column:
    """Runs between blanks."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\r\n]+"), lambda w: w != "")


def character_tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")


def token_ids(tokens: Column) -> Column:
    """Stand-in ids of character tokens: their code points."""
    return F.transform(tokens, code_point)


def distinct_tokens(df: DataFrame, text: str, tokenizer: Tokenizer = word_tokens) -> DataFrame:
    """(token, n): occurrences, combined before the shuffle."""
    return df.select(F.explode(tokenizer(F.col(text))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def patterns(tokens: DataFrame, longest: int | None = 16) -> DataFrame:
    """(token, kind, label) of distinct tokens that have syllables."""
    labels = F.array(*[F.struct(F.lit(k).alias("kind"), pattern(k, F.col("token"), longest).alias("label")) for k in KINDS])
    return tokens.select("token", F.explode(labels).alias("x")).select("token", "x.kind", "x.label").where("label IS NOT NULL")


def vocabulary(*token_tables: DataFrame, longest: int = 16) -> DataFrame:
    """(label): the distinct patterns of all tables."""
    out = None
    for t in token_tables:
        p = patterns(t.select("token"), longest).select("label")
        out = p if out is None else out.unionByName(p)
    return out.distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "label", "left_anti")


def label_ids(vocab: DataFrame, first: int = 0, prefix: int = 9) -> DataFrame:
    """(label, id): ids follow the order of the labels after a base vocabulary.

    In two phases: labels are counted by their first characters (the kind and three or four jamo, so few and bounded by the
    alphabet), which gives where each prefix begins; ranks are windows within a prefix."""
    rows = vocab.select("label").withColumn("__p", F.substring("label", 1, prefix))
    counts = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__p").orderBy("label"))
    return rows.withColumn("__rank", rank).join(before, "__p").select("label", (F.col("__before") + F.col("__rank") - 1 + first).cast("int").alias("id"))


def token_texts(ids: DataFrame, decode: Callable[[Sequence[int]], Sequence[str]], token_id: str = "token_id") -> DataFrame:
    """(token_id, token): the decoded text of every distinct id of a table, called per Arrow batch; ids are decoded once."""
    import pyarrow as pa

    def run(batches):  # type: ignore[no-untyped-def]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decode(batch.column(0).to_pylist()), pa.string())], names=["token_id", "token"])

    return ids.select(F.col(token_id).cast("int").alias("token_id")).distinct().mapInArrow(run, "token_id int, token string")


def code_point_texts(ids: Sequence[int]) -> list[str]:
    """The decoder of the stand-in ids."""
    return [chr(i) for i in ids]


def check_vocabulary(vocab: DataFrame, model_rows: int, required: Sequence[str] = ("ㄱ",), token: str = "token") -> DataFrame:
    """(n_tokens, n_model_rows, sizes_agree, missing): whether a vocabulary fits a model's embedding and has what it must."""
    found = F.collect_set(F.when(F.col(token).isin(*required), F.col(token)))
    g = vocab.agg(F.count(F.lit(1)).alias("n_tokens"), found.alias("found"))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, required)), "found"))
    return g.select("n_tokens", F.lit(model_rows).cast("bigint").alias("n_model_rows"), (F.col("n_tokens") == model_rows).alias("sizes_agree"), missing.alias("missing"))


def jamo_labels(tokens: DataFrame, vocab_ids: DataFrame, flavour: str = "cpt", longest: int | None = None) -> DataFrame:
    """(token, cho, jung, jong) label ids of distinct tokens; misses are ignored labels.

    cpt: tokens without syllables are ignored. sft: they are looked up under the sign for no final instead."""
    out = tokens.select("token")
    for kind in KINDS:
        label = pattern(kind, F.col("token"), longest)
        if flavour == "sft":
            label = F.coalesce(label, F.lit(f"<{kind}:{NO_FINAL}>"))
        ids = vocab_ids.select(F.col("label").alias("__label"), F.col("id").alias(kind.lower()))
        out = out.withColumn("__label", label).join(ids, "__label", "left").drop("__label")
    return out.select("token", *[F.coalesce(F.col(k.lower()), F.lit(IGNORED)).alias(k.lower()) for k in KINDS])


def coverage(tokens: DataFrame, vocab: DataFrame, longest: int = 16) -> DataFrame:
    """(kind, n_occurrences, n_hits, coverage) over the occurrences (token, n) of tokens with syllables."""
    has = tokens.join(patterns(tokens.select("token"), longest), "token")
    known = has.join(vocab.select("label").withColumn("hit", F.lit(1)), "label", "left")
    sums = known.groupBy("kind").agg(F.sum("n").alias("n_occurrences"), F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)).alias("n_hits"))
    return sums.withColumn("coverage", F.when(F.col("n_occurrences") > 0, F.round(F.col("n_hits") / F.col("n_occurrences"), 9)).otherwise(F.lit(0.0)))


def with_tokenizer(df: DataFrame, text: str, out: str, function: Callable[[Sequence[str]], Sequence[Sequence[int]]]) -> DataFrame:
    """The ids of an external tokenizer: function(texts) -> ids, called per Arrow batch. Null is the empty text.

    A tokenizer with dropout is a function of its own (see dropout); evaluation uses the plain one."""
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    names = df.columns

    def run(batches):  # type: ignore[no-untyped-def]
        for batch in batches:
            ids = function([t or "" for t in batch.column(names.index(text)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*names, out])

    return df.mapInArrow(run, StructType([*df.schema, StructField(out, ArrayType(IntegerType()))]))


def dropout(pieces: dict[str, int], rate: float, seed: int = 42, unknown: int = 0) -> Callable[[Sequence[str]], list[list[int]]]:
    """A greedy longest-match tokenizer over pieces in which every piece of several characters is passed over at a rate.

    Draws are keyed by seed, text and position, so a text has the same ids wherever and in whatever order it is read; a rate
    of 0 is the plain tokenizer."""
    import hashlib

    longest = max(map(len, pieces), default=1)

    def run(texts: Sequence[str]) -> list[list[int]]:
        out = []
        for t in texts:
            ids, i = [], 0
            key = f"{seed}|{t}".encode()
            while i < len(t):
                for n in range(min(longest, len(t) - i), 0, -1):
                    piece = t[i : i + n]
                    if piece in pieces and (n == 1 or rate <= 0 or int.from_bytes(hashlib.blake2b(key + f"|{i}|{n}".encode(), digest_size=4).digest(), "big") >= rate * 2**32):
                        break
                else:
                    n = 1
                ids.append(pieces.get(t[i : i + n], unknown))
                i += n
            out.append(ids)
        return out

    return run
