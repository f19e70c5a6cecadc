"""Sequence packing, examples with masked labels, and batches padded to one length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onggi.functions.hangul import let
from onggi.functions.text import full_text, normalize_lines, prompt
from onggi.operators.tokens import IGNORED, Tokenizer, character_tokens, token_ids


#: Rows of one part of a running sum.
PART_ROWS = 200_000


def running_offset(df: DataFrame, order: str, size: Column, part_rows: int = PART_ROWS) -> DataFrame:
    """The rows with `offset`: the sum of `size` over the rows before, in the order of a numeric key.

    In two phases, so that no window holds all rows: the rows are cut into ranges of the key of about `part_rows` each, their
    sums are added up (one row per range), and the rest is a window within each range. Ranges come from approximate
    quantiles, whose number grows with the table."""
    counted = df.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(F.col(order), F.lit([k / 1000 for k in range(1, 1000)]), F.lit(10_000)).alias("q"))
    #: Of the 1,000 quantiles every k-th is a cut; beyond 1,000 ranges each is one.
    step = F.greatest(F.lit(1), F.floor(1000 * F.lit(part_rows) / F.greatest(F.col("n"), F.lit(1)))).cast("int")
    cuts = counted.withColumn("step", step).select(F.array_distinct(F.filter(F.coalesce("q", F.array().cast("array<bigint>")), lambda _, i: (i + 1) % F.col("step") == 0)).alias("cuts"))
    rows = df.withColumn("__size", size.cast("bigint")).crossJoin(F.broadcast(cuts)).withColumn("__part", F.size(F.filter("cuts", lambda x: x < F.col(order)))).drop("cuts")
    sums = rows.groupBy("__part").agg(F.sum("__size").alias("__sum"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__part", "__before")
    within = F.coalesce(F.sum("__size").over(Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(before), "__part").withColumn("offset", F.col("__before") + within).drop("__part", "__before", "__size")


def pack_blocks(df: DataFrame, order: str, tokens: Column, eos: str, block_size: int = 2048, min_tail: int = 16) -> DataFrame:
    """(block, tokens): all token lists in order, each followed by `eos`, cut into blocks; a short last block is dropped.

    Lists without tokens are left out. Offsets are sums over sizes only. Each list is cut at the block borders, and its
    segments go straight to their blocks: a row per list and block, not one per token."""
    rows = df.select(F.col(order).alias("__order"), tokens.alias("__tokens")).where(F.size("__tokens") > 0)
    listed = running_offset(rows, "__order", F.size("__tokens") + 1).select("offset", F.concat("__tokens", F.array(F.lit(eos))).alias("t"))
    first, last = F.floor(F.col("offset") / block_size), F.floor((F.col("offset") + F.size("t") - 1) / block_size)
    cut = listed.select("offset", "t", F.explode(F.sequence(first, last)).alias("block"))
    start = F.greatest(F.lit(0), F.col("block") * block_size - F.col("offset")).cast("int")
    until = F.least(F.size("t"), ((F.col("block") + 1) * block_size - F.col("offset")).cast("int"))
    segments = cut.select("block", (F.col("offset") + start).alias("g"), F.slice("t", start + 1, until - start).alias("s"))
    blocks = segments.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("g", "s"))).alias("x")).select(F.col("block").cast("bigint").alias("block"), F.flatten(F.transform("x", lambda p: p["s"])).alias("tokens"))
    return blocks.where((F.size("tokens") >= min_tail) | (F.size("tokens") == block_size))


def _example(a: Column, b: Column, o: Column, template: str, eos: str, max_length: int, skip_long_prompts: bool, tokenizer: Tokenizer) -> Column:
    """struct(skip_reason, input_ids, attention_mask, labels, prompt_len) of one example; null arrays where it is skipped."""
    na, nb, no = (normalize_lines(x) for x in (a, b, o))
    parts = F.struct(
        ((no == "") | ((na == "") & (nb == ""))).alias("empty"), F.size(tokenizer(prompt(a, b, template))).alias("p"),
        F.slice(token_ids(tokenizer(full_text(a, b, o, template, eos=eos))), 1, max_length).alias("ids"),
    )

    def labelled(x: Column) -> Column:
        plen = F.when(x["p"] >= max_length, F.lit(max_length - 1)).otherwise(x["p"])
        long = (x["p"] >= max_length) if skip_long_prompts else F.lit(False)
        reason = F.when(x["empty"], "empty").when(long, "long_prompt").when(F.size(x["ids"]) <= plen, "no_answer")
        return let(F.struct(x["ids"].alias("ids"), plen.alias("plen"), reason.alias("reason")), kept)

    def kept(x: Column) -> Column:
        only = lambda c: F.when(x["reason"].isNull(), c)
        labels = F.transform(x["ids"], lambda t, i: F.when(i < x["plen"], F.lit(IGNORED)).otherwise(t))
        return F.struct(
            x["reason"].alias("skip_reason"), only(x["ids"]).alias("input_ids"), only(F.transform(x["ids"], lambda _: F.lit(1))).alias("attention_mask"), only(labels).alias("labels"), only(x["plen"]).alias("prompt_len")
        )

    return let(parts, labelled)


def sft_examples(
    df: DataFrame, key: str = "rec_id", template: str = "simple", eos: str = "", max_length: int = 1024, skip_long_prompts: bool = True, tokenizer: Tokenizer = character_tokens,
    fields: Sequence[str] = ("instruction", "input", "output"),
) -> DataFrame:
    """(key, skip_reason, input_ids, attention_mask, labels, prompt_len): examples with the prompt's labels ignored.

    skip_reason is null for examples; others have it and null arrays: empty, long_prompt or no_answer, the first that
    holds. Expressions only, one narrow pass."""
    example = _example(*[F.col(f) for f in fields], template, eos, max_length, skip_long_prompts, tokenizer)  # type: ignore[misc]
    return df.select(key, example.alias("x")).select(key, "x.skip_reason", "x.input_ids", "x.attention_mask", "x.labels", "x.prompt_len")


def with_jamo_labels(examples: DataFrame, token_table: DataFrame, key: str, side: str = "") -> DataFrame:
    """Examples with cho_labels, jung_labels and jong_labels beside their ids; the prompt's are ignored, and so are tokens
    without a label.

    token_table: (token_id, cho, jung, jong) of distinct tokens (see tokens.jamo_labels). Each token position becomes one
    narrow row, is joined by its id (few ids, many positions: the labels are broadcast if they are small), and comes back by
    key; examples that were skipped keep null arrays."""
    ids, plen = f"{side}input_ids", f"{side}prompt_len"
    kinds = ("cho", "jung", "jong")
    places = examples.where(F.col(ids).isNotNull()).select(F.col(key).alias("__key"), F.col(plen).alias("__plen"), F.posexplode(ids).alias("__pos", "token_id"))
    found = places.join(token_table.select("token_id", *kinds), "token_id", "left")
    label = lambda c: F.when((F.col("__pos") >= F.col("__plen")) & F.col(c).isNotNull(), F.col(c)).otherwise(F.lit(IGNORED))
    lists = found.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("__pos", *[label(c).alias(c) for c in kinds]))).alias("x"))
    lists = lists.select(F.col("__key").alias(key), *[F.col(f"x.{c}").alias(f"{side}{c}_labels") for c in kinds])
    return examples.join(lists, key, "left")


def skip_counts(examples: DataFrame) -> DataFrame:
    return examples.groupBy(F.coalesce("skip_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def paired_examples(
    df: DataFrame, key: str = "pair_id", template: str = "simple", eos: str = "", max_length: int = 1024, skip_long_prompts: bool = True, tokenizer: Tokenizer = character_tokens
) -> DataFrame:
    """(key, noise_type, skip_reason, clean_*, noisy_*): both sides of a pair in one row; one narrow pass without a shuffle."""
    out = normalize_lines(F.col("output"))
    clean_a = F.coalesce("clean_instruction", "instruction") if "clean_instruction" in df.columns else F.col("instruction")
    clean_b = F.coalesce("clean_input", "input") if "clean_input" in df.columns else F.col("input")
    side = lambda a, b: _example(a, b, out, template, eos, max_length, skip_long_prompts, tokenizer)
    both = df.select(F.col(key), F.coalesce("noise_type", F.lit("unknown")).alias("noise_type"), side(clean_a, clean_b).alias("c"), side(F.col("noisy_instruction"), F.col("noisy_input")).alias("n"))
    clean, noisy = F.col("c.skip_reason"), F.col("n.skip_reason")
    reason = F.when(clean == "empty", "empty").when(noisy == "empty", "missing_pair").when(clean.isNotNull() | noisy.isNotNull(), "encoding")
    return both.select(key, "noise_type", reason.alias("skip_reason"), *[F.col(f"{s}.{c}").alias(f"{name}_{c}") for s, name in (("c", "clean"), ("n", "noisy")) for c in ("input_ids", "attention_mask", "labels", "prompt_len")])


def collate(df: DataFrame, order: str, columns: dict[str, int], batch_size: int, multiple: int = 8, groups: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """(batch, order, columns): arrays of a batch padded to its longest, rounded up to a multiple (1: not rounded).

    `columns`: the padding value of each array. `groups`: columns that share a width (all by default); each group is padded
    to its own longest. Batches are runs of the order key; their numbers come from the two-phase offset, so no window holds
    all rows."""
    groups = groups or [list(columns)]
    rows = running_offset(df.select(order, *columns), order, F.lit(1)).withColumn("batch", F.floor(F.col("offset") / batch_size).cast("bigint"))
    widths = {}
    for k, group in enumerate(groups):
        longest = F.greatest(*[F.size(c) for c in group]) if len(group) > 1 else F.size(group[0])
        rows = rows.withColumn(f"__w{k}", (F.ceil(F.max(longest).over(Window.partitionBy("batch")) / multiple) * multiple).cast("int"))
        widths |= dict.fromkeys(group, f"__w{k}")
    return rows.select("batch", order, *[F.concat(F.col(c), F.array_repeat(F.lit(pad), F.col(widths[c]) - F.size(c))).alias(c) for c, pad in columns.items()])


def collate_pairs(pairs: DataFrame, order: str, pad_id: int, batch_size: int, multiple: int = 8) -> DataFrame:
    """Paired examples in batches: the clean and the noisy side are padded to widths of their own. Skipped pairs leave."""
    pad = {"input_ids": pad_id, "attention_mask": 0, "labels": IGNORED, "cho_labels": IGNORED, "jung_labels": IGNORED, "jong_labels": IGNORED}
    kept = pairs.where("skip_reason IS NULL") if "skip_reason" in pairs.columns else pairs
    sides = [[f"{s}_{c}" for c in pad if f"{s}_{c}" in pairs.columns] for s in ("clean", "noisy")]
    return collate(kept, order, {c: pad[c.split("_", 1)[1]] for side in sides for c in side}, batch_size, multiple, sides)


def aligned_tokens(df: DataFrame, key: str, most: int = 20, **columns: Column) -> DataFrame:
    """(key, pos, columns...): the first positions of parallel arrays as rows, for inspection."""
    zipped = F.arrays_zip(*[c.alias(n) for n, c in columns.items()])
    return df.select(key, F.posexplode(F.slice(zipped, 1, most)).alias("pos", "x")).select(key, "pos", "x.*")


__all__ = ["aligned_tokens", "collate", "collate_pairs", "pack_blocks", "paired_examples", "running_offset", "sft_examples", "skip_counts", "with_jamo_labels"]
