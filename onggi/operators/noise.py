"""Orthographic noise on Hangul text. Every operator is an expression over a text and the base of its row's draws."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onggi.functions import draws
from onggi.functions.hangul import (
    FINALS, INITIALS, VOWELS, characters, compose, final_of, initial_of, is_syllable, let, pick, separate, vowel_of,
)
from onggi.functions.text import WHITE, as_text, normalize_lines

# Letters that are taken for each other (the first for each of the others), and common finals.
VOWEL_CONFUSIONS = {"ㅐ": "ㅔ", "ㅔ": "ㅐ", "ㅒ": "ㅖ", "ㅖ": "ㅒ", "ㅗ": "ㅜ", "ㅜ": "ㅗ", "ㅛ": "ㅠ", "ㅠ": "ㅛ", "ㅓ": "ㅗ", "ㅏ": "ㅓ", "ㅚ": "ㅙㅞ", "ㅙ": "ㅚㅞ", "ㅞ": "ㅙㅚ", "ㅢ": "ㅣㅡ"}
CONSONANT_CONFUSIONS = {"ㄱ": "ㅋㄲ", "ㅋ": "ㄱ", "ㄲ": "ㄱ", "ㄷ": "ㅌㄸ", "ㅌ": "ㄷ", "ㄸ": "ㄷ", "ㅂ": "ㅍㅃ", "ㅍ": "ㅂ", "ㅃ": "ㅂ", "ㅈ": "ㅊㅉ", "ㅊ": "ㅈ", "ㅉ": "ㅈ", "ㅅ": "ㅆ", "ㅆ": "ㅅ", "ㄴ": "ㄹ", "ㄹ": "ㄴ"}
ADDED_FINALS, REPLACING_FINALS = "ㄴㅇㄹㅁㄱ", "ㄴㅇㄹㅁㄱㅂ"
NO_SPACE_BEFORE = ".,!?;:)]}〉》』」'\""
# Spellings that follow the pronunciation, in the order in which they are tried.
PRONUNCIATIONS = (("의", "에"), ("예", "에"), ("왜", "외"), ("않", "안"), ("돼", "되"), ("되", "돼"), ("어", "으"), ("여", "이"))

PAIR_NOISES = ("spacing", "vowel", "consonant", "jong", "mixed")
BENCH_NOISES = ("clean", "spacing", "jamo", "pronunciation", "mixed")


def confusion_tables(order: Sequence[str], confusions: dict[str, str]) -> tuple[list[int], list[int]]:
    """For each letter the indices of its first and last confusion, -1 without one; confusions outside `order` are left out."""
    lists = [[order.index(x) for x in confusions.get(c, "") if x in order] for c in order]
    return [x[0] if x else -1 for x in lists], [x[-1] if x else -1 for x in lists]


_VOWEL_1, _VOWEL_2 = confusion_tables(VOWELS, VOWEL_CONFUSIONS)
_INITIAL_1, _INITIAL_2 = confusion_tables(INITIALS, CONSONANT_CONFUSIONS)
_FINAL_1, _FINAL_2 = confusion_tables(FINALS, CONSONANT_CONFUSIONS)
_FINAL_KNOWN = [int(c in CONSONANT_CONFUSIONS) for c in FINALS]
_ADDED = [FINALS.index(c) for c in ADDED_FINALS]
_REPLACING = [FINALS.index(c) for c in REPLACING_FINALS]
_HALF = draws.MODULUS // 2


def _white(c: Column) -> Column:
    return (c != "") & (F.instr(F.lit(WHITE), c) > 0)


def _each(text: Column, base: Column, body: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """body(base, all characters, character, index) for each character; base and characters are computed once."""

    def bound(x: Column) -> Column:
        return F.array_join(F.transform(x["a"], lambda c, i: body(x["b"], x["a"], c, i)), "")

    return let(F.struct(characters(text).alias("a"), base.alias("b")), bound)


def spacing(text: Column, base: Column, drop: float, insert: float) -> Column:
    """White space is dropped; spaces come after syllables, unless white space, closing punctuation or the end follows."""

    def body(b: Column, a: Column, c: Column, i: Column) -> Column:
        following = F.coalesce(F.get(a, i + 1), F.lit(""))
        d = draws.draw(b, i, 0)
        room = (following != "") & ~_white(following) & (F.instr(F.lit(NO_SPACE_BEFORE), following) == 0)
        return (
            F.when(_white(c), F.when(d < draws.below(drop), F.lit("")).otherwise(c))
            .when(is_syllable(c) & (d < draws.below(insert)) & room, F.concat(c, F.lit(" ")))
            .otherwise(c)
        )

    return _each(text, base, body)


def vowel(text: Column, base: Column, p: float) -> Column:
    def body(b: Column, _: Column, c: Column, i: Column) -> Column:
        v = vowel_of(c)
        new = F.when(draws.draw(b, i, 1) < _HALF, pick(_VOWEL_1, v)).otherwise(pick(_VOWEL_2, v))
        hit = is_syllable(c) & (draws.draw(b, i, 0) < draws.below(p))
        return F.when(hit, F.when(pick(_VOWEL_1, v) >= 0, compose(initial_of(c), new, final_of(c))).otherwise(c)).otherwise(c)

    return _each(text, base, body)


def consonant(text: Column, base: Column, p: float) -> Column:
    def body(b: Column, _: Column, c: Column, i: Column) -> Column:
        k = initial_of(c)
        new = F.when(draws.draw(b, i, 1) < _HALF, pick(_INITIAL_1, k)).otherwise(pick(_INITIAL_2, k))
        hit = is_syllable(c) & (draws.draw(b, i, 0) < draws.below(p))
        return F.when(hit, F.when(pick(_INITIAL_1, k) >= 0, compose(new, vowel_of(c), final_of(c))).otherwise(c)).otherwise(c)

    return _each(text, base, body)


def final(text: Column, base: Column, p: float) -> Column:
    """Finals are added, dropped (45 %), confused (30 %) or replaced by a common one."""

    def body(b: Column, _: Column, c: Column, i: Column) -> Column:
        t, mode, d = final_of(c), draws.draw(b, i, 1), draws.draw(b, i, 2)
        half = lambda x, y: F.when(d < _HALF, x).otherwise(y)
        confused = F.when(pick(_FINAL_KNOWN, t) == 1, F.greatest(F.lit(0), half(pick(_FINAL_1, t), pick(_FINAL_2, t)))).otherwise(half(F.lit(0), t))
        new = (
            F.when(t == 0, pick(_ADDED, draws.choice(d, len(_ADDED))))
            .when(mode < draws.below(0.45), F.lit(0))
            .when(mode < draws.below(0.75), confused)
            .otherwise(pick(_REPLACING, draws.choice(d, len(_REPLACING))))
        )
        hit = is_syllable(c) & (draws.draw(b, i, 0) < draws.below(p))
        return F.when(hit, compose(initial_of(c), vowel_of(c), new)).otherwise(c)

    return _each(text, base, body)


def jamo(text: Column, base: Column, p: float) -> Column:
    """Syllables as separate jamo."""
    return _each(text, base, lambda b, _, c, i: F.when(is_syllable(c) & (draws.draw(b, i, 0) < draws.below(p)), separate(c)).otherwise(c))


def light_spacing(text: Column, base: Column, p: float) -> Column:
    """White space is dropped with 0.7 p; a space comes between two syllables with 0.25 p."""

    def body(b: Column, a: Column, c: Column, i: Column) -> Column:
        d = draws.draw(b, i, 0)
        following = F.coalesce(F.get(a, i + 1), F.lit(""))
        return (
            F.when(_white(c), F.when(d < draws.below(p * 0.7), F.lit("")).otherwise(c))
            .when(is_syllable(c) & is_syllable(following) & (d < draws.below(p * 0.25)), F.concat(c, F.lit(" ")))
            .otherwise(c)
        )

    return _each(text, base, body)


def pronunciation(text: Column, base: Column, p: float) -> Column:
    """Each spelling that is present is replaced once with p, one after the other; then finals are dropped with 0.35 p."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (draws.draw(base, F.lit(k), 3) < draws.below(p)).alias("hit")) for k, (a, b) in enumerate(PRONUNCIATIONS)])

    def replace_first(t: Column, x: Column) -> Column:
        at = F.call_function("instr", t, x["a"])
        return F.when(x["hit"] & (at > 0), F.concat(F.substring(t, F.lit(1), at - 1), x["b"], F.substring(t, at + F.length(x["a"]), F.length(t)))).otherwise(t)

    out = F.aggregate(steps, text, replace_first)
    drop = lambda b, _, c, i: F.when(is_syllable(c) & (draws.draw(b, i, 0) < draws.below(p * 0.35)), compose(initial_of(c), vowel_of(c), F.lit(0))).otherwise(c)
    return _each(out, base, drop)


def corrupt_pair_text(text: Column, noise: str, base: Callable[[str], Column], p: float = 0.12, drop: float = 0.18, insert: float = 0.015) -> Column:
    """Noise of the instruction pairs; base(stage) gives the draws of a stage."""
    if noise == "spacing":
        return spacing(text, base("spacing"), drop, insert)
    if noise == "vowel":
        return vowel(text, base("vowel"), p)
    if noise == "consonant":
        return consonant(text, base("consonant"), p)
    if noise == "jong":
        return final(text, base("jong"), p)
    if noise == "mixed":
        t = vowel(spacing(text, base("mixed-spacing"), drop * 0.75, insert * 0.75), base("mixed-vowel"), p * 0.5)
        return final(consonant(t, base("mixed-consonant"), p * 0.4), base("mixed-jong"), p * 0.5)
    raise ValueError(f"unknown noise type: {noise}")


def corrupt_bench_text(text: Column, noise: str, base: Callable[[str], Column], p: float = 0.12) -> Column:
    """Noise of the benchmark variants."""
    if noise == "clean":
        return text
    if noise == "jamo":
        return jamo(text, base("jamo"), p)
    if noise == "spacing":
        return light_spacing(text, base("spacing"), p)
    if noise == "pronunciation":
        return pronunciation(text, base("pronunciation"), p)
    if noise == "mixed":
        t = pronunciation(light_spacing(text, base("mixed-spacing"), p), base("mixed-pronunciation"), p)
        return jamo(t, base("mixed-jamo"), p * 0.7)
    raise ValueError(f"unknown noise type: {noise}")


def once(**columns: Column) -> Column:
    """Columns computed once: as a generator's output they are neither copied into later expressions nor into filters."""
    return F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))


def noisy_pairs(
    df: DataFrame, key: str = "rec_id", noise_types: Sequence[str] = PAIR_NOISES, all_types: bool = False, noise_fields: Sequence[str] = ("instruction", "input"),
    p: float = 0.12, drop: float = 0.18, insert: float = 0.015, min_chars: int = 4, max_chars: int = 4096, keep_unchanged: bool = False, noisy_as_main: bool = False, seed: int = 42,
) -> DataFrame:
    """Clean and noisy pairs of instruction records. One noise type per record is drawn, or each record has all types.

    Filters come first, so texts that are left out are never corrupted. Narrow: no shuffle."""
    for n in noise_types:
        if n not in PAIR_NOISES:
            raise ValueError(f"unknown noise type: {n}")
    a, b, o = (normalize_lines(df[c]) for c in ("instruction", "input", "output"))
    own = [c for c in df.columns if c not in ("instruction", "input", "output", "source", "pair_id", "noise_type", "text_changed", "clean_instruction", "clean_input", "noisy_instruction", "noisy_input")]
    source = as_text(df["source"]) if "source" in df.columns else F.lit("unknown")
    rows = df.select(*own, a.alias("clean_instruction"), b.alias("clean_input"), o.alias("output"), (df["source"] if "source" in df.columns else source).alias("source"))
    n = F.length("clean_instruction") + F.length("clean_input")
    rows = rows.where((F.col("output") != "") & n.between(max(1, min_chars), max_chars))
    if all_types:
        rows = rows.withColumn("noise_type", F.explode(F.array(*map(F.lit, noise_types))))
    else:
        index = draws.choice(draws.draw(draws.base(seed, F.col(key), "noise_type"), F.lit(0), 0), len(noise_types))
        rows = rows.withColumn("noise_type", F.element_at(F.array(*map(F.lit, noise_types)), index + 1))

    #: The fields of a record go through one expression, as elements of an array.
    def noisy(x: Column) -> Column:
        out = F.when(F.lit(False), x["t"])
        for t in noise_types:
            out = out.when(F.col("noise_type") == t, corrupt_pair_text(x["t"], t, lambda stage: draws.base(seed, F.col(key), x["f"], stage), p, drop, insert))
        return out.otherwise(x["t"])

    chosen = [f for f in ("instruction", "input") if f in noise_fields]
    if chosen:
        texts = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"clean_{f}").alias("t")) for f in chosen])
        rows = rows.select("*", once(__noisy=F.transform(texts, noisy)))
    new = {f"noisy_{f}": F.element_at("__noisy", chosen.index(f) + 1) if f in chosen else F.col(f"clean_{f}") for f in ("instruction", "input")}
    rows = rows.withColumns(new).drop("__noisy")
    rows = rows.withColumn("text_changed", (F.col("clean_instruction") != F.col("noisy_instruction")) | (F.col("clean_input") != F.col("noisy_input")))
    rows = rows.withColumn("pair_id", F.concat_ws(":", F.col(key).cast("string"), F.col("noise_type")))
    side = "noisy" if noisy_as_main else "clean"
    rows = rows.withColumns({"instruction": F.col(f"{side}_instruction"), "input": F.col(f"{side}_input")})
    return rows if keep_unchanged else rows.where("text_changed")


def bench_variants(items: DataFrame, noise_types: Sequence[str] = BENCH_NOISES, p: float = 0.12, seed: int = 42, corrupt_choices: bool = False, text_fields: Sequence[str] = ("question",)) -> DataFrame:
    """Each item once per noise type. Draws are keyed by item, noise type and field, so files and order do not matter."""
    rows = items.drop("noise_type").withColumn("noise_type", F.explode(F.array(*map(F.lit, noise_types))))

    def chosen(text: Column, *key: Column | str) -> Column:
        out = F.when(F.lit(False), text)
        for t in noise_types:
            out = out.when(F.col("noise_type") == t, corrupt_bench_text(text, t, lambda stage, t=t: draws.base(seed, F.col("task"), F.col("id"), t, *key, stage), p))
        return out.otherwise(text)

    new = {f: chosen(F.col(f), f) for f in text_fields}
    if corrupt_choices:
        new["choices"] = F.transform("choices", lambda c, i: chosen(c, "choices", i))
    return rows.withColumns(new)


def corrupt_records(df: DataFrame, fields: Sequence[str], noise_types: Sequence[str] = BENCH_NOISES, p: float = 0.12, seed: int = 42) -> DataFrame:
    """bench_variants over the text fields that the records have; other fields, and choices, stay as they are.

    Records need an id and a task; a missing task counts as empty."""
    present = [f for f in fields if f in df.columns and df.schema[f].dataType.simpleString() == "string"]
    rows = df if "task" in df.columns else df.withColumn("task", F.lit(""))
    out = bench_variants(rows, noise_types, p, seed, text_fields=present)
    return out if "task" in df.columns else out.drop("task")


def _count_hits(ratio: float) -> Callable[[Column], Column]:
    return lambda x: F.size(F.filter(x["a"], lambda c, i: is_syllable(c) & (draws.draw(x["b"], i, 0) < draws.below(ratio)))).cast("bigint")


def substitute_jamo(
    df: DataFrame, key: str = "rec_id", fields: Sequence[str] = ("instruction", "input"), input_ratio: float = 0.10, output_ratio: float = 0.0, include_output: bool = False,
    mark: bool = True, clean_fields: bool = False, clean_copies: bool = False, skip_unchanged: bool = False, seed: int = 42,
) -> DataFrame:
    """Syllables as separate jamo at a given rate, with counts per field; clean copies are rows of their own, marked so."""
    if not (0 <= input_ratio <= 1 and 0 <= output_ratio <= 1):
        raise ValueError("ratios lie between 0 and 1")
    work = [(f, input_ratio) for f in fields] + ([("output", output_ratio)] if include_output else [])
    out = df
    if clean_fields:
        out = out.withColumns({f"clean_{f}": as_text(F.col(f)) for f in ("instruction", "input", "output") if f in df.columns})
    made: dict[str, Column] = {}
    changed = F.lit(False)
    for f, ratio in work:
        old = as_text(F.col(f))
        b = draws.base(seed, F.col(key), f, "jamo")
        made[f"__{f}"] = jamo(old, b, ratio) if ratio > 0 else old
        made[f"{f}_hangul"] = F.size(F.filter(characters(old), is_syllable)).cast("bigint")
        made[f"{f}_changed"] = let(F.struct(characters(old).alias("a"), b.alias("b")), _count_hits(ratio)) if ratio > 0 else F.lit(0).cast("bigint")
        changed = changed | (F.col(f"__{f}") != old)
    names = [*out.columns, *[n for n in made if not n.startswith("__")]]
    done = out.select("*", once(**made)).withColumn("__any", changed)
    new: dict[str, Column] = {f: F.col(f"__{f}") for f, _ in work}
    if mark:
        new |= {
            "jamo_substitution": F.lit(True), "jamo_input_ratio": F.lit(float(input_ratio)), "jamo_output_ratio": F.lit(float(output_ratio if include_output else 0.0)),
            "jamo_include_output": F.lit(include_output), "jamo_changed": F.col("__any"),
        }
    done = done.withColumns(new)
    if skip_unchanged:
        done = done.where("__any")
    done = done.select(*names, *[n for n in new if n not in names])
    if not clean_copies:
        return done
    zero = {f"{f}_{k}": F.lit(0).cast("bigint") for f, _ in work for k in ("hangul", "changed")}
    if mark:
        zero |= {"jamo_substitution": F.lit(False), "jamo_input_ratio": F.lit(0.0), "jamo_output_ratio": F.lit(0.0), "jamo_include_output": F.lit(False), "jamo_changed": F.lit(False)}
    copies = out.withColumns(zero).withColumn("copy", F.lit(0))
    return copies.unionByName(done.withColumn("copy", F.lit(1)))
