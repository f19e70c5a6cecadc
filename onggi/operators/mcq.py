"""Multiple-choice benchmarks: records of many shapes parsed to one, duplicates removed, prompts and predictions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onggi.functions.hangul import let
from onggi.functions.text import strip
from onggi.operators.noise import BENCH_NOISES, bench_variants, once

# The keys under which records hold a question, choices and an answer, in the order in which they count.
QUESTION_KEYS = ("question", "query", "input", "premise", "sentence", "context", "paragraph", "passage")
CHOICE_KEYS = ("choices", "options", "candidates", "answer_choices")
LETTER_KEYS = ("A", "B", "C", "D", "E", "a", "b", "c", "d", "e", "option1", "option2", "option3", "option4", "option5")
ANSWER_KEYS = ("answer", "label", "gold", "target", "correct", "correct_answer")
ID_FIELDS = ("id", "task", "subset", "question", "choices", "answer", "source")
# Question parts (label, key), closing words, and the choices or their keys, of the named subsets.
NAMED_SUBSETS: dict[str, tuple[tuple[tuple[str, str], ...], str, tuple[str, ...], bool]] = {
    "boolq": ((("지문: ", "paragraph"), ("질문: ", "question")), "", ("아니오", "예"), False),
    "copa": ((("전제: ", "premise"), ("질문 유형: ", "question")), "", ("alternative_1", "alternative_2"), True),
    "hellaswag": ((("문맥: ", "context"),), "다음에 이어질 가장 자연스러운 문장은?", ("ending_1", "ending_2", "ending_3", "ending_4"), True),
    "sentineg": ((("문장: ", "sentence"),), "이 문장의 감성은?", ("부정", "긍정"), False),
    "wic": ((("단어: ", "word"), ("문맥 1: ", "context_1"), ("문맥 2: ", "context_2")), "두 문맥에서 단어 의미가 같은가?", ("다르다", "같다"), False),
}


def resolve_answer(answer: Column, choices: Column, base: str = "either") -> Column:
    """The 0-based index that an answer names: a number, a letter A to E, or the text of a choice; null if none does.

    base: `either` reads a number as 0-based where that is in range, else as 1-based; `0` and `1` fix it."""

    def resolve(x: Column) -> Column:
        s, n = x["s"], F.size(x["c"])
        number = F.when(s.rlike("^[0-9]{1,9}$"), s.cast("int"))
        zero, one = F.when((number >= 0) & (number < n), number), F.when((number >= 1) & (number <= n), number - 1)
        by_number = {"either": F.coalesce(zero, one), "0": zero, "1": one}[base]
        letter = F.when((F.length(s) == 1) & (F.instr(F.lit("ABCDEabcde"), s) > 0), (F.instr(F.lit("ABCDEabcde"), s) - 1) % 5)
        by_text = F.nullif(F.array_position(x["t"], s), F.lit(0)) - 1
        return F.coalesce(by_number, F.when(letter < n, letter), by_text).cast("int")

    return let(F.struct(strip(answer).alias("s"), choices.alias("c"), F.transform(choices, strip).alias("t")), resolve)


def _get(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "string")


def _python_text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def extract_items(raw: DataFrame, record: str = "record", task: str = "task", subset: str = "subset", index: str = "idx", source: str = "source", with_index: bool = False) -> DataFrame:
    """(id, task, subset, question, choices, answer, source) of raw JSON records, with `idx` if asked; unusable records are
    left out.

    One pass of expressions over a variant: no schema is inferred, no record is parsed twice."""
    v = F.parse_json(F.col(record))
    rows = raw.select(F.col(task).alias("task"), F.col(subset).alias("subset"), F.col(index).alias("idx"), F.col(source).alias("source"), v.alias("v"))
    v = F.col("v")
    sub = F.lower("subset")
    known = dict.fromkeys((*QUESTION_KEYS, *LETTER_KEYS, *ANSWER_KEYS, "id", *[k for parts, _, options, own in NAMED_SUBSETS.values() for k in (*[k for _, k in parts], *(options if own else ()))]))
    #: Each field is read once; later expressions name its column. Field names differ by more than their case, so they are numbered.
    at = {k: f"__{i}" for i, k in enumerate(known)}
    rows = rows.select("*", once(**{at[k]: _get(v, k) for k in known}, **{f"__c{i}": F.coalesce(F.try_variant_get(v, f"$.{k}", "array<string>"), F.from_json(F.try_variant_get(v, f"$.{k}", "string"), "array<string>")) for i, k in enumerate(CHOICE_KEYS)}))
    get = lambda k: F.col(at[k])
    filled = lambda k: F.when(strip(get(k)) != "", get(k))
    is_named = (F.col("task") == "kobest") & sub.isin(*NAMED_SUBSETS)
    named_q, named_c = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.array(F.lit("")))
    for name, (parts, closing, options, from_record) in NAMED_SUBSETS.items():
        here = is_named & (sub == name)
        named_q = named_q.when(here, F.concat(*[x for label, k in parts for x in (F.lit(label), _python_text(get(k)))], F.lit(closing)))
        named_c = named_c.when(here, F.array(*[_python_text(get(k)) if from_record else F.lit(k) for k in options]))
    #: Of several keys with choices the last one counts.
    letters = F.filter(F.array(*[filled(k) for k in LETTER_KEYS]), lambda x: x.isNotNull())
    listed = F.coalesce(*[F.col(f"__c{i}") for i in reversed(range(len(CHOICE_KEYS)))], letters)
    rows = rows.select("*", once(question=strip(F.when(is_named, named_q).otherwise(F.coalesce(*[filled(k) for k in QUESTION_KEYS]))), __all=F.when(is_named, named_c).otherwise(listed)))
    rows = rows.withColumn("__all", F.when(F.size("__all") >= 2, F.col("__all")))
    given = [F.when(is_named, get("label")).otherwise(get(k)) for k in ANSWER_KEYS]
    rows = rows.select("*", once(answer=F.coalesce(*[resolve_answer(g, F.col("__all")) for g in given])))
    rows = rows.withColumns(
        {"choices": F.when(is_named, F.col("__all")).otherwise(F.transform("__all", strip)), "id": F.coalesce(get("id"), F.concat_ws("-", F.col("subset"), F.col("idx").cast("string")))}
    )
    usable = F.col("answer").isNotNull() & (is_named | (F.col("question") != "")) & F.col("choices").isNotNull()
    return rows.where(usable).select(*(["idx"] if with_index else []), *ID_FIELDS)


def usable_items(raw: DataFrame, record: str = "record", task: str = "task", subset: str = "subset", index: str = "idx", source: str = "source") -> DataFrame:
    """extract_items with `idx`; the records of a task whose first one is an item already are taken as they are.

    Whether they are is told per task from its first record (one row per task)."""
    v = F.try_parse_json(F.col(record))
    has = lambda k: F.try_variant_get(v, f"$.{k}", "variant").isNotNull()
    done = has("question") & has("choices") & has("answer") & has("task")
    first = raw.groupBy(F.col(task).alias("__task")).agg(F.min_by(done, F.col(index)).alias("__done"))
    marked = raw.join(F.broadcast(first), F.col(task).eqNullSafe(F.col("__task"))).drop("__task")
    ready = marked.where("__done").select(F.col(index).alias("idx"), F.col(task).alias("file_task"), v.alias("v"))
    get = lambda k, kind="string": F.try_variant_get("v", f"$.{k}", kind)
    ready = ready.select("idx", get("id").alias("id"), get("task").alias("task"), get("subset").alias("subset"), get("question").alias("question"), get("choices", "array<string>").alias("choices"), get("answer", "int").alias("answer"), get("source").alias("source"), "file_task")
    parsed = extract_items(marked.where(~F.col("__done")), record, task, subset, index, source, with_index=True)
    return parsed.withColumn("file_task", F.col("task")).unionByName(ready)


def benchmark_chain(raw: DataFrame, noise_types: Sequence[str] = BENCH_NOISES, most: int | None = 2000, **settings: object) -> DataFrame:
    """Raw records to variants: parse (or take as they are), keep the first of equal items in file order, at most `most`
    items per task in that order, and each of these once per noise type."""
    items = first_of_duplicates(usable_items(raw), ("file_task", "idx", "id"), ("file_task", "question", "choices", "answer"))
    kept = limited(items, "idx", most, "rows", by=("file_task",))
    return bench_variants(kept.drop("idx", "file_task"), noise_types, **settings)  # type: ignore[arg-type]


def first_of_duplicates(items: DataFrame, order: Sequence[str] = ("id",), keys: Sequence[str] = ("question", "choices", "answer")) -> DataFrame:
    """The first row of each group of equal items. Candidates are combined before the shuffle by their least order."""
    whole = F.struct(*[F.col(c) for c in (*order, *[c for c in items.columns if c not in order])])
    return items.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min(whole).alias("x")).select(*[F.col(f"x.{c}").alias(c) for c in items.columns])


def prompt_prefix(question: Column, choices: Column) -> Column:
    lines = F.transform(choices, lambda c, i: F.concat(F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), i + 1, 1), F.lit(". "), c))
    return F.array_join(F.concat(F.array(F.concat(F.lit("질문: "), strip(question)), F.lit("선택지:")), lines, F.array(F.lit("정답:"))), "\n")


def best_choice(scores: Column) -> Column:
    """The index of the highest score, the first of ties; null scores do not count."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def limited(df: DataFrame, order: str, most: int | None, rule: str = "rows", keep: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Row limits of the record formats: `index` counts positions, `rows` rows that exist, `kept` rows that pass `keep`.

    With `by` each group is limited: ranks are bounded by the limit, so every task keeps at most `most` rows of a group
    before they are shuffled and ranked."""
    if rule == "index":
        out = df if most is None else df.where(F.col(order) < most)
        return out if keep is None else out.where(keep)
    if rule == "kept" and keep is not None:
        df = df.where(keep)
    if most:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(order)) if by else None
        df = df.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank") if rank is not None else df.orderBy(order).limit(most)
    return df if keep is None or rule == "kept" else df.where(keep)


Scorer = Callable[[list[str], list[str]], list[float]]
