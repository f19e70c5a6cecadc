"""Normalisation of texts, prompt templates and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as in the str methods of the record formats: more than the class of regular expressions has.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_CLASS = r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# The system prompt and the two chat templates.
SYSTEM_PROMPT = "당신은 한국어로 정확하고 도움이 되는 답변을 제공하는 AI 어시스턴트입니다."
TEMPLATES = {
    "simple": ("<|system|>\n", "\n<|user|>\n", "\n<|assistant|>\n", ""),
    "qwen": ("<|im_start|>system\n", "<|im_end|>\n<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n", "<|im_end|>"),
}


def as_text(x: Column) -> Column:
    """Null is the empty text, other types their text."""
    return F.coalesce(x.cast("string"), F.lit(""))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^[{_CLASS}]+|[{_CLASS}]+$", "")


def normalize_lines(x: Column) -> Column:
    """Remove zero-width and null characters, fold blanks, at most one empty line in a row, strip."""
    t = F.regexp_replace(as_text(x), r"[\x00\u200b\ufeff]", "")
    return strip(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def normalize_flat(x: Column) -> Column:
    """The same with all white space folded to single spaces."""
    t = F.regexp_replace(as_text(x), r"[\x00\u200b\ufeff]", "")
    return strip(F.regexp_replace(t, f"[{_CLASS}]+", " "))


def infer_template(template: str, model_name: str) -> str:
    """`auto` is the template of the model family."""
    return template if template != "auto" else "qwen" if "qwen" in model_name.lower() else "simple"


def prompt(instruction: Column, inp: Column, template: str = "simple", system: str = SYSTEM_PROMPT) -> Column:
    a, b = normalize_lines(instruction), normalize_lines(inp)
    user = F.when(b != "", F.concat(a, F.lit("\n\n"), b)).otherwise(a)
    head, middle, tail, _ = TEMPLATES[template]
    return F.concat(F.lit(head), normalize_lines(F.lit(system)), F.lit(middle), user, F.lit(tail))


def full_text(instruction: Column, inp: Column, output: Column, template: str = "simple", system: str = SYSTEM_PROMPT, eos: str = "") -> Column:
    """The prompt, the answer, the template's end and the end of sequence."""
    return F.concat(prompt(instruction, inp, template, system), normalize_lines(output), F.lit(TEMPLATES[template][3] + eos))


def corpus_text(*fields: Column) -> Column:
    """Non-empty fields joined by line ends; line ends in one form; null if nothing is left."""
    parts = F.filter(F.array(*[as_text(f) for f in fields]), lambda x: x != "")
    return F.nullif(F.regexp_replace(strip(F.array_join(parts, "\n")), "\r\n", "\n"), F.lit(""))


def safe_name(x: Column) -> Column:
    """Separators of paths, extensions and drives as underscores."""
    return F.translate(x, "/.: ", "____")


def rate_tag(x: Column) -> Column:
    """A learning rate as part of a file name."""
    return F.regexp_replace(F.translate(x, "-", "m"), r"\.", "")


def cache_name(stem: Column, path: Column, *tags: Column) -> Column:
    """A file name that is the same for the same source and settings."""
    return F.concat_ws(".", stem, F.substring(F.md5(path), 1, 8), *tags)
