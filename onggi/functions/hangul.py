"""Hangul syllables and jamo as column expressions.

A precomposed syllable is U+AC00 + (initial * 21 + vowel) * 28 + final, with 19 initials, 21 vowels and 28 finals (the
first of them: none). Spark's ascii() gives the code point of a string's first character, also beyond ASCII; its chr()
does not go beyond one byte, so characters are built by position in a literal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The jamo in the order of the syllable formula.
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
FINALS = ("", *"ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ")
NO_FINAL = "_"
KINDS = ("CHO", "JUNG", "JONG")
FIRST, LAST = 0xAC00, 0xD7A3
#: The separate jamo, in code point order.
COMPAT_JAMO = "".join(map(chr, range(0x3131, 0x3164)))
_SYLLABLES = "".join(map(chr, range(FIRST, LAST + 1)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once; a lambda would otherwise compute it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def letters_of(text: str) -> Column:
    """A constant array of the characters of a text."""
    return F.split(F.lit(text), "")


def pick(table: list[int] | tuple[int, ...], index: Column) -> Column:
    """An entry of a constant table of integers."""
    return F.element_at(F.from_json(F.lit(str(list(table))), "array<int>"), index + 1)


def code_point(c: Column) -> Column:
    return F.ascii(c)


def is_syllable(c: Column) -> Column:
    return code_point(c).between(FIRST, LAST)


def initial_of(c: Column) -> Column:
    return F.floor((code_point(c) - FIRST) / 588).cast("int")


def vowel_of(c: Column) -> Column:
    return F.floor(((code_point(c) - FIRST) % 588) / 28).cast("int")


def final_of(c: Column) -> Column:
    return ((code_point(c) - FIRST) % 28).cast("int")


def compose(initial: Column, vowel: Column, final: Column) -> Column:
    """The syllable of three indices."""
    return F.element_at(letters_of(_SYLLABLES), ((initial * 21 + vowel) * 28 + final + 1).cast("int"))


def initial_jamo(c: Column) -> Column:
    return F.element_at(letters_of(INITIALS), initial_of(c) + 1)


def vowel_jamo(c: Column) -> Column:
    return F.element_at(letters_of(VOWELS), vowel_of(c) + 1)


def final_jamo(c: Column, none: str = "") -> Column:
    return F.when(final_of(c) == 0, F.lit(none)).otherwise(F.element_at(letters_of("".join(FINALS)), F.greatest(final_of(c), F.lit(1))))


def separate(c: Column) -> Column:
    """One character as its separate jamo; others unchanged."""
    return F.when(is_syllable(c), F.concat(initial_jamo(c), vowel_jamo(c), final_jamo(c))).otherwise(c)


def characters(text: Column) -> Column:
    return F.split(text, "")


def map_characters(text: Column, body: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(characters(text), body), "")


def decompose_text(text: Column) -> Column:
    """Every syllable of a text as separate jamo."""
    return map_characters(text, separate)


def syllables(text: Column) -> Column:
    """The syllables of a text, as an array."""
    return F.filter(characters(text), is_syllable)


def compose_text(text: Column) -> Column:
    """Join separate jamo into syllables: initial, vowel, and a final unless a vowel follows it.

    Where a syllable begins and which jamo it takes depends on four neighbouring characters only, so there is no scan:
    an initial before a vowel begins one; that vowel is taken; and so is a final after both, unless a vowel follows."""
    has = lambda table, c: (c != "") & (F.instr(F.lit(table), c) > 0)
    finals = "".join(FINALS)

    def body(a: Column) -> Column:
        at = lambda i: F.coalesce(F.get(a, i), F.lit(""))

        def one(c: Column, i: Column) -> Column:
            p2, p1, n1, n2, n3 = at(i - 2), at(i - 1), at(i + 1), at(i + 2), at(i + 3)
            begins = has(INITIALS, c) & has(VOWELS, n1)
            final_taken = has(finals, n2) & ~has(VOWELS, n3)
            taken_vowel = has(VOWELS, c) & has(INITIALS, p1)
            taken_final = has(finals, c) & has(INITIALS, p2) & has(VOWELS, p1) & ~has(VOWELS, n1)
            final = F.when(final_taken, F.instr(F.lit(finals), n2)).otherwise(F.lit(0))
            syllable = compose(F.instr(F.lit(INITIALS), c) - 1, F.instr(F.lit(VOWELS), n1) - 1, final)
            return F.when(begins, syllable).when(taken_vowel | taken_final, F.lit("")).otherwise(c)

        return F.array_join(F.transform(a, one), "")

    return let(characters(text), body)


def pattern(kind: str, text: Column, longest: int | None = 16) -> Column:
    """<KIND:...> of the jamo of a text's syllables; null without syllables, or with more than `longest`."""
    part = {"CHO": initial_jamo, "JUNG": vowel_jamo, "JONG": lambda c: final_jamo(c, NO_FINAL)}[kind]

    def body(s: Column) -> Column:
        named = F.concat(F.lit(f"<{kind}:"), F.array_join(F.transform(s, part), ""), F.lit(">"))
        fits = F.size(s) > 0
        return F.when(fits if longest is None else fits & (F.size(s) <= longest), named)

    return let(syllables(F.coalesce(text, F.lit(""))), body)
