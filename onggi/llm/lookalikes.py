"""Text that looks the same but differs in its characters: skeletons, and the values that need one.

The skeleton of a text: decompose it, replace every character by its prototype, decompose again. Prototypes come from a
table of look-alike letters and from rules (full-width and styled forms by their offset, compatibility ideographs and
conjoining jamo by decomposition, blanks by a space, characters that show nothing by nothing). Two texts that look the
same have the same skeleton. A value is reported if some character or sequence in it stands for another one in its
place: the context decides for look-alike letters (a word that is wholly in another script stands for itself), for
joiners (they belong to emoji) and for marks (those without a composed letter stand for themselves).

Defined results: null values are never reported and have a null skeleton; empty texts have an empty skeleton; repeated
rows are reported once per row; texts of any length are read whole; an empty table gives an empty table; only the named
columns are read, so others may have any name.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that look like a Latin letter, in the order of that letter: Greek, Cyrillic and
# further Latin ones, then Armenian, Cherokee, Coptic and Lisu ones.
LATIN_LOOKALIKES = {
    "A": "ΑАᎪⲀꓮ", "B": "ΒВᏴⲂꓐ", "C": "СϹᏟⲤꓚ", "D": "Ꭰꓓ", "E": "ΕЕᎬꓰ", "F": "Ϝꓝ", "G": "ԌᏀꓖ", "H": "ΗНᎻⲎꓧ", "I": "ΙІӀⲒꓲ", "J": "ЈͿᎫꓙ",
    "K": "ΚКᏦⲔꓗ", "L": "ԼᏞꓡ", "M": "ΜМϺᎷⲘꓟ", "N": "ΝⲚꓠ", "O": "ΟОՕⲞꓳ", "P": "ΡРᏢⲢꓑ", "Q": "Ԛ", "R": "ᎡᏒꓣ", "S": "ЅՏᏚꓢ", "T": "ΤТᎢⲦꓔ",
    "U": "Սꓴ", "V": "ѴᏙꓦ", "W": "ԜᎳꓪ", "X": "ΧХⲬꓫ", "Y": "ΥҮᎩⲨꓬ", "Z": "ΖᏃꓜ",
    "a": "аɑ", "c": "сϲⲥ", "d": "ԁᏧ", "e": "е", "g": "ɡցᶃ", "h": "һհᏂ", "i": "іıᎥ", "j": "јϳյ", "k": "κк", "l": "ӏ", "n": "ոռ", "o": "оοօⲟ", "p": "рρⲣ",
    "q": "ԛզ", "s": "ѕ", "u": "υս", "v": "νѵ", "w": "ԝ", "x": "хχ", "y": "уγү",
}
#: Look-alikes that only stand for the Latin letter in the same word as Latin ones; the others do so anywhere.
PROTOTYPES = {ord(x): k for k, xs in LATIN_LOOKALIKES.items() for x in xs}
# Characters that show nothing, and blanks that are not a plain space.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff\ufff9-\ufffb"
BLANK = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u2800\u3000\u3164\uffa0\u2028\u2029\u0085\u000b\u000c"
CONTROL = "\u0000-\u0008\u000e-\u001f\u007f-\u0084\u0086-\u009f"
VARIATION = "\ufe00-\ufe0f\U000e0100-\U000e01ef"

_nothing = re.compile(f"[{INVISIBLE}{CONTROL}{VARIATION}]")
_blank = re.compile(f"[{BLANK}]")
#: A joiner or a selector between the parts of an emoji or after a symbol is part of it.
_emoji = re.compile("(?<=[←-⯿〰〽㊗㊙\U0001f000-\U0001faff#*0-9\ufe0f\u20e3])(?:[\u200d\ufe0e\ufe0f]+(?=[←-⯿\U0001f000-\U0001faff\ufe0f\u20e3])|[\ufe0e\ufe0f])")
_jamo = re.compile("[\u1100-\u115e\u1161-\u11ff\ua960-\ua97c\ud7b0-\ud7fb]")


def _prototypes() -> dict[int, str]:
    table: dict[int, str] = dict(PROTOTYPES)
    #: Styled forms of letters (full-width, half-width, mathematical and letter-like ones) by their own decomposition.
    for o in (*range(0x2102, 0x2140), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFFEF), *range(0x1D400, 0x1D800)):
        if unicodedata.decomposition(chr(o)).startswith(("<font>", "<wide>", "<narrow>")) or 0xFB00 <= o < 0xFB07:
            table[o] = unicodedata.normalize("NFKD", chr(o))
    #: Roman numerals and the letters that they look like.
    table |= {o: unicodedata.normalize("NFKD", chr(o)) for o in range(0x2160, 0x2180)}
    #: A separate letter of the modern alphabet and the same letter of a syllable look alike.
    table |= {o: unicodedata.normalize("NFKD", chr(o)) for o in range(0x3131, 0x3164)}
    table |= {ord(k): v for k, v in {"‘": "'", "’": "'", "“": '"', "”": '"', "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-"}.items()}
    return table


_TABLE = _prototypes()
#: Every character that is not its own prototype.
_differing = re.compile("[" + "".join(sorted(map(chr, _TABLE))) + INVISIBLE + BLANK + CONTROL + VARIATION + "\u1100-\u11ff\ua960-\ua97c\ud7b0-\ud7fb]")
_styled = re.compile("[！-～｡-ﾟ￠-￦￨-￮\U0001d400-\U0001d7ffﬀ-ﬆ]")
_roman, _letterlike = re.compile("[Ⅰ-ⅿ]"), re.compile("[\u2102-\u213f]")
_own_look = re.compile("[㄰-ㅣ‘’“”‒–−]")
#: Letters of the scripts that have look-alikes, with styled ones of the same word.
_word = re.compile("[A-Za-zÀ-ɏɐ-ʯᶀ-ᶿ\u0300-\u036fͰ-ϿЀ-ԯ\u0531-\u0587Ꭰ-Ᏼ\u2102-\u213fⅠ-ⅿⲀ-\u2cffꓐ-ꓽ]+")
#: A final consonant alone and the initial one look alike: both become the initial.
_FINALS = {0x11A8 + i: chr(0x1100 + j) for i, j in zip((0, 1, 3, 6, 7, 15, 16, 18, 19, 20, 21, 22, 23, 24, 25, 26), (0, 1, 2, 3, 5, 6, 7, 9, 10, 11, 12, 14, 15, 16, 17, 18), strict=True)}
_stray_final = re.compile("(?<![\u1161-\u11a7\u11a8-\u11ff])[\u11a8-\u11c2]+")


def skeleton(text: str) -> str:
    """The form in which texts that look alike are equal."""
    if text.isascii() and not _nothing.search(text) and not _blank.search(text):
        return text
    t = unicodedata.normalize("NFD", text)
    t = _nothing.sub("", t)
    t = _blank.sub(" ", t).translate(_TABLE)
    t = _stray_final.sub(lambda m: m.group().translate(_FINALS), t)
    return unicodedata.normalize("NFD", t)


def latin_words(text: str) -> str:
    """A text with the look-alikes in words that hold a Latin letter replaced by their prototypes."""
    return _word.sub(lambda m: m.group().translate(PROTOTYPES) if re.search("[A-Za-z]", m.group()) else m.group(), text)


def differs(text: str) -> bool:
    """Whether some character of a text is not its own prototype: its skeleton is not its decomposition, or it is itself
    written with parts (a separate jamo is the prototype of its letter)."""
    if text.isascii() and not _nothing.search(text) and not _blank.search(text):
        return False
    return skeleton(text) != unicodedata.normalize("NFD", text) or unicodedata.normalize("NFC", text) != text or bool(_jamo.search(text))


def _script(ch: str) -> str:
    o = ord(ch)
    if 0x300 <= o < 0x370:
        return "mark"
    for name, lo, hi in (("Latin", 0, 0x2B0), ("Greek", 0x370, 0x400), ("Cyrillic", 0x400, 0x530), ("Armenian", 0x530, 0x590), ("Cherokee", 0x13A0, 0x1400), ("Latin", 0x1D80, 0x1DC0), ("Coptic", 0x2C80, 0x2D00), ("Lisu", 0xA4D0, 0xA500)):
        if lo <= o < hi:
            return name
    return "styled"


def _beside(text: str, start: int, end: int) -> str:
    return text[max(0, start - 1) : start] + text[end : end + 1]


def _usual(c: str) -> bool:
    return "가" <= c <= "힣" or c.isascii() and c.isalnum()


def _letter_stands(text: str, at: int, word: re.Match[str]) -> bool:
    """Whether a look-alike letter takes a Latin one's place: its word has letters of another script too, or is a look-alike
    of a Latin word beside Hangul, Latin letters or digits. A word wholly in another script stands for itself; small Greek
    letters alone are symbols (χ2, κ값), except between digits."""
    w, letter = word.group(), text[at]
    near = _beside(text, word.start(), word.end())
    scripts = {_script(c) for c in w} - {"mark", "styled"}
    if scripts == {"Latin"}:
        #: Letters of the Latin alphabets that take another one's place, such as a dotless i within an English word.
        return any(c.isascii() and c.isalpha() for c in _beside(text, at, at + 1))
    if len(scripts) > 1:
        return True
    if len(w) == 1:
        if letter.isupper() or scripts != {"Greek"}:
            return any(map(_usual, near))
        return len(near) == 2 and near.isdigit()
    return w.isupper() and all(ord(c) in PROTOTYPES for c in w) and any(map(_usual, near))


def stands(text: str, at: int, words: list[re.Match[str]]) -> bool:
    """Whether a character that is not its own prototype stands for it in its context. `words` is filled when needed."""
    ch = text[at]
    if _blank.match(ch) or _styled.match(ch) or _jamo.match(ch):
        return True
    if _nothing.match(ch):
        return True  # joiners of emoji are taken out before
    if _own_look.match(ch):
        return False
    if ch in "‐‑":
        return 0 < at < len(text) - 1 and text[at - 1].isalnum() and text[at + 1].isalnum()
    if not words:
        words += _word.finditer(text)
    word = next((m for m in words if m.start() <= at < m.end()), None)
    if word is None:
        return False
    w = word.group()
    if _roman.match(ch):
        #: A numeral ends a name (Type Ⅱ); before a letter it stands for one.
        return at + 1 < word.end() and text[at + 1].isascii()
    if _letterlike.match(ch):
        return sum(c.isascii() for c in w) >= 3  # mℓ is a unit, ℝ a symbol
    return _letter_stands(text, at, word)


def stands_for_another(text: str) -> bool:
    """Whether a text holds a character or sequence that stands for another one, or one that shows nothing or a blank.

    The characters whose prototype is another one are looked at one by one; the context can only reject them."""
    if unicodedata.normalize("NFC", text) != text:
        return True
    bare = _emoji.sub("", text)
    words: list[re.Match[str]] = []
    return any(stands(bare, m.start(), words) for m in _differing.finditer(bare))


def _long(df: DataFrame, key: str, fields: list[str], label: str) -> DataFrame:
    """(tbl, row_key, field_name, value): one row per value, without nulls."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), df[f].alias("value")) for f in fields])
    rows = df.select(F.lit(label).alias("tbl"), df[key].cast("string").alias("row_key"), F.explode(pairs).alias("x"))
    return rows.select("tbl", "row_key", "x.field_name", "x.value").where(F.col("value").isNotNull())


def lookalike_values(df: DataFrame, key: str, fields: list[str], label: str) -> DataFrame:
    """(tbl, row_key, field_name) of every value that holds what stands for another character; one narrow pass.

    The skeleton decides first: a text of prototypes only can hold nothing of the kind. The context rejects from the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = pa.array([t is not None and differs(t) and stands_for_another(t) for t in b.column(3).to_pylist()], pa.bool_())
            yield b.select([0, 1, 2]).filter(kept)

    return _long(df, key, fields, label).mapInArrow(run, "tbl string, row_key string, field_name string")


def skeletons(df: DataFrame, key: str, fields: list[str], label: str) -> DataFrame:
    """(tbl, row_key, field_name, value, skeleton) of every value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = pa.array([None if t is None else skeleton(t) for t in b.column(3).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, forms], names=["tbl", "row_key", "field_name", "value", "skeleton"])

    return _long(df, key, fields, label).mapInArrow(run, "tbl string, row_key string, field_name string, value string, skeleton string")


def skeleton_groups(values: DataFrame) -> DataFrame:
    """Groups of originals with one skeleton that are written in several ways: (skeleton_md5, n_forms, n_values, plainest form).

    Counts per original come first (combined before the shuffle), so a hot group has one row per way of writing, and
    the second aggregate combines those again; nothing gathers a group."""
    forms = values.groupBy(F.md5("skeleton").alias("skeleton_md5"), F.md5("value").alias("form")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(F.length("value").alias("l"), F.col("value").alias("v"))).alias("m")
    )
    groups = forms.groupBy("skeleton_md5").agg(F.count(F.lit(1)).alias("n_forms"), F.sum("n").alias("n_values"), F.min("m").alias("m"))
    return groups.where("n_forms > 1").select("skeleton_md5", "n_forms", "n_values", F.col("m.v").alias("shortest_form"))
