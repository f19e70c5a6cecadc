"""Text statistics per document, and the documents that are not natural prose.

A document has three distributions: of its characters over classes, of its words over function words and other forms,
and of its lines over structural forms (sentence, entry, row, noise), weighted by their characters. The first two are
compared with the prose profile of the script by Jensen-Shannon divergence; lines that are far from it count as noise.
The last is assigned the nearest structural profile, again by Jensen-Shannon divergence: prose, list, table or junk.

Defined results: null, empty and blank texts have zero counts, null ratios and no kind; repeated rows have a row each;
texts are read whole at any length; equal distances go to the first profile in the order prose, list, table, junk; an
empty table gives an empty table; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onggi.llm.lookalikes import PROTOTYPES, latin_words

KINDS = ("prose", "list", "table", "junk")

#: Shares of the structural forms (sentence, entry, row, noise) of each kind.
STRUCTURAL_PROFILES = {"prose": (0.94, 0.03, 0.01, 0.02), "list": (0.03, 0.94, 0.02, 0.01), "table": (0.02, 0.03, 0.94, 0.01), "junk": (0.02, 0.02, 0.02, 0.94)}

#: Character classes, and their shares in prose by main script (fitted on prose of these languages).
CHAR_CLASSES = ("common syllable", "rare syllable", "jamo", "kana", "han", "vowel", "consonant", "capital", "accented", "digit", "blank", "stop", "quote or comma", "symbol")
PROSE_CHARS = {
    "ko": (0.745, 0.003, 0.003, 0.0, 0.002, 0.003, 0.004, 0.003, 0.0, 0.017, 0.197, 0.018, 0.004, 0.001),
    "ja": (0.0, 0.0, 0.0, 0.74, 0.17, 0.0, 0.0, 0.0, 0.0, 0.03, 0.01, 0.03, 0.02, 0.0),
    "zh": (0.0, 0.0, 0.0, 0.0, 0.86, 0.0, 0.0, 0.0, 0.0, 0.02, 0.01, 0.04, 0.07, 0.0),
    "latin": (0.0, 0.0, 0.0, 0.0, 0.0, 0.305, 0.45, 0.025, 0.006, 0.012, 0.17, 0.014, 0.012, 0.006),
}
#: Word forms (function word, other word, number, fused string, mark) in prose.
PROSE_WORDS = {"ko": (0.62, 0.33, 0.04, 0.005, 0.005), "ja": (0.8, 0.18, 0.01, 0.005, 0.005), "zh": (0.02, 0.94, 0.02, 0.01, 0.01), "latin": (0.42, 0.55, 0.02, 0.005, 0.005)}
#: Divergences (base 2) up to which characters and words count as prose of their script.
CHAR_LIMIT, WORD_LIMIT = 0.2, 0.5

_COMMON = frozenset(c for c in map(chr, range(0xAC00, 0xD7A4)) if len(c.encode("euc_kr", "replace")) == 2)
_CLASS = {}
for _c in map(chr, range(0xAC00, 0xD7A4)):
    _CLASS[_c] = 0 if _c in _COMMON else 1
_CLASS |= {chr(o): 2 for o in [*range(0x3131, 0x318F), *range(0x1100, 0x1200)]}
_CLASS |= {chr(o): 3 for o in [*range(0x3041, 0x3100), *range(0xFF66, 0xFF9E)]} | {"ー": 3}
_CLASS |= {chr(o): 4 for o in [*range(0x4E00, 0xA000), *range(0xF900, 0xFB00)]}
_CLASS |= {c: 5 for c in "aeiouyäöüéèêáàóòúíì"} | {c: 6 for c in "bcdfghjklmnpqrstvwxzßñç"}
#: Letters of other alphabets count as vowels, consonants and capitals too.
_CLASS |= {chr(o): 5 if chr(o) in "аеёиоуыэюяіїєαεηιουωάέήίόύώ" else 6 for o in [*range(0x3B1, 0x3CF), *range(0x430, 0x460)]} | {chr(o): 7 for o in [*range(0x391, 0x3AA), *range(0x400, 0x430)]}
_CLASS |= {c: 5 for c in "âêîôûëïÿãõåøæœ"}
_CLASS |= {chr(o): 7 for o in range(65, 91)} | {c: 7 for c in "ÄÖÜÉ"} | {c: 9 for c in "0123456789"} | {c: 10 for c in " \t\n\r\u3000\u00a0"}
_CLASS |= {c: 11 for c in ".!?。！？…~"} | {c: 12 for c in "\"',、，“”‘’「」()"}
for _o in [*range(0x80, 0xA0), *range(0xA1, 0x180)]:
    _CLASS.setdefault(chr(_o), 8)
#: Marks that show nothing and full-width letters count as what they stand for.
_IGNORED = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff\u0300-\u036f\ufe0f\u0000]")
_WIDE = {o: o - 0xFEE0 for o in range(0xFF01, 0xFF5F)} | {0xFF0E: ".", 0x3000: " ", 0x00A0: " ", 0x2007: " ", 0x2009: " ", 0x202F: " ", 0x3164: " "}
_TRANSLATED = re.compile("[" + "".join(map(chr, _WIDE)) + "]")
_LOOKS = re.compile("[" + "".join(map(chr, PROTOTYPES)) + "]")

_LINES = re.compile("\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_MARK = re.compile(r"\s*(?:[-–—•*·▪◦‣○●■□▶▷※☞✓+→]|\(?\d{1,3}[.)]|[①-⑳]|[가-힣][.)]|\(?[a-zA-Z][.)]|\[[ xX]?\])\s+")
#: Strings that look like special tokens stand between texts.
_SPECIAL = re.compile(r"<\|[a-zA-Z_]{1,24}\|>|</?s>|\[/?INST\]")
_TAG = re.compile(r"<[/a-zA-Z!][^<>]*>|&[a-z]+;")
_BORDER = re.compile(r"[\s│┃|+\-─━┌┐└┘├┤┬┴┼═║╔╗╚╝:=_]+")
_FIELD = re.compile(r"\s*[^\s:：=.!?][^:：=.!?]{0,23}\s*[:：=]\s*(?!//)[^:：]{0,60}$")
_STOP = re.compile(r"[.!?。！？…~]+[\"'”’」)\]]*\s*$")
#: Laughter, tears and interjections at the end of a chat line.
_CHAT_MARKS = " \t\r\n~!?.^;\"')]…♡♥❤ㅋㅎㅠㅜㅇㄱㄷㄹㅂㅅㄴ🙂😂🙏"
_CHAT_WORDS = (" 헐", " 와", " 아 진짜", " 어 진짜", " 진짜", " 그니까", " 음", " 근데")
_PREDICATE = re.compile(r"(?:다|요|죠|까|네|야|해|함|음|임|군|걸|래|자|지|니|라|데|고|며|면|서|든가|네요|거든)$")
_PARTICLE = re.compile(r"[가-힣A-Za-z0-9)\"](?:은|는|이|가|을|를|에|의|로|으로|와|과|도|만|에서|에게|까지|부터|보다|처럼|라고|마다|으며|이며|하고|며|고|서|면|다|요|한다|했다|라면|지만|쪽|때)$")
_ITEM = re.compile(r"\s*(?:, | / |; | · |、| \| )\s*")
_WORD = re.compile(r"\S+")
_FUSED = re.compile(r"(?=[0-9a-zA-Z+/=_-]{12,}$)(?=.*\d).*|[0-9a-zA-Z+/=_-]{26,}$|[0-9a-f]{8,}$")
_HIRAGANA = re.compile("[ぁ-ゟ]")

# Korean words that stand alone without a particle.
KO_FUNCTION_WORDS = frozenset("그 이 더 안 뒤 수 모두 그리고 하지만 특히 결국 다만 또한 만약".split())
# Frequent function words of English and German, then of French, Spanish, Italian, Portuguese, Dutch and Russian.
FUNCTION_WORDS = frozenset(
    """the of and a in is was it to that not for with are be we an from there had they so if will again most more still then only as at by on or but his
    her he she you i this which their has have were when what who why how because however after before do does did don't didn't they'd heard can could would
    should over into no like even its no one out up also than them my our your each until while please some any all been about between under through
    die der das und nicht eine ein zu von haben hat wurde war es mit sie aber dass noch man mehr den dem des im am ist sind auf für an doch nur davon weil
    blieben als auch wenn wie wird werden bei nach aus zum zur über jede jeder einen einem einer nichts gibt warum bitte ich wir ihr sich oder so seit
    le la les des une un est et dans pour que qui sur avec pas plus sont ce cette au aux du de en elle il nous vous ils être fait mais comme par leur se
    el los las es y con por más del al lo su como pero este esta fue han hay muy también cuando
    il gli è e per che non di della nel nella sono anche ma questo questa si ha hanno perché
    o os as um uma é para não do da na são também mas foi tem
    het een van dat niet met voor zijn op te aan ook maar als bij er naar uit deze wordt werd hebben kan
    и в во не на я он она они мы вы что это как с со а но к у из за по от о для был была было были есть так же его её их только еще уже или если когда чтобы при до""".split()
)


def divergence(p: list[float] | tuple[float, ...], q: tuple[float, ...]) -> float:
    """Jensen-Shannon divergence in bits: 0 for equal distributions, 1 for disjoint ones."""
    total = 0.0
    for a, b in zip(p, q, strict=True):
        m = (a + b) / 2
        if a > 0:
            total += a * math.log2(a / m)
        if b > 0:
            total += b * math.log2(b / m)
    return total / 2


def _char_shares(text: str) -> tuple[dict[str, float], list[float]]:
    """The shares of the scripts among the letters, and the shares of the character classes."""
    counts = [0] * len(CHAR_CLASSES)
    get = _CLASS.get
    for ch, n in Counter(text).items():
        counts[get(ch, 13)] += n
    #: Han almost without kana is Chinese.
    chinese = counts[3] * 20 < counts[4]
    letters = {"ko": counts[0] + counts[1] + counts[2], "ja": 0 if chinese else counts[3] + counts[4], "zh": counts[3] + counts[4] if chinese else 0, "latin": counts[5] + counts[6] + counts[7] + counts[8]}
    n, m = max(1, len(text)), sum(letters.values())
    return {k: v / m if m else k == "latin" for k, v in letters.items()}, [c / n for c in counts]


def _profile(profiles: dict[str, tuple[float, ...]], scripts: dict[str, float]) -> tuple[float, ...]:
    """Prose that mixes scripts: their profiles in the same shares."""
    return tuple(sum(scripts[k] * profiles[k][i] for k in profiles) for i in range(len(profiles["ko"])))


_FORMS: dict[str, int] = {}


def _word_form(w: str) -> int:
    """0 function word, 1 other word, 2 number, 3 fused string, 4 mark."""
    bare = w.strip(".,!?~()\"'“”‘’:;…。、")
    if not any(map(str.isalnum, bare)):
        k = 4
    elif bare[0].isdigit() and sum(map(str.isdigit, bare)) * 2 >= len(bare) and len(bare) < 12:
        k = 2
    elif bare.isascii():
        k = 3 if len(bare) >= 8 and _FUSED.match(bare) else 0 if bare.lower() in FUNCTION_WORDS else 1
    elif _PARTICLE.search(bare) or bare in KO_FUNCTION_WORDS or _HIRAGANA.search(bare) or bare.lower() in FUNCTION_WORDS:
        k = 0
    else:
        k = 1
    if len(_FORMS) > 300_000:  # forms of words seen are kept, up to a bound
        _FORMS.clear()
    _FORMS[w] = k
    return k


def _word_forms(words: list[str]) -> list[int]:
    """Numbers of words by their form."""
    counts = [0, 0, 0, 0, 0]
    get = _FORMS.get
    for w in words:
        k = get(w)
        counts[_word_form(w) if k is None else k] += 1
    return counts


def _form(line: str, script: str) -> int:
    """The structural form of one line: 0 sentence, 1 entry, 2 row, 3 noise."""
    line = line.strip(" ")
    line = line if _MARK.match(line) else line.lstrip()
    n = len(line)
    if line.count("│") + line.count("|") >= 2 or line.count("\t") >= 1 and len(line.strip("\t").split("\t")) >= 2 or (n > 2 and _BORDER.fullmatch(line)):
        return 2
    if line.count(",") >= 1 and not _STOP.search(line) and (line.count(",") > line.count(", ") or line.endswith(",")) and line.count(", ") * 3 <= line.count(","):
        return 2
    body = line.strip()
    if "  " in body and not _STOP.search(body) and len(re.split(r" {2,}", body)) * 30 >= len(body) and not _ends(body, script):
        return 2
    if ("<" in line or "&" in line) and sum(len(m.group()) for m in _TAG.finditer(line)) * 5 >= n * 2:
        return 3
    marked = _MARK.match(line)
    rest = line[marked.end() :].strip() if marked else body
    if not marked and _FIELD.match(line) and not _ends(body, script):
        return 2
    if marked and len(rest) <= 60 and not (_STOP.search(rest) and _ends(rest, script)):
        return 1
    items = _ITEM.split(rest) if rest.count(",") + rest.count("/") + rest.count(";") + rest.count("·") >= 2 else ()
    if len(items) >= 5 and len(rest) <= 22 * len(items) and not _STOP.search(rest) and sum(_ends(x, script) for x in items) * 3 <= len(items):
        return 1
    if len(items) >= 3 and sum(map(len, items)) <= 26 * len(items) and not _ends(rest, script):
        return 1
    if _ends(rest, script):
        return 0
    if script == "latin":
        words = rest.split()
        share = _word_forms(words)[0] / max(1, len(words))
        if n > 100 and not re.search(r"[.!?]", line):
            return 3
        if share >= 0.18 and len(words) >= 4:
            return 0
        return 1 if len(rest) <= 60 else 3
    if script == "zh":
        return 1 if len(rest) <= 40 else 3
    if script == "ja":
        hira = len(_HIRAGANA.findall(rest))
        if hira * 4 >= len(rest) and len(rest) > 12:
            return 0
        return 1 if len(rest) <= 40 else 3
    words = rest.split()
    share = _word_forms(words)[0] / max(1, len(words))
    if share >= 0.3 and len(words) >= 4:
        return 0
    return 1 if len(rest) <= 45 else 3


def _ends(text: str, script: str) -> bool:
    """Whether a line reads as ending a sentence."""
    if script == "ko":
        bare = text.rstrip(_CHAT_MARKS)
        while bare.endswith(_CHAT_WORDS):
            bare = bare[: bare.rindex(" ")].rstrip(_CHAT_MARKS)
        last = bare.rsplit(None, 1)
        if not bare:
            return bool(text)
        return bool(_PREDICATE.search(bare)) and (len(last) > 1) and (len(bare) > 14 or bool(_STOP.search(text)) or bare[-1] in "다요죠까")
    if script == "zh":
        return len(text) > 6 and bool(re.search(r"[。！？!?…][」』”\"）)]*$", text))
    if script == "ja":
        return bool(re.search(r"(?:[。！？!?]|です|ます|した|せん|ない|った|さい)[」』\"）)]*$", text))
    if not _STOP.search(text):
        return False
    words = text.split()
    return _word_forms(words)[0] * 8 >= len(words) and len(words) >= 3


def kind_of(text: str | None) -> str | None:
    """prose, list, table or junk; None where there is no text."""
    if text is None or not (t := _SPECIAL.sub("\n", _IGNORED.sub("", text))).strip():
        return None
    if _TRANSLATED.search(t):
        t = t.translate(_WIDE)
    if _LOOKS.search(t):
        t = latin_words(t)
    if not unicodedata.is_normalized("NFC", t):
        t = unicodedata.normalize("NFC", t)
    scripts, chars = _char_shares(t)
    words = _WORD.findall(t)
    far = divergence(chars, _profile(PROSE_CHARS, scripts))
    n_words = max(1, len(words))
    shares = [c / n_words for c in _word_forms(words)]
    odd = divergence(shares, _profile(PROSE_WORDS, scripts))
    main = max(scripts, key=scripts.__getitem__)
    mixed = scripts[main] < 0.9
    weights = [0.0, 0.0, 0.0, 0.0]
    for line in _LINES.split(t):
        if line.strip():
            own = _char_shares(line)[0] if mixed else scripts
            weights[_form(line, max(own, key=own.__getitem__) if mixed else main)] += len(line)
    total = sum(weights)
    #: Endless repetition: of all runs of four words, at most a fifth differ.
    runs = len(words) - 3
    repeated = runs >= 12 and len(set(zip(words, words[1:], words[2:], words[3:], strict=False))) * 5 <= runs
    if repeated or chars[1] > 0.15 or chars[2] > 0.4 or chars[8] > 0.2 or shares[3] > 0.5:
        weights = [0.0, 0.0, 0.0, total]
    elif far > CHAR_LIMIT or odd > WORD_LIMIT:
        #: Far from prose: what read as a sentence is noise; rows and entries hold such characters by nature, unless symbols rule.
        weights[3] += weights[0]
        weights[0] = 0.0
        if chars[13] > 0.4 and weights[2] < 0.5 * total or chars[13] > 0.6:
            weights = [0.0, 0.0, 0.0, total]
    structure = [w / total for w in weights]
    return min(KINDS, key=lambda k: divergence(structure, STRUCTURAL_PROFILES[k]))


def structural_kinds(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind) of every document with text; one narrow pass."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = pa.array([kind_of(t) for t in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), kinds], names=["id", "kind"])

    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"id {id_type}, kind string").where("kind IS NOT NULL").withColumnRenamed("id", id_col)


def text_statistics(df: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, n_words, mean_word_len, symbol_ratio, line_stop_share, common_share): built-in expressions only.

    Words are runs between white space. Symbols are what is neither letter, digit nor white space. The list of common
    words is folded to one array per language; it is joined by its hash and only as large as the word lists themselves."""
    text = F.coalesce(df[text_col], F.lit(""))
    per_lang = common_words.groupBy(F.col("lang").alias("__lang")).agg(F.collect_set("word").alias("__common"))
    base = df.select(df[id_col].alias("id"), df[lang_col].alias("lang"), text.alias("t"))
    words: Column = F.filter(F.split(F.col("t"), r"[ \t\n\r]+"), lambda w: w != "")
    lines: Column = F.filter(F.split(F.col("t"), r"[\n\r]+"), lambda x: F.regexp_replace(x, r"[ \t]+", "") != "")
    joined = base.join(per_lang, F.col("lang") == F.col("__lang"), "left").withColumn("ws", words).withColumn("ls", lines)
    n, chars = F.size("ws"), F.length(F.regexp_replace("t", r"[ \t\n\r]+", ""))
    lower = F.transform("ws", lambda w: F.regexp_replace(F.lower(w), "[.,!?]+$", ""))
    common = F.size(F.filter(lower, lambda w: F.array_contains(F.coalesce(F.col("__common"), F.array().cast("array<string>")), w)))
    return joined.select(
        F.col("id").alias(id_col),
        "lang",
        n.cast("bigint").alias("n_words"),
        F.when(n > 0, F.round(chars / n, 6)).alias("mean_word_len"),
        F.when(chars > 0, F.round(F.length(F.regexp_replace("t", r"[\p{L}\p{N} \t\n\r]+", "")) / chars, 6)).alias("symbol_ratio"),
        F.when(F.size("ls") > 0, F.round(F.size(F.filter("ls", lambda x: x.rlike(r"[.!?。][ \t]*$"))) / F.size("ls"), 6)).alias("line_stop_share"),
        F.when(n > 0, F.round(common / n, 6)).alias("common_share"),
    )
