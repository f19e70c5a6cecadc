"""Prompt and response pairs whose response is no usable answer, with the kind of defect.

empty           no content: null, blank or a mere placeholder.
echo            only repeats the instruction, the input or both. Responses of any length are compressed with their prompt
                as a zstandard dictionary; one that needs next to nothing is a candidate, and is checked against the
                prompt's parts, form and small slips aside.
refusal         declines to answer, by dictionaries of four languages, whatever the length; one that is only quoted is none,
                and neither is one whose other sentences, by and large, answer.
wrong_language  mainly in another language than the prompt and than the one that is asked for, by scripts and dictionaries of
                frequent words of 14 languages; code has no language.
truncated       breaks off inside a sentence, list or code. Whether a text may end where it ends is told by a model of
                terminal contexts: how often, over all responses, a sentence ends after a word (or a syllable pair).

Defined results: a null or blank response is `empty` whatever the prompt; a null or blank prompt has no language and
cannot be echoed; repeated rows are reported once per row; whole texts are read; an empty table gives an empty table;
only the named columns are read, so others may have any name. `empty` excludes all other defects; `echo` and `refusal`
exclude `truncated`; `refusal` and `wrong_language` may come together.
"""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onggi.llm.lookalikes import PROTOTYPES, latin_words
from onggi.session import materialize

# Placeholders (form aside), and words of refusals.
PLACEHOLDERS = frozenset("없음 빈칸 공란 미정 무 내용없음 해당없음 답변없음 none null nan na nil empty tbd todo undefined blank keine leer なし 無し 未定 空欄".split())
REFUSALS = re.compile(
    r"도와\s*드릴 수 (?:가 )?없|도움을 드릴 수 없|도와드리기 어렵|답변\s*(?:을|은)?\s*드리기 (?:가 )?어렵|답변\s*(?:을|은)?\s*드릴 수 없|답변할 수 없|답변해 드릴 수 없|대답(?:을|은)? ?(?:해 드릴 수 없|할 수 없|삼가)"
    r"|답(?:변|)을 제공하지 않|제공해 ?드릴 수 없|안내해? ?드릴 수 없|권한이 없|알려 ?드릴 수 없|말씀\s*드릴 수 없|말씀드리기 어렵|처리할 수 있는 범위를 벗어|답할 사안이 아닌|답할 수 있는 (?:질문|주제|범위)(?:이|가)? ?아|응답할 수 없|들어\s*드릴 수 없|제 능력 밖"
    r"|(?:can ?['’]?t|cannot|can not|unable to|not able to|won['’]t be able to|won['’]t) (?:be able to )?(?:help|assist|answer|provide (?:that|this)|discuss|comply|fulfill|do that|respond)"
    r"|falls outside what I can|outside (?:of )?(?:my|what I)|not something I can (?:help|answer|discuss)|as an ai(?: \w+)?,? (?:I )?(?:am|cannot|can't|do not)|must decline|have to decline"
    r"|(?:kann|können|darf) (?:ich|wir) (?:\w+ ){0,3}(?:nicht|keine) (?:\w+ ){0,3}(?:beantworten|helfen|geben|sagen|behilflich)|leider nicht (?:beantworten|helfen|weiterhelfen|möglich)|Dazu (?:kann|darf|möchte) ich"
    r"|お答え(?:する(?:こと)?は?|は)?(?:できません|できかねます|いたしかねます)|お手伝い(?:は)?(?:できません|できかねます)|回答(?:は|を)?(?:できません|差し控え|控え)|お応えできません|対応(?:は)?できません|ご案内できません",
    re.IGNORECASE,
)
# Words of the sentences around a refusal, which apologise, give reasons or name alternatives.
_DECLINES = re.compile(
    r"죄송|미안|유감|양해|아쉽|불가|어렵|어려운|어려울|곤란|할 수 없|없습니다|않습니다|못합니다|정책|규정|지침|원칙|제한|위험|안전|민감|개인 ?정보|전문가|의사|변호사|기관|문의|대신|다른 (?:질문|주제|방법)|바랍니다|감사"
    r"|sorry|apolog|unfortunately|regret|policy|policies|guideline|cannot|can ?['’]?t|unable|not able|won['’]t|restrict|harm|unsafe|danger|privacy|sensitive|professional|expert|lawyer|doctor|instead|consult|understand|appreciate|thank"
    r"|leider|tut mir|entschuldig|bedau|richtlinie|nicht möglich|gefähr|schädlich|fachleute|arzt|anwalt|stattdessen|verständnis|danke"
    r"|申し訳|すみません|残念|できません|できかね|方針|規定|危険|専門家|医師|弁護士|代わり|ご了承|ご理解|ありがとう",
    re.IGNORECASE,
)
_SENTENCE = re.compile(r"[.!?。！？]+\s*|\n+")
#: What asks for the prompt's own words.
COPY_ASKED = re.compile(
    r"그대로|똑같이|되풀이|따라\s*(?:쓰|적|말)|받아\s*(?:적|쓰)|옮겨\s*(?:적|쓰)|베껴|반복해|복사|인용|뽑으|뽑아|발췌|골라|찾아 쓰|verbatim|repeat|copy|quote|extract|echo|word for word|wiederhol|zitier|abschreib|そのまま|繰り返|引用|書き写|抜き出",
    re.IGNORECASE,
)
CORRECTION_ASKED = re.compile(r"맞춤법|교정|오타|바로잡|띄어쓰기|철자|고쳐|correct|proofread|spelling|korrigier|berichtig|校正|訂正|直して", re.IGNORECASE)
# Names of languages, in Korean, English, German and Japanese.
LANGUAGE_NAMES = {
    "en": re.compile(r"영어|영문|영역|english|englisch|英語|英文", re.IGNORECASE),
    "ja": re.compile(r"일본어|일어|일문|japanese|japanisch|日本語|和訳", re.IGNORECASE),
    "de": re.compile(r"독일어|독어|german(?!y)|deutsch|ドイツ語|独訳", re.IGNORECASE),
    "ko": re.compile(r"한국어|국어로|한글로|우리말|korean|koreanisch|韓国語", re.IGNORECASE),
    "fr": re.compile(r"프랑스어|불어|불문|french|französisch|フランス語|仏訳", re.IGNORECASE),
    "es": re.compile(r"스페인어|에스파냐어|spanish|spanisch|スペイン語", re.IGNORECASE),
    "it": re.compile(r"이탈리아어|italian|italienisch|イタリア語", re.IGNORECASE),
    "pt": re.compile(r"포르투갈어|portuguese|portugiesisch|ポルトガル語", re.IGNORECASE),
    "nl": re.compile(r"네덜란드어|dutch|niederländisch|オランダ語", re.IGNORECASE),
    "zh": re.compile(r"중국어|중문|한문|chinese|mandarin|chinesisch|中国語|漢文|中訳", re.IGNORECASE),
    "ru": re.compile(r"러시아어|노어|russian|russisch|ロシア語|露訳", re.IGNORECASE),
    "el": re.compile(r"그리스어|greek|griechisch|ギリシャ語", re.IGNORECASE),
    "ar": re.compile(r"아랍어|arabic|arabisch|アラビア語", re.IGNORECASE),
    "he": re.compile(r"히브리어|hebrew|hebräisch|ヘブライ語", re.IGNORECASE),
    "th": re.compile(r"태국어|타이어로|\bthai|thailändisch|タイ語", re.IGNORECASE),
    "hi": re.compile(r"힌디어|hindi|ヒンディー語", re.IGNORECASE),
}
# Scripts that tell a language by themselves (first and last letter).
SCRIPTS = {"ru": ("\u0400", "\u052f"), "el": ("\u0370", "\u03ff"), "ar": ("\u0600", "\u06ff"), "he": ("\u0590", "\u05ff"), "th": ("\u0e00", "\u0e7f"), "hi": ("\u0900", "\u097f")}
_SCRIPT_RUNS = {k: re.compile(f"[{a}-{b}]+") for k, (a, b) in SCRIPTS.items()}
# Frequent words of further languages in Latin letters, and frequent characters of Chinese.
LATIN_WORDS = {
    "fr": frozenset("le la les des une est et dans pour que qui sur avec pas plus sont ce cette au aux du elle nous vous ils être avoir fait mais comme par leur".split()),
    "es": frozenset("el los las una es y para que con por no más del al lo su se como pero este esta son está fue han hay muy también porque cuando".split()),
    "it": frozenset("il gli le una è e per che con non di del della nel nella sono più anche come ma questo questa si ha hanno perché quando alla".split()),
    "pt": frozenset("o os as uma é e para que com não de do da no na são mais também como mas este esta se foi tem têm porque quando ao pelo".split()),
    "nl": frozenset("de het een en is van dat niet met voor zijn op te aan ook maar als bij er naar uit deze wordt werd hebben kan".split()),
}
CHINESE = frozenset("的是了在不我有这他们为和说就吗也会对要把被让着过")
# Words that tell German from English.
GERMAN = frozenset("der die das und nicht ein eine einen einer eines zu von haben hat wurde war mit sie aber dass noch man den dem des im ist sind auf für wie wird nach zum zur über weil es ich kann leider diese dieser dieses was warum blieben gibt bitte keine sich oder als auch davon doch jede außerdem leute tage stunden".split())
ENGLISH = frozenset("the of and a is was it to that not for with are be we an from there had they so if will most more still then only by on or but has have his her their what who why how when where which because after before does do don't didn't can could should this i'm you your my".split())

_LABEL = re.compile(r"^\s*(?:[\[(<【]?\s*(?:질문|문제|지시|지시문|명령|입력|본문|답|답변|응답|출력|원문|q|a|question|instruction|input|answer|output|prompt|response|text|frage|antwort|aufgabe|eingabe|質問|問題|指示|入力|回答|答え)\s*[\])>】]?\s*[:：.)\-]\s*)+", re.IGNORECASE | re.MULTILINE)
_HIDDEN = re.compile("[\u00ad\u034f\u115f\u1160\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff\u3164\uffa0\u0000-\u0008\u000e-\u001f\u007f-\u009f\ufffd]")
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.DOTALL)
_EMOTE = " \t\r\n~^;ㅋㅎㅠㅜ♡♥❤👍😀🙂😂😊🙏👏✨🎉😄😅😉🔥💪"
_STOPPED = re.compile(r"[.!?。！？．][\"'”’」』)\]）*_`]*$")
_PREDICATE = re.compile(r"(?:[다요죠까네]|[음함임됨]|니다|세요)$")
_JA_END = re.compile(r"(?:です|ます|ました|した|せん|ない|った|いる|ある|する|なる|さい|だ|か|よ|ね)[」』）)]*$")
_PARTICLE = re.compile(r"[가-힣A-Za-z0-9)](?:은|는|이|가|을|를|에|의|로|으로|와|과|도|에서|에게|까지|부터|보다)$")
_WIDE = {o: o - 0xFEE0 for o in range(0xFF01, 0xFF5F)} | dict.fromkeys((0xA0, 0x2007, 0x2009, 0x202F, 0x3000), " ")
_HAS_WIDE = re.compile("[" + "".join(map(chr, _WIDE)) + "]")
_LOOKS = re.compile("[" + "".join(map(chr, PROTOTYPES)) + "]")
_HANGUL, _KANA, _HAN, _OTHER_LETTERS = (re.compile(f"[{x}]+") for x in ("가-힣ㄱ-ㅣ\u1100-\u11ff", "ぁ-ヿ", "一-鿿", r"^\W\d_가-힣ㄱ-ㅣ\u1100-\u11ffぁ-ヿ一-鿿"))
_WORDS = re.compile(r"[a-zß-öø-ÿ']+")


def plain(text: str | None) -> str:
    """One form of a text for all comparisons: no hidden characters, composed, compatible forms replaced."""
    if not text:
        return ""
    t = _HIDDEN.sub("", text)
    if not t.isascii():
        t = unicodedata.normalize("NFC", t)
        if _HAS_WIDE.search(t):
            t = t.translate(_WIDE)
        if _LOOKS.search(t):
            t = latin_words(t)
    return t


def _bare(text: str) -> str:
    """Letters and digits only, in one case."""
    return "".join(filter(str.isalnum, text.casefold()))


def language(text: str) -> str | None:
    """The main language of a text; None if it has too few letters to tell.

    Scripts tell most languages; Chinese is Han without kana and with its own frequent characters; languages in Latin letters
    are told by their frequent words."""
    hangul, kana, han = (sum(map(len, x.findall(text))) for x in (_HANGUL, _KANA, _HAN))
    rest = "".join(_OTHER_LETTERS.findall(text))
    other = {k: n for k, x in _SCRIPT_RUNS.items() if (n := sum(map(len, x.findall(rest))))} if rest and max(rest) >= "\u0370" else {}
    latin = len(rest) - sum(other.values())
    east = kana + (han if kana else 0)
    chinese = han if not kana and han >= 8 and sum(ch in CHINESE for ch in text) * 12 >= han else 0
    name, most = max(other.items(), key=lambda x: x[1], default=("", 0))
    if hangul + east + chinese + latin + most < 6:
        return None
    #: A syllable or a kana says about as much as two and a half Latin letters.
    k, j, z, lat = 2.5 * hangul, 2.0 * east, 2.0 * chinese, float(latin)
    if most > max(k, j, z, lat):
        return name
    if k >= max(j, z, lat):
        return "ko"
    if z > max(j, lat):
        return "zh"
    if j >= lat:
        return "ja"
    lower = text.lower()
    words = _WORDS.findall(lower)
    de, en = sum(w in GERMAN for w in words), sum(w in ENGLISH for w in words)
    de += sum(c in "äöüß" for c in lower) * 0.5
    further, n = max(((x, sum(w in known for w in words)) for x, known in LATIN_WORDS.items()), key=lambda x: x[1])
    if n >= 2 and n > max(de, en):
        return further
    return "de" if de > en else "en" if en or latin > 12 else None


def is_empty(output: str | None) -> bool:
    t = plain(output)
    bare = _bare(t)
    return not bare and not any(unicodedata.category(c) in ("So", "Sm", "Sk") for c in t if c not in "`^~") or bare in PLACEHOLDERS


def dictionary_bytes(prompt: str, output: str) -> int:
    """Bytes that the response needs with its prompt as a dictionary."""
    raw = output.encode("utf-8")
    comp = zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(prompt.encode("utf-8"), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)
    return len(comp.compress(raw)) - 9


def dictionary_share(prompt: str, output: str) -> float:
    """The same as a share of its own bytes."""
    return dictionary_bytes(prompt, output) / max(1, len(output.encode("utf-8")))


def _slips_only(part: str, output: str) -> bool:
    """Whether a short response is a part of its prompt but for a letter more, less or another; numbers must agree."""
    if abs(len(part) - len(output)) > 1 or re.sub(r"\D", "", part) != re.sub(r"\D", "", output):
        return False
    a, b = unicodedata.normalize("NFD", part), unicodedata.normalize("NFD", output)
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.88


def is_echo(instruction: str, inp: str, output: str) -> bool:
    """Whether a response only repeats its prompt, unasked. The texts are in their plain form."""
    a, b = _bare(instruction), _bare(inp)
    o = _bare(_LABEL.sub("", output))
    shortest = min((len(x) for x in (a, b) if x), default=0)
    if len(o) < 4 or not shortest or len(o) < 0.9 * shortest:
        return False
    #: A response that needs more than this share of its bytes beside the prompt, and the few of any frame and of a slip,
    #: holds words of its own.
    if dictionary_bytes(a + " " + b, o) > 0.25 * len(o.encode("utf-8")) + 16:
        return False
    rest, parts = o, set()
    while rest:
        for name, part in (("instruction", a), ("input", b)):
            if part and len(part) >= 4 and rest.startswith(part):
                rest, _ = rest[len(part) :], parts.add(name)
                break
        else:
            break
    if rest and not (parts and len(rest) <= 2):
        near = lambda x: abs(len(x) - len(o)) * 20 <= len(x) and dictionary_share(x, o) <= 0.12 if len(x) > 20 else len(x) >= 4 and _slips_only(x, o)
        #: A short input with a letter changed may be what was asked for (a correction, another form of a word).
        parts = {"instruction"} if near(a) else {"input"} if near(b) and (len(b) > 20 or not a) else {"instruction", "input"} if a and b and near(a + b) else set()
    if not parts:
        return False
    return "instruction" in parts or not (COPY_ASKED.search(instruction) or CORRECTION_ASKED.search(instruction) and not _misspelt(inp))


def _misspelt(text: str) -> bool:
    """Whether a text shows what a correction would change (separate jamo, or a tense final no word has)."""
    return bool(re.search("[ㄱ-ㅣ]", text))


def _quoted(output: str, m: re.Match[str]) -> bool:
    """Whether an opening quote comes before a match, and its closing one after."""
    before = output[: m.start()]
    for o, c in ("''", '""', "‘’", "“”", "「」", "『』"):
        if o in before and (before.count(o) % 2 if o == c else before.rfind(o) > before.rfind(c)):
            if c in output[m.end() : m.end() + 20]:
                return True
    return False


def is_refusal(output: str) -> bool:
    """Whether a response declines: within its first three sentences, or later if few sentences before it answer; and
    if no long answer follows. Sentences that apologise, give reasons or name alternatives do not answer."""
    #: Sentences of the whole response, told only where a refusal is found.
    whole: list[bool] = []
    for m in REFUSALS.finditer(output):
        if _quoted(output, m):
            continue
        before = [x for x in _SENTENCE.split(output[: m.start()]) if x.strip()]
        if _SENTENCE.split(output[: m.start()])[-1].strip():
            before = before[:-1]
        answering = sum(not _DECLINES.search(x) for x in before)
        if len(before) <= 2 or answering <= 2 and answering * 2 <= len(before):
            whole = whole or [not _DECLINES.search(x) and not REFUSALS.search(x) for x in _SENTENCE.split(output) if x.strip()]
            if sum(whole) <= max(6, 0.7 * len(whole)):
                return True
    return False


def wrong_language(instruction: str, inp: str, output: str) -> bool:
    words = _FENCE.sub(" ", output)
    if sum(map(str.isalpha, words)) < 8:
        return False
    own = language(words)
    prompt = f"{instruction}\n{inp}".strip()
    if own is None or not prompt or own == language(prompt):
        return False
    if own == language(instruction) or not instruction and own == language(inp):
        return False
    if LANGUAGE_NAMES[own].search(instruction):
        return False
    mine = language(prompt)
    return mine is not None


Contexts = dict[str, tuple[int, int]]
_CTX = r"([가-힣]{2}|[A-Za-zÄÖÜäöüß']{2,14})"


def terminal_contexts(df: DataFrame, output_col: str = "output", least: int = 5) -> DataFrame:
    """(ctx, n_final, n_inner): how often a context ends a sentence and how often another word follows, over all texts.

    Built-in expressions only; counts are combined before the shuffle. A context that occurs `least` times is told by
    the model, whatever the size of the table."""
    text = F.coalesce(df[output_col], F.lit(""))
    final = F.transform(F.regexp_extract_all(text, F.lit(_CTX + r"[.!?。]"), 1), lambda c: F.struct(F.lower(c).alias("ctx"), F.lit(1).alias("f")))
    inner = F.transform(F.regexp_extract_all(text, F.lit(_CTX + r"\s+(?=[가-힣A-Za-z0-9])"), 1), lambda c: F.struct(F.lower(c).alias("ctx"), F.lit(0).alias("f")))
    rows = df.select(F.explode(F.concat(final, inner)).alias("x")).groupBy("x.ctx").agg(F.sum("x.f").alias("n_final"), F.sum(1 - F.col("x.f")).alias("n_inner"))
    return rows.where(F.col("n_final") + F.col("n_inner") >= least)


class Asked(dict):
    """A model without contexts that keeps which context was asked for, and the limit below which it breaks off."""

    ctx: str | None = None
    limit = 0.0


def _breaks(contexts: Contexts, ctx: str, limit: float) -> bool | None:
    """Whether a text that ends in a context breaks off; None if the model does not know it."""
    if isinstance(contexts, Asked):
        contexts.ctx, contexts.limit = ctx, limit
        return None
    f, n = contexts.get(ctx, (0, 0))
    return (f + 0.5) / (f + n + 1) < limit if f + n >= 5 else None


def is_truncated(output: str, contexts: Contexts, limit: float = 0.06) -> bool:
    """Whether a response breaks off. Ends are told by its marks first, then by the model of terminal contexts."""
    if output.count("```") % 2:
        return True
    t = output.rstrip(_EMOTE)
    while t and unicodedata.category(t[-1]) in ("So", "Cn", "Mn", "Cf"):
        t = t[:-1].rstrip(_EMOTE)
    if not t or t.endswith("```"):
        return False
    t = re.sub(r"(?<=\S)\s*\([^()]{1,30}\)$", "", t).rstrip(_EMOTE) or t
    lines = t.split("\n")
    last = lines[-1].strip()
    if re.fullmatch(r"(?:[-*•·]|\(?\d+[.)]|\(?[a-zA-Z가-힣][.)])", last) and len(lines) > 1:
        return True
    cut = re.search(r"(?:…|\.{3,}|‥)$", t)
    if cut:
        t, last = t[: cut.start()].rstrip(), last[: -len(cut.group())].rstrip()
        if not t:
            return False
    elif _STOPPED.search(t):
        return False
    if re.match(r"(?:[-*•·▪]|\(?\d+[.)])\s", last) and len(lines) > 1 and not cut:
        return bool(re.search(r"[,、:]$", last))
    if t[-1] in ",、，:;([{「『“‘+-=*/×<&|" and len(t) > 1:
        return len(t) > 12
    #: What stands after the last full stop.
    segment = re.split(r"[.!?。！？](?:[\"'”’」』)\]]|\s)+|\n|[。！？]", t)[-1].strip()
    words = segment.split()
    if not words:
        return False
    earlier = len(t) > len(segment) + 3
    script = language(segment) or language(t)
    items = re.split(r",\s|、|\s/\s", segment)
    if script in ("ko", None):
        if not re.search("[가-힣]$", t):
            if re.search(r"[0-9)\]\"'”’%℃]$", t) and not cut:
                return earlier and bool(re.search(r"[가-힣]", segment)) and len(words) > 3 and not re.search(r"[)\]\"'”’]$", t)
            if re.search("[ㄱ-ㅣ\u1100-\u11ff]$", t):
                return earlier or len(words) > 3
        if not cut and not earlier and len(items) >= 3 and all(len(x.split()) <= 3 for x in items) and not re.search(r"(?:에서|에서는|에는|부터)$", " ".join(items[0].split()[:-1])):
            return len(items[-1].split()) < min(len(x.split()) for x in items[:-1])
        if not earlier and len(words) <= 3 and not cut and not any(_PARTICLE.search(w) for w in words[:-1]):
            return False
        known = _breaks(contexts, words[-1][-2:], limit)
        return not _PREDICATE.search(words[-1]) if known is None else known
    if script == "ja":
        if not earlier and len(segment) < 12 and not cut:
            return False
        return bool(cut) or not _JA_END.search(segment)
    if not earlier and len(words) <= 4 and not cut:
        return False
    if not cut and len(items) >= 3 and len(segment) <= 24 * len(items) and language(segment) is None:
        return False
    if cut:
        return True
    known = _breaks(contexts, words[-1].strip("\"'()").lower(), 2 * limit)
    return True if known is None else known


def defects_of(instruction: str | None, inp: str | None, output: str | None, contexts: Contexts) -> list[str]:
    if is_empty(output):
        return ["empty"]
    a, b, o = plain(instruction).strip(), plain(inp).strip(), plain(output)
    if is_echo(a, b, o):
        return ["echo"]
    found = []
    if is_refusal(o):
        found.append("refusal")
    elif is_truncated(o, contexts):
        found.append("truncated")
    if wrong_language(a, b, o):
        found.append("wrong_language")
    return found


def broken_pairs(df: DataFrame, id_col: str = "rec_id", instruction_col: str = "instruction", input_col: str = "input", output_col: str = "output") -> DataFrame:
    """(id, defect): one row per record and defect. One pass for the model, one narrow pass for the records.

    A record whose end the model must judge asks for one context, which is joined with the counts."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, names, ctxs, limits, otherwise = [], [], [], [], []
            for i, x in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                asked = Asked()
                found = defects_of(*x, asked)
                told = "truncated" in found
                for d in [*found, *(["truncated"] if asked.ctx is not None and not told else [])]:
                    ask = d == "truncated" and asked.ctx is not None
                    rows.append(i)
                    names.append(d)
                    ctxs.append(asked.ctx if ask else None)
                    limits.append(asked.limit)
                    otherwise.append(told or not ask)
            columns = [pa.array(names, pa.string()), pa.array(ctxs, pa.string()), pa.array(limits, pa.float64()), pa.array(otherwise, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], names=["id", "defect", "ctx", "ctx_limit", "otherwise"])

    cols = [df[c].alias(n) for c, n in ((id_col, "id"), (instruction_col, "a"), (input_col, "b"), (output_col, "o"))]
    found = materialize(df.select(*cols).mapInArrow(run, f"id {id_type}, defect string, ctx string, ctx_limit double, otherwise boolean"), "pair-defects")
    total = F.col("n_final") + F.col("n_inner")
    judged = found.where("ctx IS NOT NULL").join(terminal_contexts(df, output_col), "ctx", "left")
    judged = judged.where(F.coalesce((F.col("n_final") + 0.5) / (total + 1) < F.col("ctx_limit"), F.col("otherwise")))
    return found.where("ctx IS NULL").select("id", "defect").unionByName(judged.select("id", "defect")).withColumnRenamed("id", id_col)
