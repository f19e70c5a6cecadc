"""Records of evaluation splits that stand in the training split too, exactly or almost.

1. Each record (instruction, input and output, in this order) is normalised to its letters and digits; a coarse form keeps
   of each Hangul syllable the class of its initial, so that misspelt vowels, finals, tense and aspirated consonants, and
   spacing, leave it unchanged. A rolling hash over the coarse form cuts it into content-defined chunks.
2. Records with one normalised form are one class; each class is searched once and its members come back at the end.
3. Chunk digests are joined across splits. A chunk weighs its length times a power of its rarity, and a pair must share
   `threshold` of the weight of the evaluation record. By the prefix rule it is enough to join the rarest chunks of each
   evaluation class up to `prefix` of its weight: a pair that shares less than threshold - (1 - prefix) there cannot
   reach the threshold. Pairs that may share `whole` of the characters are kept whatever their rarity, by the same rule
   over lengths, so near copies that hold a third of all records are found. An edit breaks one or two chunks, which
   leaves a short record about half of its characters. Chunks of many training records are spread by record. Nothing is
   capped.
4. The lengths of all chunks that such a pair shares are summed; as a share of the evaluation record they are its overlap
   fraction. Pairs that reach neither the threshold of weight nor a fraction of `least` leave.
5. What is left is checked on its texts: numbers agree, what differs is a misspelling, a short insertion, a moved
   sentence or a usual word for another one; never a name for another name, the task or the answer.

Defined results: records without a letter or digit match nothing; repeated records are reported once each; records that
are neither train, validation nor test take no part; an empty table gives an empty table; only the named columns are
read, so others may have any name. Texts are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from onggi.llm import bloom
from onggi.llm.lookalikes import skeleton
from onggi.session import materialize

WINDOW, DIVISOR = 4, 8
THRESHOLD, PREFIX, WHOLE, RARITY_POWER = 0.4, 0.8, 0.5, 3.0
#: The overlap fraction from which a pair is checked on its texts whatever the rarity of what it shares.
LEAST = 0.3
#: Records of one exchange share this part of the jamo runs of the shorter one; the comparison asks for it first.
GRAM, GRAM_SHARE = 4, 0.4
#: Stretches that both sides lack may make up this part of the longer one.
APART_SHARE = 0.3
#: Characters of evaluation and of training records whose parts are kept while pairs are compared in the order of the latter.
KEPT = (400_000, 20_000)
#: Marks at the ends of words.
MARKS = ".,!?:;()[]\"'。、！？「」“”‘’\n"
#: Training records of one chunk that are joined in one place; a chunk of more is spread by record.
HOT = 20_000

# Classes of initial consonants (plain, aspirated and tense together; the two liquids together).
_INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
_CLASSES = "ㄱㄱㄴㄷㄷㄴㅁㅂㅂㅅㅅㅇㅈㅈㅈㄱㄷㅂㅎ"
_CLASS_OF = np.array([ord(c) for c in _CLASSES], np.uint64)
_EASY = re.compile(r"[\t\n\r -~가-힣ぁ-ヿ一-鿿、。ä-ÿÄÖÜßéèñç]*")
_REST = re.compile(r"[\W_]+")
_VOWELS = "\u1161-\u1175"
#: A separate final consonant after a vowel, unless a vowel claims it, belongs to the syllable.
_FINAL_OF = {chr(0x1100 + j): chr(0x11A8 + i) for i, j in zip((0, 1, 3, 6, 7, 15, 16, 18, 19, 20, 21, 22, 23, 24, 25, 26), (0, 1, 2, 3, 5, 6, 7, 9, 10, 11, 12, 14, 15, 16, 17, 18), strict=True)}
_LOOSE_FINAL = re.compile(f"(?<=[{_VOWELS}])([{''.join(_FINAL_OF)}])(?![{_VOWELS}])")


def composed(text: str | None) -> str:
    """A text in one form of its characters, separate jamo composed."""
    if not text:
        return ""
    if _EASY.fullmatch(text):
        return text.casefold()
    s = _LOOSE_FINAL.sub(lambda m: _FINAL_OF[m[1]], skeleton(text))
    return unicodedata.normalize("NFC", s).casefold()


def letters(text: str) -> str:
    return _REST.sub("", text)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache
def _kinds() -> np.ndarray:
    """Of each code point below 2^17: 1 if it is a letter or a digit, 3 if it is a decimal digit."""
    return np.fromiter((c.isalnum() + 2 * c.isdecimal() for c in map(chr, range(1 << 17))), np.uint8, 1 << 17)


def kinds_of(codes: np.ndarray) -> np.ndarray:
    table = _kinds()
    out = table[np.minimum(codes, len(table) - 1)]
    for k in np.flatnonzero(codes >= len(table)).tolist():
        out[k] = (c := chr(codes[k])).isalnum() + 2 * c.isdecimal()
    return out


def coarse(codes: np.ndarray) -> np.ndarray:
    """Code points with Hangul syllables replaced by the class of their initial."""
    out = codes.astype(np.uint64)
    hangul = (codes >= 0xAC00) & (codes <= 0xD7A3)
    out[hangul] = _CLASS_OF[(codes[hangul].astype(np.int64) - 0xAC00) // 588]
    return out


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def chunk(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests and lengths of the chunks of all texts, and the number of chunks up to the end of each text."""
    return chunk_codes(code_points("".join(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))


def chunk_codes(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of texts that stand one after the other, by their sizes.

    All texts are cut at once: a position is a border if the hash of the characters around it is a multiple of the
    divisor, so equal passages are cut alike wherever they stand. Digests come from one prefix sum of a polynomial."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(sizes) + 1, np.int64)
    codes = coarse(codes)
    is_border = np.zeros(n + 1, bool)
    if n >= WINDOW:
        h = np.zeros(n - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            h = h * np.uint64(1000003) + codes[k : n - WINDOW + 1 + k]
        at = np.flatnonzero(_mix(h) % np.uint64(DIVISOR) == 0)
        owner = np.searchsorted(ends, at, side="right")
        at = at[at + WINDOW <= ends[owner]]
        is_border[at + WINDOW // 2] = True
    is_border[starts] = True
    is_border[n] = True
    borders = np.flatnonzero(is_border)
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * _powers(_BASE, n)[:n], dtype=np.uint64)))
    lo, hi = borders[:-1], borders[1:]
    digests = _mix((prefix[hi] - prefix[lo]) * _powers(_INVERSE, n)[lo] + (hi - lo).astype(np.uint64))
    return digests, hi - lo, np.concatenate((np.zeros(1, np.int64), np.searchsorted(hi, ends, side="right")))


def chunk_table(df: DataFrame, id_col: str, split_col: str, fields: tuple[str, str, str]) -> DataFrame:
    """(id, train, cls, digests, lens, numbers) of every record of a known split that has a letter or digit.

    Evaluation records come first; of a training record only the chunks that some evaluation record may hold are kept, as
    no other can be shared."""
    split = F.lower(F.trim(df[split_col]))
    part = lambda names: df.where(split.isin(*names)).select(df[id_col].alias("id"), (split == "train").alias("train"), *[df[f].alias(f"f{i}") for i, f in enumerate(fields)])
    schema = f"id {df.schema[id_col].dataType.simpleString()}, train boolean, cls string, digests array<bigint>, lens array<int>, numbers bigint"
    held_out = materialize(part(["validation", "test"]).mapInArrow(_chunker(None), schema), "split-evaluation")
    sought = df.sparkSession.sparkContext.broadcast(bloom.build(held_out.select(F.explode("digests").alias("h")).distinct()))
    return held_out.unionByName(part(["train"]).mapInArrow(_chunker(sought), schema))


def _chunker(sought: Broadcast[np.ndarray] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                wholes = whole_texts(*part.columns[2:5])
                #: Letters and digits of all texts, and the numbers, are told by one look at the code points.
                whole = "".join(wholes)
                codes = code_points(whole)
                kinds = kinds_of(codes)
                stops = np.cumsum(np.fromiter(map(len, wholes), np.int64, len(wholes)))
                numbers = pa.array(map(_number_bits, _numbers_of(whole, kinds == 3, stops)), pa.int64())
                codes = codes[kinds > 0]
                sizes = np.diff(np.concatenate(([0], np.cumsum(kinds > 0)))[np.concatenate(([0], stops))])
                digests, lens, ends = chunk_codes(codes, sizes)
                #: A chunk counts once in a record.
                owner = np.repeat(np.arange(len(sizes)), np.diff(ends))
                order = np.lexsort((digests, owner))
                again = np.zeros(len(order), bool)
                again[order[1:]] = (digests[order[1:]] == digests[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
                ends = np.concatenate(([0], np.cumsum(~again)))[ends]
                digests, lens = digests[~again], lens[~again]
                if sought is not None:
                    wanted = bloom.contains(sought.value, digests)
                    ends = np.concatenate(([0], np.cumsum(wanted)))[ends]
                    digests, lens = digests[wanted], lens[wanted]
                keep = pa.array(sizes > 0, pa.bool_())
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, t)) for v, t in ((digests.view(np.int64), pa.int64()), (lens, pa.int32()))]
                at, view = np.concatenate(([0], np.cumsum(sizes))).tolist(), memoryview(codes)
                cls = pa.array([xxhash.xxh3_128_hexdigest(view[i:j]) for i, j in zip(at, at[1:], strict=False)], pa.string())
                rows = pa.RecordBatch.from_arrays([part.column(0), part.column(1), cls, *lists, numbers], names=["id", "train", "cls", "digests", "lens", "numbers"])
                yield rows.filter(keep)

    return run


def strings(column: pa.Array) -> list[str | None]:
    return column.to_numpy(zero_copy_only=False).tolist()


def whole_texts(*fields: pa.Array) -> list[str]:
    """The composed fields of each record, with blanks between them."""
    joined = pc.binary_join_element_wise(*fields, " ", null_handling="replace", null_replacement="")
    return [t.casefold() if _EASY.fullmatch(t) else " ".join(composed(f[i].as_py()) for f in fields) for i, t in enumerate(strings(joined))]


def _numbers_of(whole: str, is_digit: np.ndarray, stops: np.ndarray) -> list[list[str]]:
    """The numbers of each of the texts that stand one after the other in `whole`, up to their stops."""
    at = np.flatnonzero(is_digit)
    owner = np.searchsorted(stops, at, side="right")
    first = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(owner) != 0)))[: len(at)]
    last = np.concatenate((first[1:], [True]))[: len(at)]
    out: list[list[str]] = [[] for _ in range(len(stops))]
    for k, i, j in zip(owner[first].tolist(), at[first].tolist(), at[last].tolist(), strict=True):
        out[k].append(whole[i : j + 1])
    return out


def number_bits(text: str) -> int:
    """A bit for each number of a text, and another one each time that it comes again. If the numbers of one text are all in
    another, so are its bits."""
    return _number_bits(re.findall(r"\d+", text))


def _number_bits(numbers: list[str]) -> int:
    bits, seen = 0, {}
    for n in numbers:
        seen[n] = k = seen.get(n, 0) + 1
        bits |= 1 << (xxhash.xxh3_64_intdigest(f"{n} {k}") & 63)
    return bits - (1 << 64) if bits >> 63 else bits


def candidate_classes(rows: DataFrame, threshold: float = THRESHOLD, prefix: float = PREFIX, whole: float = WHOLE, least: float = LEAST) -> DataFrame:
    """(e_id, r_id, overlap): pairs of different classes, an evaluation one and a training one, that may be near copies."""
    per_class = rows.groupBy("cls").agg(
        F.min(F.when(~F.col("train"), F.struct("id", "numbers"))).alias("e"), F.min(F.when(F.col("train"), F.struct("id", "numbers"))).alias("r"), F.max(F.struct(~F.col("train"), "digests", "lens")).alias("x")
    ).select(F.col("e.id").alias("e_id"), F.col("r.id").alias("r_id"), F.col("e.numbers").alias("e_numbers"), F.col("r.numbers").alias("r_numbers"), "x.digests", "x.lens")
    #: A class is known by its least record of either side from here on.
    per_class = materialize(per_class, "split-classes")
    chunks = per_class.select("e_id", "r_id", "e_numbers", "r_numbers", F.inline(F.arrays_zip("digests", "lens")).alias("d", "n"))
    df = chunks.groupBy("d").agg(F.count(F.lit(1)).alias("df"), F.max(F.col("e_id").isNotNull()).alias("in_e"), F.max(F.col("r_id").isNotNull()).alias("in_r"))
    df = df.where("in_e").drop("in_e")
    total = per_class.agg(F.count(F.lit(1)).alias("m"))
    rarity = F.pow(F.greatest(F.lit(0.0), F.log(F.greatest(F.col("m"), F.lit(2)) / F.col("df")) / F.log(F.greatest(F.col("m"), F.lit(2)))), F.lit(RARITY_POWER))
    #: A chunk that train lacks tells little: it weighs half.
    weight = F.col("n") * rarity * F.when(F.col("in_r"), 1.0).otherwise(0.5)
    e_chunks = chunks.where("e_id IS NOT NULL").select("e_id", "e_numbers", "d", "n").join(df, "d").crossJoin(F.broadcast(total))
    e_chunks = materialize(e_chunks.select("e_id", "e_numbers", "d", "n", "df", "in_r", weight.alias("w")), "split-weights")
    #: The rarest chunks first, up to the prefix of the weight, and at least so many that a pair which shares `whole` of
    #: the characters shares one of them (near copies of which there are very many have only common chunks).
    order = Window.partitionBy("e_id").orderBy("df", "d")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy("e_id")
    sums = e_chunks.select(
        "e_id", "e_numbers", "d", "n", "w", "df", "in_r", F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("before_w"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before_n"),
        F.sum("w").over(all_rows).alias("all_w"), F.sum("n").over(all_rows).alias("all_n"),
    )
    taken = sums.where((F.col("before_w") <= prefix * F.col("all_w")) | (F.col("before_n") <= (1 - whole) * F.col("all_n")))
    taken = taken.withColumn("beyond_n", F.col("all_n") - F.sum("n").over(all_rows))
    salts = F.ceil(F.col("df") / HOT).cast("int").alias("salts")
    e_prefix = materialize(taken.where("in_r").select("d", "e_id", "e_numbers", "n", "w", "all_w", "all_n", "beyond_n", salts), "split-prefix")
    #: Postings without a partner leave before the shuffle where the digests sought fit a filter.
    sought = e_prefix.select("d", "salts").distinct()
    postings = chunks.where("r_id IS NOT NULL").select("d", "r_id", "r_numbers", F.col("e_id").alias("own")).join(sought, "d")
    postings = postings.select("d", "r_id", "r_numbers", "own", F.pmod(F.xxhash64("r_id"), "salts").cast("int").alias("salt"))
    salted = e_prefix.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    #: The comparison asks that one side have all numbers of the other. Records of one template differ in theirs, so most
    #: pairs that share only a template leave here, before they are summed; bits that fall together only keep a pair.
    both_numbers = F.col("e_numbers").bitwiseAND(F.col("r_numbers"))
    agree = (both_numbers == F.col("e_numbers")) | (both_numbers == F.col("r_numbers"))
    joined = salted.join(postings, ["d", "salt"]).where(~F.col("e_id").eqNullSafe(F.col("own")) & agree)
    shared = joined.groupBy("e_id", "r_id").agg(F.sum("w").alias("w"), F.sum("n").alias("n"), *[F.max(c).alias(c) for c in ("all_w", "all_n", "beyond_n")])
    #: What lies beyond the prefix can add at most its own weight, or its own characters.
    by_weight = F.col("w") >= (threshold - (1 - prefix)) * F.col("all_w") - 1e-9
    by_length = F.col("n") + F.col("beyond_n") >= whole * F.col("all_n")
    pairs = materialize(shared.where(by_weight | by_length).select("e_id", "r_id"), "split-bounded")
    #: The exact sums over all chunks that a pair shares. Only digests go along, no texts, and none that train lacks.
    lists = e_chunks.groupBy("e_id").agg(F.collect_list(F.when(F.col("in_r"), F.struct("d", "n", "w"))).alias("own"), F.sum("n").alias("own_n"), F.sum("w").alias("own_w"))
    there = rows.where("train").select(F.col("id").alias("r_id"), F.col("digests").alias("there"))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("w"))
    add = lambda acc, c: F.when(F.array_contains("there", c["d"]), F.struct((acc["n"] + c["n"]).alias("n"), (acc["w"] + c["w"]).alias("w"))).otherwise(acc)
    both = pairs.join(lists, "e_id").join(there, "r_id").select("e_id", "r_id", "own_n", "own_w", F.aggregate("own", zero, add).alias("x"))
    heavy, overlap = F.col("x.w") >= threshold * F.col("own_w") - 1e-9, F.col("x.n") / F.col("own_n")
    return both.select("e_id", "r_id", overlap.alias("overlap"), heavy.alias("heavy")).where(F.col("heavy") | (F.col("overlap") >= least)).select("e_id", "r_id", "overlap")


def _jamo(text: str) -> str:
    return unicodedata.normalize("NFD", text)


def _numbers(text: str) -> Counter[str]:
    return Counter(re.findall(r"\d+", text))


def matching_blocks(a: str, b: str) -> list[tuple[int, int, int]]:
    """The blocks that difflib's matcher finds without junk: the longest common one, the first of equals, then what is
    beside it. Substrings are sought instead of counting along all equal pairs, which is quicker for texts."""
    found: list[tuple[int, int, int]] = []
    todo, find = [(0, len(a), 0, len(b))], b.find
    while todo:
        i, hi, blo, bhi = todo.pop()
        lo, n, at, there = i, 0, 0, 0
        while i + n < hi:
            j = find(a[i : i + n + 1], blo, bhi)
            if j < 0:
                i += 1
                continue
            n += 1
            while i + n < hi and j + n < bhi and a[i + n] == b[j + n]:
                n += 1
            at, there = i, j
        if n:
            found.append((at, there, n))
            if lo < at and blo < there:
                todo.append((lo, at, blo, there))
            if at + n < hi and there + n < bhi:
                todo.append((at + n, hi, there + n, bhi))
    found.sort()
    out: list[tuple[int, int, int]] = []
    for i, j, n in found:
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            i, j, n = out[-1][0], out[-1][1], out.pop()[2] + n
        out.append((i, j, n))
    return [*out, (len(a), len(b), 0)]


def _alike(x: str, y: str, least: float) -> bool:
    """Whether difflib's ratio reaches `least`; letters in any order bound it from above."""
    needed = least * (len(x) + len(y))
    return 2 * min(len(x), len(y)) >= needed and 2 * _in_common(x, y) >= needed and 2 * sum(n for _, _, n in matching_blocks(x, y)) >= needed


def _in_common(x: str, y: str) -> int:
    """Letters that two texts share, in any order."""
    return sum(min(x.count(c), y.count(c)) for c in set(x))


def _covered(x: str, pairs: set[str]) -> int:
    """Letters of a text that stand in a pair of neighbours out of some."""
    own = bytes(map(pairs.__contains__, map("".join, zip(x, x[1:], strict=False))))
    return own.count(1) + sum(m.start() >= 0 for m in _END.finditer(own))


class Known:
    """What the comparison needs of the texts of one record, each found once and when it is needed."""

    def __init__(self, fields: list[str]):
        self.fields = fields
        whole = " ".join(fields)
        self.numbers = _numbers(whole)
        self.words = [w for w in _REST.split(whole) if w]
        self.text = "".join(self.words)
        self.jamo = _jamo(self.text)
        self.size = len(whole)

    @cached_property
    def at(self) -> list[int]:
        return _jamo_begins(self.text)

    @cached_property
    def runs(self) -> list[str]:
        return _runs(self.jamo)

    @cached_property
    def run_set(self) -> set[str]:
        return set(self.runs)

    @cached_property
    def parts(self) -> list["Part"]:
        return [Part(letters(f)) for f in self.fields]

    @cached_property
    def owner(self) -> list[int]:
        """The word of each jamo."""
        out, at = [], 0
        for i, w in enumerate(self.words):
            out += [i] * (self.at[at + len(w)] - self.at[at])
            at += len(w)
        return out


class Part:
    """The letters of one field."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def jamo(self) -> str:
        return _jamo(self.text)

    @cached_property
    def at(self) -> list[int]:
        return _jamo_begins(self.text)

    @cached_property
    def grams(self) -> set[str]:
        return set(_grams(self.jamo))

    @cached_property
    def pairs(self) -> set[str]:
        return set(map("".join, zip(self.jamo, self.jamo[1:], strict=False)))


class _Sizes(dict[str, int]):
    """How many jamo a letter has."""

    def __missing__(self, ch: str) -> int:
        n = self[ch] = len(_jamo(ch))
        return n


_SIZES = _Sizes()


def _jamo_begins(text: str) -> list[int]:
    """Where the jamo of each letter begin, and where the last ends."""
    return list(accumulate(map(_SIZES.__getitem__, text), initial=0))


def common_blocks(x: str, y: str, at_x: list[int], at_y: list[int], jx: str, jy: str) -> list[tuple[int, int, int]]:
    """Equal blocks of the jamo of two texts, in order: runs of equal letters first, then jamo between those."""
    found: list[tuple[int, int, int]] = []

    def add(i: int, j: int, n: int) -> None:
        if found and found[-1][0] + found[-1][2] == i and found[-1][1] + found[-1][2] == j:
            i, j, n = found[-1][0], found[-1][1], found.pop()[2] + n
        if n:
            found.append((i, j, n))

    i = j = 0
    for p, q, size in matching_blocks(x, y):
        a, b, n = at_x[p], at_y[q], at_x[p + size] - at_x[p]
        if 0 < n < 5:
            continue
        if a > i and b > j:
            for p, q, size in matching_blocks(jx[i:a], jy[j:b]):
                add(i + p, j + q, size)
        add(a, b, n)
        i, j = a + n, b + n
    return found


def _runs(jamo: str) -> list[str]:
    return [jamo[i : i + GRAM] for i in range(max(1, len(jamo) - GRAM + 1))]


def _apart(own: list[str], other: set[str], least: int = 9) -> int:
    """Jamo that lie in no run of the other text, in stretches of at least `least`."""
    total = 0
    for m in _STRETCH.finditer(bytes(map(other.__contains__, own))):
        n = m.end() - m.start() - GRAM + 1
        if m.start() == 0 or m.end() == len(own):
            n += GRAM - 1
        if n >= least:
            total += n
    return total


_STRETCH = re.compile(b"\0+")
_END = re.compile(b"\1(?!\1)")


def may_be_same(a: Known, b: Known) -> bool:
    """What the comparison asks for first: numbers agree, the shorter text shares runs, and it is not the case that both
    texts have long stretches that the other lacks."""
    if a.numbers != b.numbers and (a.numbers - b.numbers) and (b.numbers - a.numbers):
        return False
    if not a.jamo or not b.jamo:
        return False
    ra, rb = a.run_set, b.run_set
    if len(ra & rb) < GRAM_SHARE * min(len(ra), len(rb)):
        return False
    most = APART_SHARE * max(len(a.jamo), len(b.jamo))
    return _apart(a.runs, rb) <= most or _apart(b.runs, ra) <= most


def _held(part: str, other: str, other_runs: set[str]) -> bool:
    """Whether a text holds a part elsewhere, small slips aside."""
    own = set(_runs(part))
    return part in other or len(part) >= 12 and len(own & other_runs) >= 0.8 * len(own)


def _stem_in(word: str, other: str) -> bool:
    """Whether a text has a word, whatever its ending."""
    return _jamo(word[: max(2, len(word) - 2)]) in other


Region = tuple[int, int, int, int]


def _one_sided(r: Region) -> str:
    """a or b: the side that has more here while the other has next to nothing; else no side."""
    return "a" if r[3] - r[2] <= 2 < r[1] - r[0] else "b" if r[1] - r[0] <= 2 < r[3] - r[2] else ""


def _replacements(regions: list[Region], between: int = 6) -> list[Region]:
    """What one side has more and what the other has more, with a few equal jamo between, stands for each other."""
    out: list[Region] = []
    for r in regions:
        if out and r[0] - out[-1][1] <= between and {_one_sided(out[-1]), _one_sided(r)} == {"a", "b"}:
            r = (out[-1][0], r[1], out.pop()[2], r[3])
        out.append(r)
    return out


def compare(a: Known, b: Known) -> tuple[bool, list[list[str]]]:
    """(may be the same exchange, substitutions): of each region where words stand for other words, those of the one side
    and those of the other; the pair is the same exchange if all words of one of the sides are usual."""
    none: tuple[bool, list[list[str]]] = (False, [])
    if not may_be_same(a, b):
        return none
    ja, jb, na, nb = a.jamo, b.jamo, a.numbers, b.numbers
    #: The task and the answer, where both records have them in the same field.
    for k, least in ((0, 0.6), (2, 0.55)):
        x, y = a.parts[k], b.parts[k]
        if x.text and y.text and (a.parts[1].text or a.parts[2 - k].text) and (b.parts[1].text or b.parts[2 - k].text):
            if k == 2 and min(len(x.text), len(y.text)) <= 12:
                if not (x.jamo in y.jamo or y.jamo in x.jamo or _alike(x.jamo, y.jamo, 0.75)):
                    return none
            elif x.text != y.text:
                if len(x.grams & y.grams) < least * max(1, min(len(x.grams), len(y.grams))) and not (x.text in jb or x.jamo in jb):
                    needed = least * max(1, min(len(x.jamo), len(y.jamo)))
                    #: No more than these can lie in blocks of two.
                    if min(_covered(x.jamo, y.pairs), _covered(y.jamo, x.pairs)) < needed:
                        return none
                    if sum(n for _, _, n in common_blocks(x.text, y.text, x.at, y.at, x.jamo, y.jamo) if n >= 2) < needed:
                        return none
    #: Regions that differ lie between blocks of at least three jamo.
    edges = [(0, 0, 0), *(z for z in common_blocks(a.text, b.text, a.at, b.at, ja, jb) if z[2] >= 3), (len(ja), len(jb), 0)]
    regions = [(i + n, k, j + n, m) for (i, j, n), (k, m, _) in zip(edges, edges[1:], strict=False) if k > i + n or m > j + n]
    regions = _replacements(regions)
    only_a = [(r[0], r[1]) for r in regions if _one_sided(r) == "a"]
    only_b = [(r[2], r[3]) for r in regions if _one_sided(r) == "b"]
    #: Moved passages: what one side lacks here it has elsewhere, small slips aside.
    more_a = [x for x in only_a if not _held(ja[x[0] : x[1]], jb, b.run_set)]
    more_b = [x for x in only_b if not _held(jb[x[0] : x[1]], ja, a.run_set)]
    lacking_a, lacking_b = (sum(hi - lo for lo, hi in x) for x in (more_a, more_b))
    if lacking_a > 0.4 * len(ja) or lacking_b > 0.4 * len(jb):
        return none
    inserted = " ".join([ja[lo:hi] for lo, hi in only_a] + [jb[lo:hi] for lo, hi in only_b])
    if sum(((na - nb) + (nb - na)).values()) and not all(n in inserted for n in (na - nb) + (nb - na)):
        return none
    #: What either side has more than the other stands for each other, wherever it is.
    subs, mass = [], min(lacking_a, lacking_b)
    uneven_a = [*more_a, *((r[0], r[1]) for r in regions if r[1] - r[0] > 2 * (r[3] - r[2]) > 4)]
    uneven_b = [*more_b, *((r[2], r[3]) for r in regions if r[3] - r[2] > 2 * (r[1] - r[0]) > 4)]
    lone_a = lambda spans: sorted({w for w in {a.words[k] for lo, hi in spans for k in a.owner[lo:hi]} if not _stem_in(w, jb)})
    lone_b = lambda spans: sorted({w for w in {b.words[k] for lo, hi in spans for k in b.owner[lo:hi]} if not _stem_in(w, ja)})
    subs += [lone_a(uneven_a), lone_b(uneven_b)]
    for i1, i2, j1, j2 in regions:
        u, v = ja[i1:i2], jb[j1:j2]
        if mass > 0.25 * max(len(ja), len(jb)):
            return none
        if min(len(u), len(v)) < 3 or max(len(u), len(v)) < 4:
            continue
        #: Misspelt, or with letters in another order.
        longer, most = max(len(u), len(v)), _in_common(u, v)
        if most >= 0.85 * longer:
            continue
        if most >= 0.6 * longer and sum(n for _, _, n in matching_blocks(u, v)) >= 0.6 * longer:
            continue
        if u in jb and v in ja:
            continue
        mass += max(len(u), len(v))
        subs += [lone_a([(i1, i2)]), lone_b([(j1, j2)])]
    if mass > 0.25 * max(len(ja), len(jb)):
        return none
    #: Regions without words of their own on one side need no judgement.
    subs = [g for pair in zip(subs[::2], subs[1::2], strict=True) if all(pair) for g in pair]
    return True, subs


def _grams(j: str) -> list[str]:
    return [j[i : i + 5] for i in range(len(j) - 4)] or [j]


def _form_counter(sought: Broadcast[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(form, n): of each batch, how many times the texts have a form that may be sought; a token counts once in a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = pc.split_pattern(batch.column(0), " ")
            tokens, text = split.flatten().dictionary_encode(), pc.list_parent_indices(split).to_numpy()
            forms = pc.utf8_trim(tokens.dictionary, characters=MARKS)
            wanted = bloom.contains(sought.value, spark_hashes(strings(forms)))
            which = tokens.indices.to_numpy()
            at = np.flatnonzero(wanted[which])
            n = np.bincount(np.unique(text[at].astype(np.int64) * len(wanted) + which[at]) % max(1, len(wanted)), minlength=len(wanted))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([forms.take(pa.array(some)), pa.array(n[some], pa.int64())], names=["form", "n"])

    return run


def spark_hashes(texts: Iterable[str]) -> np.ndarray:
    """xxhash64 of Spark."""
    return np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in texts), np.uint64)


def exchange_classes(
    df: DataFrame, id_col: str = "rec_id", split_col: str = "split", fields: tuple[str, str, str] = ("instruction", "input", "output"), least_df: int = 20, usual_share: float = 5e-4, **candidate_settings: float
) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes of equal records that are the same exchange, and the members of the classes.

    (e, r, overlap): an evaluation and a training class; a class of both sides is a pair with itself. (id, train, cls): every
    record. A usual word stands in at least max(least_df, usual_share of all) records. With threshold=0, whole=0 and least=0
    every pair that shares a chunk is compared."""
    id_type = df.schema[id_col].dataType.simpleString()
    rows = materialize(chunk_table(df, id_col, split_col, fields), "split-records")
    pairs = materialize(candidate_classes(rows, **candidate_settings), "split-candidates")
    texts = df.select(df[id_col].alias("id"), *[df[f].alias(f"f{i}") for i, f in enumerate(fields)])
    needed = pairs.select(F.col("e_id").alias("id")).union(pairs.select("r_id")).distinct()
    found = materialize(texts.join(materialize(needed, "split-needed"), "id"), "split-texts")
    side = lambda p, k: found.select(F.col("id").alias(k), *[F.col(f"f{i}").alias(f"{p}{i}") for i in range(3)])
    both = pairs.join(side("a", "e_id"), "e_id").join(side("b", "r_id"), "r_id").select("e_id", "r_id", "overlap", *[f"a{i}" for i in range(3)], *[f"b{i}" for i in range(3)])

    #: Pairs of one training record follow each other.
    both = both.sortWithinPartitions("r_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        #: What is known of a text is kept for the pairs that follow, up to a bound of characters on either side.
        known: tuple[dict[tuple[str | None, ...], Known], ...] = ({}, {})
        held = [0, 0]
        for batch in batches:
            kept, subs = [], []
            for i, x in enumerate(zip(*(strings(batch.column(k)) for k in range(3, 9)), strict=True)):
                sides = []
                for side, key in enumerate((x[:3], x[3:])):
                    if (own := known[side].get(key)) is None:
                        if held[side] > KEPT[side]:
                            known[side].clear()
                            held[side] = 0
                        own = known[side][key] = Known([composed(f) for f in key])
                        held[side] += own.size
                    sides.append(own)
                ok, words = compare(*sides)
                if ok:
                    kept.append(i)
                    subs.append(words)
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(3)), pa.array(subs, pa.list_(pa.list_(pa.string())))], names=["e_id", "r_id", "overlap", "subs"])

    checked = materialize(both.mapInArrow(run, f"e_id {id_type}, r_id {id_type}, overlap double, subs array<array<string>>"), "split-checked")
    #: How many records hold each word that stands for another one; only those words are counted.
    words = materialize(checked.select(F.explode(F.flatten("subs")).alias("w")).distinct(), "split-words")
    #: Here words are what stands between blanks, without the marks at its ends, in small letters or with a capital first.
    forms = words.select("w", F.explode(F.array_distinct(F.array("w", F.initcap("w")))).alias("form"))
    sought = df.sparkSession.sparkContext.broadcast(bloom.build(forms.select(F.xxhash64("form").alias("h")).distinct()))
    tokens = df.select(F.concat_ws(" ", *[df[f] for f in fields]).alias("t")).mapInArrow(_form_counter(sought), "form string, n bigint")
    counts = tokens.join(forms, "form").groupBy("w").agg(F.sum("n").alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("m"))
    usual = counts.crossJoin(F.broadcast(total)).where(F.col("n") >= F.greatest(F.lit(float(least_df)), F.col("m") * usual_share)).select("w")
    groups = checked.where(F.size("subs") > 0).select("e_id", "r_id", F.posexplode("subs").alias("k", "g"))
    #: A side with a word that is not usual may be a name; a name never stands for another one.
    judged = groups.select("e_id", "r_id", "k", F.explode("g").alias("w")).join(usual.withColumn("usual", F.lit(True)), "w", "left").groupBy("e_id", "r_id", "k").agg(F.min(F.coalesce("usual", F.lit(False))).alias("ok"))
    regions = judged.groupBy("e_id", "r_id", F.floor(F.col("k") / 2).alias("k")).agg(F.max("ok").alias("ok"))
    bad = regions.where(~F.col("ok")).select("e_id", "r_id").distinct()
    near = materialize(checked.join(bad, ["e_id", "r_id"], "left_anti").select("e_id", "r_id", "overlap"), "split-near")
    #: Representatives give way to their classes.
    members = rows.select("id", "train", "cls")
    near = near.join(members.select(F.col("id").alias("e_id"), F.col("cls").alias("e")), "e_id").join(members.select(F.col("id").alias("r_id"), F.col("cls").alias("r")), "r_id")
    near = near.groupBy("e", "r").agg(F.max("overlap").alias("overlap"))
    equal = members.groupBy("cls").agg(F.bool_or("train").alias("t"), F.bool_and("train").alias("only")).where(F.col("t") & ~F.col("only"))
    return equal.select(F.col("cls").alias("e"), F.col("cls").alias("r"), F.lit(1.0).alias("overlap")).unionByName(near), members


def same_exchanges(df: DataFrame, id_col: str = "rec_id", **settings: object) -> DataFrame:
    """(e_id, r_id, overlap) of every evaluation record and training record that are the same exchange."""
    classes, members = exchange_classes(df, id_col, **settings)  # type: ignore[arg-type]
    e = members.where(~F.col("train")).select(F.col("id").alias("e_id"), F.col("cls").alias("e"))
    r = members.where("train").select(F.col("id").alias("r_id"), F.col("cls").alias("r"))
    return classes.join(e, "e").join(r, "r").select("e_id", "r_id", "overlap")


def matched_records(df: DataFrame, id_col: str = "rec_id", **settings: object) -> DataFrame:
    """(id, n_links, overlap) of every evaluation record that stands in train: how many training records are the same
    exchange, and the largest overlap. Links are counted by class, so no pair of members is built."""
    classes, members = exchange_classes(df, id_col, **settings)  # type: ignore[arg-type]
    size = members.where("train").groupBy(F.col("cls").alias("r")).agg(F.count(F.lit(1)).alias("n"))
    per_class = classes.join(size, "r").groupBy(F.col("e").alias("cls")).agg(F.sum("n").alias("n_links"), F.max("overlap").alias("overlap"))
    return members.where(~F.col("train")).join(per_class, "cls").select(F.col("id").alias(id_col), "n_links", "overlap")
