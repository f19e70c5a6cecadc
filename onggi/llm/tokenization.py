"""Encoding with a public byte-level BPE tokenizer by a tokenization automaton.

The automaton is a deterministic automaton over token labels. It starts with one state in which every byte may follow
every byte, and each merge (u, v) -> w adds one gadget to it, in order: v no longer follows u; w leads where v led; w is
an arc wherever u is one. What may follow depends on the last label only, so a state is a last label, and the question
"is there an arc x out of state p" is answered from the gadgets that made p and x. Answers are kept in a transition
table, as rows of the automaton are only built when a text needs them. A word has exactly one path through the
automaton whose labels spell it: the path of BPE. Its labels are the ids, and decoding emits their bytes.

Defined results: null and empty texts have an empty list; strings that look like special tokens are ordinary text;
rows may repeat (each keeps its result); other columns are not read, so clashing names do not matter; an empty table
gives an empty table; a text of any length is encoded whole, in bounded slices.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters of texts handled at a time, and ids kept of words seen, in one worker.
SLICE_CHARS = 1_000_000
POOL_IDS = 4_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenizationAutomaton:
    """States are last labels; see the module's text."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.vocab = vocab
        self.labels = {i: b for b, i in vocab.items()}
        self.longest = max(map(len, vocab))
        n = max(vocab.values()) + 1
        self.birth = [-1] * n
        self.left, self.right = [-1] * n, [-1] * n
        self.gadget: dict[int, int] = {}
        self.size = n
        self.arcs: dict[int, bool] = {}
        self.lengths = [len(self.labels.get(i, b"")) for i in range(n)]
        #: Table of the bytes of all labels: (node, byte) -> node, and the label that ends at a node.
        self.step: dict[int, int] = {}
        self.ends = [-1]
        for b, i in vocab.items():
            node = 0
            for byte in b:
                key = node << 8 | byte
                if (to := self.step.get(key)) is None:
                    to = self.step[key] = len(self.ends)
                    self.ends.append(-1)
                node = to
            self.ends[node] = i
        for k, (u, v) in enumerate(merges):
            a, b, w = vocab[u], vocab[v], vocab[u + v]
            self.gadget.setdefault(a * n + b, k)
            if self.birth[w] < 0:
                self.birth[w], self.left[w], self.right[w] = k, a, b
        #: For each label, the longest label that is a proper prefix of it.
        self.shorter = {i: next((vocab[b[:j]] for j in range(len(b) - 1, 0, -1) if b[:j] in vocab), -1) for b, i in vocab.items()}

    @classmethod
    def from_file(cls, path: str) -> TokenizationAutomaton:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        to = byte_alphabet()
        raw = lambda s: bytes(to[c] for c in s)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        merged = {a + b for a, b in pairs}
        vocab = {raw(t): i for t, i in model["vocab"].items() if t in merged or len(t) == 1 and t in to}
        return cls(vocab, [(raw(a), raw(b)) for a, b in pairs])

    def arc(self, state: int, label: int) -> bool:
        """Whether `label` leads out of `state` (-1: the start, from which every label leads)."""
        if state < 0:
            return True
        key = state * self.size + label
        known = self.arcs.get(key)
        if known is not None:
            return known
        birth, gadget, n = self.birth, self.gadget, self.size
        p, x, upto = state, label, len(self.gadget) + 1
        while True:
            k = gadget.get(p * n + x)
            if k is not None and k <= upto:
                found = False
                break
            if birth[p] < 0 and birth[x] < 0:
                found = True
                break
            if birth[p] > birth[x]:
                upto = min(upto, birth[p] - 1)
                p = self.right[p]
            else:
                upto = min(upto, birth[x])
                x = self.left[x]
        if len(self.arcs) > 3_000_000:
            self.arcs.clear()
        self.arcs[key] = found
        return found

    def _match(self, word: bytes, at: int) -> int:
        """The longest label that begins at a position."""
        step, node, best = self.step, 0, -1
        for byte in word[at : at + self.longest]:
            node = step.get(node << 8 | byte, 0)
            if not node:
                break
            if (i := self.ends[node]) >= 0:
                best = i
        return best

    def path(self, word: bytes) -> list[int]:
        """The labels of the one path that spells a word; dead ends are remembered, so the time is linear in its length."""
        if (whole := self.vocab.get(word)) is not None and self._own(whole):
            return [whole]
        out: list[int] = []
        n, size = len(word), self.size
        dead: set[int] = set()
        arcs, arc, match, lengths, shorter = self.arcs, self.arc, self._match, self.lengths, self.shorter
        at, label, last = 0, match(word, 0), -1
        while at < n:
            while label >= 0:
                end = at + lengths[label]
                if end not in dead:
                    known = arcs.get(last * size + label) if last >= 0 else True
                    if known or known is None and arc(last, label):
                        break
                label = shorter[label]
            if label >= 0:
                out.append(label)
                last, at = label, end
                if at < n:
                    label = match(word, at)
            else:
                dead.add(at)
                label = out.pop()
                at -= lengths[label]
                last = out[-1] if out else -1
                label = shorter[label]
        return out

    def _own(self, label: int) -> bool:
        """Whether the path of a label's own bytes is the label: its last gadget's parts follow each other until then."""
        p, x, upto = self.left[label], self.right[label], self.birth[label] - 1
        if upto < -1:
            return True
        if self.birth[label] < 0:
            return True
        birth, gadget, n = self.birth, self.gadget, self.size
        while True:
            k = gadget.get(p * n + x)
            if k is not None and k <= upto:
                return False
            if birth[p] < 0 and birth[x] < 0:
                return True
            if birth[p] > birth[x]:
                upto = min(upto, birth[p] - 1)
                p = self.right[p]
            else:
                upto = min(upto, birth[x])
                x = self.left[x]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


#: Unicode's White_Space, as the public pattern means it (re's own class has four control characters more).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Runs between white space, each with the one space before it. The public pattern never reaches over their borders.
CHUNKS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall


class Encoder:
    """Encodes texts by runs between white space; runs seen are kept, up to a bound, with their ids in one flat pool."""

    def __init__(self, path: str, pattern: str = PATTERN):
        self.automaton = TokenizationAutomaton.from_file(path)
        self.split = regex.compile(pattern).findall
        self._clear()

    def _clear(self) -> None:
        self.seen: dict[str, int] = {}
        self.parts: dict[str, list[int]] = {}
        self.starts: list[int] = []
        self.counts: list[int] = []
        self.pool: list[int] = []
        self.frozen: tuple[int, np.ndarray, np.ndarray, np.ndarray] | None = None

    def _index(self, words: list[str]) -> np.ndarray:
        if len(self.pool) > POOL_IDS:
            self._clear()
        seen, parts, path, pool, split = self.seen, self.parts, self.automaton.path, self.pool, self.split
        index = list(map(seen.get, words))
        if None in index:
            for i, known in enumerate(index):
                if known is None:
                    w = words[i]
                    if (at := seen.get(w)) is None:
                        at = seen[w] = len(self.starts)
                        self.starts.append(len(pool))
                        for part in split(w):
                            if (ids := parts.get(part)) is None:
                                ids = parts[part] = path(part.encode("utf-8"))
                            pool += ids
                        self.counts.append(len(pool) - self.starts[-1])
                    index[i] = at
        return np.array(index, np.int64)

    def _arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.frozen is None or self.frozen[0] != len(self.starts):
            self.frozen = (len(self.starts), np.array(self.starts, np.int64), np.array(self.counts, np.int64), np.array(self.pool, np.int32))
        return self.frozen[1:]

    def _words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Indices of all words, and the number of words up to the end of each text."""
        words: list[str] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for i, t in enumerate(texts):
            if t:
                words += CHUNKS(t)
            ends[i + 1] = len(words)
        return self._index(words), ends

    def counts_of(self, texts: list[str | None]) -> np.ndarray:
        """Number of tokens of each text."""
        index, ends = self._words(texts)
        _, counts, _ = self._arrays()
        total = np.concatenate(([0], np.cumsum(counts[index])))
        return np.diff(total[ends])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of the texts in the flat ids, and the ids."""
        index, ends = self._words(texts)
        starts, counts, pool = self._arrays()
        n = counts[index]
        total = np.concatenate(([0], np.cumsum(n)))
        flat = np.repeat((starts[index] - total[:-1]).astype(np.int32), n)
        flat += np.arange(len(flat), dtype=np.int32)
        return total[ends].astype(np.int32), pool[flat]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker: compiled once, used by all its tasks."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def slices(texts: pa.Array, chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about so many characters; a longer text is a range of its own."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > 2 * chars:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = BYTE_BPE) -> DataFrame:
    """(id, ids): the ids of every text. One narrow pass, no shuffle; null and empty texts have an empty list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                offsets, ids = enc.encode(batch.column(1).slice(a, b - a).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str = BYTE_BPE) -> DataFrame:
    """(id, text): the bytes of the arc labels, joined. Null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(tokenizer).automaton.decode
        for batch in batches:
            texts = [None if x is None else decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("id"), df[ids_col].alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def token_counts(df: DataFrame, text_col: str = "text", out: str = "n_tokens", tokenizer: str = BYTE_BPE) -> DataFrame:
    """The table with the number of tokens of one text column (0 for null and empty); the text leaves the row."""
    from pyspark.sql.types import LongType, StructField, StructType

    keep = [c for c in df.columns if c != text_col]
    schema = StructType([*[df.schema[c] for c in keep], StructField(out, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            texts = batch.column(len(keep))
            n = [enc.counts_of(texts.slice(a, b - a).to_pylist()) for a, b in slices(texts)]
            counts = np.concatenate(n) if n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(counts, pa.int64())], names=[*keep, out])

    return df.select(*[df[c] for c in keep], df[text_col]).mapInArrow(run, schema)


def tokenizer_hash(path: str) -> str:
    """Hash of the tokenizer's own bytes: another vocabulary is another hash, wherever the file lies."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:16]


def roundtrip(df: DataFrame, text_col: str = "text", tokenizer: str = BYTE_BPE) -> DataFrame:
    """The table without its text, with `same`: whether decoding the ids gives the text (null counts as empty)."""
    from pyspark.sql.types import BooleanType, StructField, StructType

    keep = [c for c in df.columns if c != text_col]
    schema = StructType([*[df.schema[c] for c in keep], StructField("same", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        labels = enc.automaton.labels
        for batch in batches:
            same: list[bool] = []
            for a, b in slices(batch.column(len(keep))):
                texts = batch.column(len(keep)).slice(a, b - a).to_pylist()
                offsets, ids = enc.encode(texts)
                flat = list(map(labels.__getitem__, ids.tolist()))
                same += [b"".join(flat[offsets[i] : offsets[i + 1]]) == (t or "").encode("utf-8") for i, t in enumerate(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(same, pa.bool_())], names=[*keep, "same"])

    return df.select(*[df[c] for c in keep], df[text_col]).mapInArrow(run, schema)
