"""Orthographic normalisation of noisy Korean text, of single columns and of whole records."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructField, StructType

from onggi.functions.hangul import FINALS, INITIALS, VOWELS, compose_text

# Fields that hold text, and fields that normalisation leaves alone.
TEXT_FIELDS = ("paragraph", "context", "passage", "prompt", "question", "instruction", "input")
PROTECTED_FIELDS = frozenset(("id", "idx", "qid", "source", "task", "dataset", "label", "answer", "gold", "target", "correct", "split", "noise", "noise_type"))


def normalize_record(df: DataFrame, fields: Sequence[str] = TEXT_FIELDS) -> DataFrame:
    """Compose separate jamo in the text fields that exist and in `choices`; adds `normalized`."""
    new: dict[str, Column] = {f: compose_text(F.col(f)) for f in fields if f in df.columns}
    if "choices" in df.columns:
        new["choices"] = F.transform("choices", compose_text)
    return df.withColumns(new | {"normalized": F.lit(True)})


def compatibility_text(text: str | None) -> str | None:
    """Compatibility forms replaced, jamo composed where they then can be, white space folded.

    The compatibility step already turns separate jamo into conjoining ones, mostly initials; so a syllable's final often
    stays apart. compose_text is the operator that joins them."""
    if text is None:
        return None
    s = unicodedata.normalize("NFKC", text)
    s = _conjoin(s)
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", s)).strip()


_SYLLABLE = re.compile(f"([{INITIALS}])([{VOWELS}])([{''.join(FINALS)}](?![{VOWELS}]))?")


def _conjoin(s: str) -> str:
    """Separate jamo that form a syllable, as conjoining ones."""
    if not re.search("[ㄱ-ㅣ]", s):
        return s
    one = lambda m: chr(0x1100 + INITIALS.index(m[1])) + chr(0x1161 + VOWELS.index(m[2])) + (chr(0x11A7 + FINALS.index(m[3])) if m[3] else "")
    return _SYLLABLE.sub(one, s)


def normalize_compatibility(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """compatibility_text of some string columns; Arrow batches, as no built-in expression knows the Unicode forms."""
    names = [f.name for f in df.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [pa.array(list(map(compatibility_text, a.to_pylist())), pa.string()) if n in columns else a for n, a in zip(names, batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(run, df.schema)


def normalize_nested(df: DataFrame, protected: frozenset[str] = PROTECTED_FIELDS) -> DataFrame:
    """compatibility_text of every string at any depth, but for protected keys (with all below them).

    One pass over Arrow batches, guided by the schema: the strings of a level are one flat array each, lists and structs are
    rebuilt around them. Map keys are field names, so a map's values are kept where the key is protected."""
    touched = {f.name for f in df.schema if f.name not in protected and _has_text(f.dataType)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [_normalized(a, protected) if n in touched else a for n, a in zip(batch.schema.names, batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def _normalized(a: pa.Array, protected: frozenset[str]) -> pa.Array:
    kind = a.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return pa.array(list(map(compatibility_text, a.to_pylist())), kind)
    if pa.types.is_list(kind):
        flat = _normalized(a.flatten(), protected)
        sizes = [0 if n is None else n for n in pc.list_value_length(a).to_pylist()]
        offsets = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), flat, type=kind, mask=pc.is_null(a))
    if pa.types.is_struct(kind):
        parts = [x if f.name in protected else _normalized(x, protected) for f, x in zip(kind, a.flatten(), strict=True)]
        return pa.StructArray.from_arrays(parts, fields=list(kind), mask=pc.is_null(a))
    if pa.types.is_map(kind):
        rows = [None if m is None else [(k, v if k in protected or not isinstance(v, str) else compatibility_text(v)) for k, v in m] for m in a.to_pylist()]
        return pa.array(rows, kind)
    return a


def normalize_json(record: str | None, protected: frozenset[str] = PROTECTED_FIELDS) -> str | None:
    """The same for one JSON record of unknown shape; null and malformed records are null."""

    def walk(x: object) -> object:
        if isinstance(x, dict):
            return {k: v if k in protected else walk(v) for k, v in x.items()}
        if isinstance(x, list):
            return list(map(walk, x))
        return compatibility_text(x) if isinstance(x, str) else x

    try:
        return None if record is None else json.dumps(walk(json.loads(record)), ensure_ascii=False)
    except ValueError:
        return None


def normalize_json_records(df: DataFrame, column: str, protected: frozenset[str] = PROTECTED_FIELDS) -> DataFrame:
    """A column of JSON records normalised, with `changed`: whether a record's content is another one now."""
    from pyspark.sql.types import BooleanType

    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(names.index(column)).to_pylist()
            new = [normalize_json(x, protected) for x in old]
            changed = [y is not None and json.loads(y) != json.loads(x) for x, y in zip(old, new, strict=True)]
            arrays = [pa.array(new, pa.string()) if n == column else a for n, a in zip(names, batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(changed, pa.bool_())], names=[*names, "changed"])

    return df.mapInArrow(run, StructType([*df.schema, StructField("changed", BooleanType())]))


def _has_text(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _has_text(kind.elementType)
    if isinstance(kind, MapType):
        return _has_text(kind.valueType)
    if isinstance(kind, StructType):
        return any(_has_text(f.dataType) for f in kind)
    return isinstance(kind, StringType)


def changed_rows(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(n_rows, n_changed): rows that differ in some column, nulls being equal."""
    a = before.select(key, *[F.col(c).alias(f"__a_{c}") for c in columns])
    b = after.select(key, *[F.col(c).alias(f"__b_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"__a_{c}").eqNullSafe(F.col(f"__b_{c}"))
    return a.join(b, key).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~same).alias("n_changed"))
