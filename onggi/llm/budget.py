"""Token totals per source, language and domain, kept up to date by signed changes.

State, in a folder that all executors share, as numbered versions of Parquet tables:
  counts  (content_hash, tokenizer_hash, n_tokens): one row per content ever seen with a tokenizer;
  docs    (key, content_hash, source, lang, domain_name): the documents of the last version;
  cube    (source, lang, domain_name, n_docs, n_tokens).
An update compares the documents with the last version. Only contents without a count are encoded. Each document that was
added, changed, moved to another slice or removed adds its tokens to its new slice and takes them from its old one.

Unknown values (null, blank, or a source that the list of sources lacks, for its domain) are slices of their own, named
`unknown`. Defined results: null and empty texts cost 0 tokens and count as documents; repeated rows with the same key
are one document (the last by order of content hash), with other keys several; an empty table removes every document
and leaves an empty cube; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onggi.llm import tokenization
from onggi.session import checkpoint_folder

UNKNOWN = "unknown"
# Other spellings of language codes.
LANGUAGE_SPELLINGS = {"kor": "ko", "korean": "ko", "eng": "en", "english": "en", "jpn": "ja", "japanese": "ja", "jp": "ja", "ger": "de", "deu": "de", "german": "de"}


def canonical_source(col: Column) -> Column:
    """One spelling of a source name: lower case, trimmed, parts joined by an underscore; null if blank."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_replace(col, r"^[ \t\r\n]+|[ \t\r\n]+$", "")), r"[- ]+", "_"), F.lit(""))


def canonical_language(col: Column) -> Column:
    """The primary language code; null if blank."""
    code = F.nullif(F.regexp_extract(F.lower(F.regexp_replace(col, r"^[ \t\r\n]+|[ \t\r\n]+$", "")), r"^[a-z]+", 0), F.lit(""))
    out = code
    for other, main in LANGUAGE_SPELLINGS.items():
        out = F.when(code == other, F.lit(main)).otherwise(out)
    return out


def sliced(df: DataFrame, key: Column, text: Column, source: Column, lang: Column, source_info: DataFrame) -> DataFrame:
    """(key, text, source, lang, domain_name) with canonical slices."""
    info = source_info.select(canonical_source(F.col("source")).alias("source"), F.col("domain_name")).dropDuplicates(["source"])
    base = df.select(key.cast("string").alias("key"), F.coalesce(text, F.lit("")).alias("text"), canonical_source(source).alias("source"), canonical_language(lang).alias("lang"))
    named = base.join(info, "source", "left")
    return named.select("key", "text", *[F.coalesce(F.col(c), F.lit(UNKNOWN)).alias(c) for c in ("source", "lang", "domain_name")])


class TokenBudget:
    """See the module's text. `folder` must be reachable from all executors."""

    def __init__(self, spark: SparkSession, folder: str, tokenizer: str = tokenization.BYTE_BPE):
        self.spark, self.folder, self.tokenizer = spark, folder.rstrip("/"), tokenizer
        self.tokenizer_hash = tokenization.tokenizer_hash(tokenizer)
        self.version = 0

    @classmethod
    def in_checkpoint_folder(cls, spark: SparkSession, tokenizer: str = tokenization.BYTE_BPE) -> TokenBudget:
        import uuid

        checkpoint_folder(spark)
        return cls(spark, f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tables/budget-{uuid.uuid4().hex}", tokenizer)

    def _path(self, name: str, version: int) -> str:
        return f"{self.folder}/{name}/v{version:06d}"

    def _read(self, name: str, schema: str) -> DataFrame | None:
        if not self.version:
            return None
        return self.spark.read.schema(schema).parquet(self._path(name, self.version))

    def counts(self) -> DataFrame | None:
        if not self.version:
            return None
        schema = "content_hash binary, tokenizer_hash string, n_tokens bigint"
        return self.spark.read.schema(schema).parquet(*[self._path("counts", v) for v in range(1, self.version + 1)])

    def _encode(self, texts: DataFrame) -> DataFrame:
        """(content_hash, n_tokens) of texts; contents that repeat within a batch are encoded once."""
        path = self.tokenizer

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            enc = tokenization.encoder(path)
            for batch in batches:
                first: dict[bytes, int] = {}
                for i, h in enumerate(batch.column(0).to_pylist()):
                    first.setdefault(h, i)
                rows = batch.take(pa.array(list(first.values()), pa.int64()))
                column = rows.column(1)
                parts = [enc.counts_of(column.slice(a, b - a).to_pylist()) for a, b in tokenization.slices(column)]
                n = np.concatenate(parts) if parts else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64())], names=["content_hash", "n_tokens"])

        return texts.select("content_hash", "text").mapInArrow(run, "content_hash binary, n_tokens bigint")

    def update(self, documents: DataFrame) -> DataFrame:
        """Bring the state to `documents` (key, text, source, lang, domain_name); returns the cube."""
        hashed = documents.withColumn("content_hash", F.unhex(F.md5("text")))
        slices = ["source", "lang", "domain_name"]
        fields = ["content_hash", *slices]
        now = hashed.groupBy("key").agg(F.max(F.struct(*fields)).alias("x")).select("key", *[F.col(f"x.{f}") for f in fields])
        target = self.version + 1
        now.write.parquet(self._path("docs", target))
        schema = "key string, content_hash binary, source string, lang string, domain_name string"
        now = self.spark.read.schema(schema).parquet(self._path("docs", target))
        known = self.counts()
        if known is None:
            unseen = hashed
        else:
            mine = known.where(F.col("tokenizer_hash") == self.tokenizer_hash).select("content_hash")
            missing = now.select("content_hash").distinct().join(mine, "content_hash", "left_anti")
            missing.write.parquet(self._path("missing", target))
            #: The unseen contents are few in an update; their size is known, so the texts need no shuffle then.
            unseen = hashed.join(self.spark.read.schema("content_hash binary").parquet(self._path("missing", target)), "content_hash", "left_semi")
        fresh = self._encode(unseen).groupBy("content_hash").agg(F.max("n_tokens").alias("n_tokens"))
        fresh.select("content_hash", F.lit(self.tokenizer_hash).alias("tokenizer_hash"), "n_tokens").write.parquet(self._path("counts", target))
        before = self._read("docs", schema)
        plus = now.select("key", *fields)
        if before is not None:
            same = [plus[f].eqNullSafe(before[f]) for f in fields]
            stay = plus.join(before, "key").where(same[0] & same[1] & same[2] & same[3]).select(plus["key"])
            deltas = plus.join(stay, "key", "left_anti").withColumn("sign", F.lit(1)).unionByName(before.join(stay, "key", "left_anti").withColumn("sign", F.lit(-1)))
        else:
            deltas = plus.withColumn("sign", F.lit(1))
        old_cube = self._read("cube", "source string, lang string, domain_name string, n_docs bigint, n_tokens bigint")
        self.version = target
        known = self.counts()
        assert known is not None
        tokens = known.where(F.col("tokenizer_hash") == self.tokenizer_hash).groupBy("content_hash").agg(F.max("n_tokens").alias("n_tokens"))
        #: Contents are counted per slice first, so a content that a third of all documents share is one row in the join.
        change = deltas.groupBy("content_hash", *slices).agg(F.sum("sign").alias("sign")).join(tokens, "content_hash")
        change = change.groupBy(*slices).agg(F.sum("sign").cast("bigint").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("bigint").alias("n_tokens"))
        cube = change if old_cube is None else old_cube.unionByName(change).groupBy(*slices).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        cube.where("n_docs <> 0 OR n_tokens <> 0").write.parquet(self._path("cube", target))
        cube = self._read("cube", "source string, lang string, domain_name string, n_docs bigint, n_tokens bigint")
        assert cube is not None
        return cube
