"""Queries of the engine's own operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onggi.functions import draws, hangul, text
from onggi.operators import mcq, metrics, noise, normalize, pack, scoring, tokens
from onggi.plans import oracle as o
from onggi.plans import pipeline
from onggi.session import scratch, spread, table
from onggi.sources import records as sources
from onggi.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def records(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "instructions"))


def clean_items(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "mcq_items").where("noise_type IS NULL OR noise_type = 'clean'")


# --- text functions -----------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {o.lines_sql('text')} AS t FROM documents")
def normalize_keep_newlines(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "documents")).select("doc_id", text.normalize_lines(F.col("text")).alias("t"))


@query(f"SELECT doc_id, {o.flat_sql('text')} AS t FROM documents")
def normalize_flatten(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "documents")).select("doc_id", text.normalize_flat(F.col("text")).alias("t"))


_OUT = "src AS (SELECT rec_id AS k, coalesce(output, '') AS t FROM instructions)"


@query(o.with_([_OUT, *o.plain_stage("r", "src", f"CASE WHEN {o.SYL} THEN {o.JAMO} ELSE c END")], "SELECT k AS rec_id, md5(t) AS jamo_md5, length(t) AS n FROM r"))
def hangul_decompose(s: SparkSession, d: str) -> DataFrame:
    t = hangul.decompose_text(text.as_text(F.col("output")))
    return records(s, d).select("rec_id", t.alias("t")).select("rec_id", F.md5("t").alias("jamo_md5"), F.length("t").cast("bigint").alias("n"))


@query(
    o.with_(
        [_OUT, *o.plain_stage("r", "src", f"CASE WHEN {o.SYL} THEN {o.JAMO} ELSE c END"), *o.compose_stage("c", "r")],
        "SELECT count(*) AS n, count(*) FILTER (WHERE c.t = src.t) AS n_same, sum(('0x' || substr(md5(k || ':' || c.t), 1, 8))::BIGINT)::BIGINT AS digest FROM c JOIN src USING (k)",
    )
)
def hangul_compose_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Texts that come back unchanged from separate jamo, with a digest that does not depend on the order of the rows."""
    old = text.as_text(F.col("output"))
    rows = records(s, d).select("rec_id", old.alias("old"), hangul.compose_text(hangul.decompose_text(old)).alias("new"))
    digest = F.sum(F.conv(F.substring(F.md5(F.concat_ws(":", F.col("rec_id").cast("string"), "new")), 1, 8), 16, 10).cast("bigint"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("old") == F.col("new")).alias("n_same"), digest.alias("digest"))


@query(
    o.with_(
        ["src AS (SELECT pair_id AS k, coalesce(noisy_instruction, '') AS t FROM noisy_pairs)", *o.compose_stage("c", "src")],
        "SELECT pair_id, c.t AS composed, c.t <> coalesce(noisy_instruction, '') AS changed FROM noisy_pairs JOIN c ON k = pair_id",
    )
)
def compose_normalize(s: SparkSession, d: str) -> DataFrame:
    new = hangul.compose_text(text.as_text(F.col("noisy_instruction")))
    return table(s, d, "noisy_pairs").select("pair_id", new.alias("composed"), (new != text.as_text(F.col("noisy_instruction"))).alias("changed"))


@query(
    o.with_(
        [o.compatibility_table(), "a AS MATERIALIZED (SELECT id, noise_type, row_number() OVER () AS k, coalesce(question, '') AS t, question FROM mcq_items)", *o.compatibility_stage("c", "a")],
        "SELECT id, noise_type, CASE WHEN question IS NULL THEN NULL ELSE t END AS question FROM c",
    )
)
def nfkc_normalize(s: SparkSession, d: str) -> DataFrame:
    items = table(s, d, "mcq_items").select("id", "noise_type", "question")
    return normalize.normalize_compatibility(items, ["question"])


@query(
    o.with_(
        ["a AS MATERIALIZED (SELECT id, noise_type, choices, row_number() OVER () AS k, coalesce(question, '') AS t, question FROM mcq_items)", *o.compose_stage("c", "a")],
        "SELECT id, noise_type, CASE WHEN question IS NULL THEN NULL ELSE t END AS question, true AS normalized FROM c",
    )
)
def normalize_records(s: SparkSession, d: str) -> DataFrame:
    return normalize.normalize_record(table(s, d, "mcq_items")).select("id", "noise_type", "question", "normalized")


@query(
    o.with_(
        [
            o.compatibility_table(), "a AS MATERIALIZED (SELECT *, row_number() OVER () AS r FROM mcq_items)",
            "x AS MATERIALIZED (SELECT r * 100 AS k, coalesce(question, '') AS t, r, 0 AS j, question IS NULL AS no FROM a UNION ALL SELECT r * 100 + j, coalesce(c, ''), r, j, c IS NULL FROM (SELECT r, unnest(choices) AS c, generate_subscripts(choices, 1) AS j FROM a))",
            *o.compatibility_stage("n", "x"), "l AS (SELECT r, max(CASE WHEN j = 0 AND NOT no THEN t END) AS q, list(CASE WHEN no THEN NULL ELSE t END ORDER BY j) FILTER (WHERE j > 0) AS cs FROM n GROUP BY r)",
        ],
        "SELECT id, noise_type, q AS question, CASE WHEN len(choices) = 0 THEN choices ELSE cs END AS choices, source FROM a JOIN l USING (r)",
    )
)
def normalize_nested_records(s: SparkSession, d: str) -> DataFrame:
    items = table(s, d, "mcq_items")
    nested = items.select("id", "noise_type", F.struct("question", "choices", "source").alias("body"))
    return normalize.normalize_nested(nested).select("id", "noise_type", "body.question", "body.choices", "body.source")


@query(
    o.with_(
        [o.compatibility_table(), "a AS MATERIALIZED (SELECT id, row_number() OVER () AS k, coalesce(question, '') AS t, question FROM mcq_items)", *o.compatibility_stage("c", "a")],
        "SELECT count(*) AS n_records, count(*) FILTER (WHERE question IS NOT NULL AND question <> t) AS n_changed FROM c",
    )
)
def normalize_json_changes(s: SparkSession, d: str) -> DataFrame:
    """JSON records normalised at any depth: how many there are and how many changed."""
    raw = table(s, d, "mcq_items").select(F.to_json(F.struct("id", F.struct("question").alias("body"))).alias("record"))
    return normalize.normalize_json_records(raw, "record").agg(F.count(F.lit(1)).alias("n_records"), F.count_if("changed").alias("n_changed"))


@query(
    "WITH p AS (SELECT *, CASE WHEN {b} <> '' THEN {a} || chr(10) || chr(10) || {b} ELSE {a} END AS u FROM instructions), "
    "q AS (SELECT rec_id, '<|system|>' || chr(10) || {sys} || chr(10) || '<|user|>' || chr(10) || u || chr(10) || '<|assistant|>' || chr(10) AS s, "
    "'<|im_start|>system' || chr(10) || {sys} || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || u || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS w, {out} AS o FROM p) "
    "SELECT rec_id, s AS prompt_simple, w AS prompt_qwen, s || o || '</s>' AS full_simple, w || o || '<|im_end|>' AS full_qwen FROM q".format(
        a=o.lines_sql("instruction"), b=o.lines_sql("input"), out=o.lines_sql("output"), sys=o.literal(text.SYSTEM_PROMPT)
    )
)
def prompts(s: SparkSession, d: str) -> DataFrame:
    a, b, c = F.col("instruction"), F.col("input"), F.col("output")
    return records(s, d).select(
        "rec_id", text.prompt(a, b).alias("prompt_simple"), text.prompt(a, b, "qwen").alias("prompt_qwen"), text.full_text(a, b, c, eos="</s>").alias("full_simple"), text.full_text(a, b, c, "qwen").alias("full_qwen")
    )


@query(
    "WITH j AS (SELECT rec_id, array_to_string(list_filter([coalesce(instruction, ''), coalesce(input, ''), coalesce(output, '')], lambda x: x <> ''), chr(10)) AS t FROM instructions) "
    f"SELECT rec_id, replace({o.strip_sql('t')}, chr(13) || chr(10), chr(10)) AS corpus FROM j WHERE {o.strip_sql('t')} <> ''"
)
def instruction_to_corpus(s: SparkSession, d: str) -> DataFrame:
    rows = records(s, d).select("rec_id", text.corpus_text(F.col("instruction"), F.col("input"), F.col("output")).alias("corpus"))
    return rows.where("corpus IS NOT NULL")


@query("SELECT DISTINCT source, translate(source, '/.: ', '____') AS safe, 'run.' || substr(md5(source), 1, 8) || '.v1' AS cache FROM instructions WHERE source IS NOT NULL")
def safe_names(s: SparkSession, d: str) -> DataFrame:
    src = F.col("source")
    rows = records(s, d).where("source IS NOT NULL").select("source").distinct()
    return rows.select("source", text.safe_name(src).alias("safe"), text.cache_name(F.lit("run"), src, F.lit("v1")).alias("cache"))


# --- noise --------------------------------------------------------------------------------------------------------


def _pair_base(field: str, key: str = "k") -> Callable[[str], str]:
    return lambda stage: o.base_sql("'42'", key, f"'{field}'", f"'{stage}'")


_A = f"src AS (SELECT rec_id::VARCHAR AS k, {o.lines_sql('instruction')} AS t FROM instructions)"


def _register_pair_noise() -> None:
    for kind in noise.PAIR_NOISES:

        def run(s: SparkSession, d: str, kind: str = kind) -> DataFrame:
            t = text.normalize_lines(F.col("instruction"))
            noisy = noise.corrupt_pair_text(F.col("t"), kind, lambda stage: draws.base(42, F.col("rec_id"), "instruction", stage))
            return records(s, d).select("rec_id", t.alias("t")).select("rec_id", noisy.alias("noisy"))

        QUERIES[f"noise_{kind}_a"] = run
        SQL[f"noise_{kind}_a"] = o.with_([_A, *o.pair_noise("r", "src", kind, _pair_base("instruction"))], "SELECT k::BIGINT AS rec_id, t AS noisy FROM r")


_register_pair_noise()

_ITEMS = "src AS MATERIALIZED (SELECT id, task, row_number() OVER () AS k, coalesce(question, '') AS t FROM mcq_items WHERE noise_type IS NULL OR noise_type = 'clean')"


def _bench_base(kind: str, field: str) -> Callable[[str], str]:
    return lambda stage: o.base_sql("'42'", "task", "id", f"'{kind}'", f"'{field}'", f"'{stage}'")


@query(
    o.with_(
        [_ITEMS, *[c for kind in noise.BENCH_NOISES[1:] for c in o.bench_noise(f"r_{kind}", "src", kind, _bench_base(kind, "question"))]],
        "SELECT id, task, 'clean' AS noise_type, t AS question FROM src " + " ".join(f"UNION ALL SELECT id, task, '{kind}', t FROM r_{kind}" for kind in noise.BENCH_NOISES[1:]),
    )
)
def bench_variants(s: SparkSession, d: str) -> DataFrame:
    items = clean_items(s, d).withColumn("question", text.as_text(F.col("question")))
    return noise.bench_variants(items).select("id", "task", "noise_type", "question")


def _choice_base(kind: str) -> Callable[[str], str]:
    return lambda stage: o.base_sql("'42'", "task", "id", f"'{kind}'", "'choices'", "j::VARCHAR", f"'{stage}'")


def _choices_sql(kind: str) -> str:
    rows, choices = ("src", "chs") if kind == "clean" else (f"r_{kind}", f"c_{kind}")
    return f"SELECT s.id, '{kind}' AS noise_type, s.t AS question, l.cs AS choices FROM {rows} s LEFT JOIN (SELECT r, list(CASE WHEN no THEN NULL ELSE t END ORDER BY j) AS cs FROM {choices} GROUP BY r) l ON l.r = s.k"


@query(
    o.with_(
        [
            "src AS MATERIALIZED (SELECT id, task, choices, row_number() OVER () AS k, coalesce(question, '') AS t FROM mcq_items WHERE noise_type IS NULL OR noise_type = 'clean')",
            "chs AS MATERIALIZED (SELECT id, task, k AS r, k * 100 + j AS k, j - 1 AS j, coalesce(c, '') AS t, c IS NULL AS no FROM (SELECT id, task, k, unnest(choices) AS c, generate_subscripts(choices, 1) AS j FROM src))",
            *[c for kind in noise.BENCH_NOISES[1:] for c in o.bench_noise(f"r_{kind}", "src", kind, _bench_base(kind, "question")) + o.bench_noise(f"c_{kind}", "chs", kind, _choice_base(kind))],
        ],
        " UNION ALL ".join(map(_choices_sql, noise.BENCH_NOISES)),
    )
)
def bench_variants_with_choices(s: SparkSession, d: str) -> DataFrame:
    items = clean_items(s, d).withColumn("question", text.as_text(F.col("question")))
    return noise.bench_variants(items, corrupt_choices=True).select("id", "noise_type", "question", "choices")


@query(
    o.with_(
        [_ITEMS.replace("SELECT id, task,", "SELECT id, task, source,"), *[c for kind in noise.BENCH_NOISES[1:] for c in o.bench_noise(f"r_{kind}", "src", kind, _bench_base(kind, "context"))]],
        "SELECT id, 'clean' AS noise_type, source, t AS context FROM src " + " ".join(f"UNION ALL SELECT id, '{kind}', source, t FROM r_{kind}" for kind in noise.BENCH_NOISES[1:]),
    )
)
def corrupt_existing_fields(s: SparkSession, d: str) -> DataFrame:
    """Records that have one of the seven text fields only: that one is corrupted, whatever else they hold stays."""
    rows = clean_items(s, d).select("id", "task", "source", text.as_text(F.col("question")).alias("context"))
    return noise.corrupt_records(rows, normalize.TEXT_FIELDS).select("id", "noise_type", "source", "context")


_PAIR_SRC = (
    f"p AS (SELECT rec_id, {o.lines_sql('instruction')} AS ci, {o.lines_sql('input')} AS cn, {o.lines_sql('output')} AS co, source FROM instructions), "
    "f AS (SELECT * FROM p WHERE co <> '' AND length(ci) + length(cn) BETWEEN 4 AND 4096)"
)


def _pairs_sql(kinds: tuple[str, ...], chosen: str, select: str) -> str:
    ctes = [_PAIR_SRC, f"w AS ({chosen})"]
    for kind in kinds:
        for f, col in (("instruction", "ci"), ("input", "cn")):
            ctes.append(f"s_{kind}_{f} AS (SELECT rec_id::VARCHAR AS k, {col} AS t FROM w WHERE noise_type = '{kind}')")
            ctes += o.pair_noise(f"r_{kind}_{f}", f"s_{kind}_{f}", kind, _pair_base(f))
    parts = " UNION ALL ".join(
        f"SELECT w.*, a.t AS noisy_instruction, b.t AS noisy_input FROM w JOIN r_{k}_instruction a ON a.k = w.rec_id::VARCHAR JOIN r_{k}_input b ON b.k = a.k WHERE noise_type = '{k}'" for k in kinds
    )
    ctes.append(f"pairs AS (SELECT * FROM ({parts}) WHERE ci <> noisy_instruction OR cn <> noisy_input)")
    return o.with_(ctes, select)


_DRAWN = f"SELECT f.*, {o.base_sql(chr(39) + '42' + chr(39), 'rec_id::VARCHAR', chr(39) + 'noise_type' + chr(39))} AS b, {o.draw_cols('d', 0, 'b', '0')}, {list(noise.PAIR_NOISES)!r}[d * 5 // {o.M} + 1] AS noise_type FROM f"
_ALL = f"SELECT f.*, unnest({list(noise.PAIR_NOISES)!r}) AS noise_type FROM f"


@query(_pairs_sql(noise.PAIR_NOISES, _DRAWN, "SELECT rec_id, rec_id::VARCHAR || ':' || noise_type AS pair_id, ci AS clean_instruction, cn AS clean_input, noisy_instruction, noisy_input, co AS output FROM pairs"))
def noisy_pairs(s: SparkSession, d: str) -> DataFrame:
    return noise.noisy_pairs(records(s, d)).select("rec_id", "pair_id", "clean_instruction", "clean_input", "noisy_instruction", "noisy_input", "output")


@query(_pairs_sql(noise.PAIR_NOISES, _ALL, "SELECT noise_type, source, count(*) AS n_pairs, count(DISTINCT rec_id) AS n_records FROM pairs GROUP BY ALL"))
def noisy_pairs_all_types(s: SparkSession, d: str) -> DataFrame:
    """Pairs of all noise types, counted by type and source."""
    rows = noise.noisy_pairs(records(s, d), all_types=True)
    return rows.groupBy("noise_type", "source").agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("rec_id").alias("n_records"))


@query(
    _pairs_sql(
        noise.PAIR_NOISES, _DRAWN,
        "SELECT (SELECT count(*) FROM instructions) AS n_read, (SELECT count(*) FROM pairs) AS n_written, (SELECT count(*) FROM f) AS n_usable, "
        "(SELECT count(*) FROM instructions) - (SELECT count(DISTINCT rec_id) FROM pairs) AS n_skipped",
    )
)
def pair_run_counters(s: SparkSession, d: str) -> DataFrame:
    df = records(s, d)
    rows = noise.noisy_pairs(df, keep_unchanged=True).select("rec_id", "text_changed")
    read = df.agg(F.count(F.lit(1)).alias("n_read"))
    counts = rows.agg(F.count_if("text_changed").alias("n_written"), F.count(F.lit(1)).alias("n_usable"), F.countDistinct(F.when(F.col("text_changed"), F.col("rec_id"))).alias("kept"))
    return counts.crossJoin(F.broadcast(read)).select("n_read", "n_written", "n_usable", (F.col("n_read") - F.col("kept")).alias("n_skipped"))


@query(
    "WITH k AS (SELECT unnest(['spacing', 'vowel', 'consonant', 'jong', 'mixed', 'jamo']) AS noise_type) "
    "SELECT k.noise_type, count(p.pair_id) AS n_pairs, count(p.pair_id) FILTER (WHERE text_changed) AS n_changed FROM k LEFT JOIN noisy_pairs p USING (noise_type) GROUP BY ALL"
)
def noise_type_counts(s: SparkSession, d: str) -> DataFrame:
    """Counts of requested noise types, also of those without pairs."""
    kinds = s.createDataFrame([(k,) for k in (*noise.PAIR_NOISES, "jamo")], "noise_type string")
    counts = table(s, d, "noisy_pairs").groupBy("noise_type").agg(F.count("pair_id").alias("n"), F.count_if("text_changed").alias("c"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return kinds.join(counts, "noise_type", "left").select("noise_type", zero("n").alias("n_pairs"), zero("c").alias("n_changed"))


def _jamo_fields(select: str) -> str:
    ctes = ["src AS (SELECT rec_id::VARCHAR AS k, coalesce(instruction, '') AS t FROM instructions)", "srd AS (SELECT rec_id::VARCHAR AS k, coalesce(input, '') AS t FROM instructions)"]
    ctes += o.jamo_stage("a", "src", _pair_base("instruction")("jamo"), 0.10) + o.jamo_stage("b", "srd", _pair_base("input")("jamo"), 0.10)
    return o.with_(ctes, select)


@query(_jamo_fields("SELECT a.k::BIGINT AS rec_id, a.t AS instruction, b.t AS input, a.t <> src.t OR b.t <> srd.t AS jamo_changed FROM a JOIN b USING (k) JOIN src USING (k) JOIN srd USING (k)"))
def jamo_substitute(s: SparkSession, d: str) -> DataFrame:
    return noise.substitute_jamo(records(s, d)).select("rec_id", "instruction", "input", "jamo_changed")


@query(
    _jamo_fields(
        f"SELECT (SELECT count(*) FROM a_o WHERE {o.SYL})::BIGINT AS instruction_hangul, (SELECT count(*) FROM a_o WHERE {o.SYL} AND d0 < {o.below(0.10)})::BIGINT AS instruction_changed, "
        f"(SELECT count(*) FROM b_o WHERE {o.SYL})::BIGINT AS input_hangul, (SELECT count(*) FROM b_o WHERE {o.SYL} AND d0 < {o.below(0.10)})::BIGINT AS input_changed"
    )
)
def jamo_substitution_stats(s: SparkSession, d: str) -> DataFrame:
    rows = noise.substitute_jamo(records(s, d))
    return rows.agg(*[F.sum(f"{f}_{k}").alias(f"{f}_{k}") for f in ("instruction", "input") for k in ("hangul", "changed")])


@query(
    _jamo_fields(
        "SELECT rec_id, 0 AS copy, instruction, false AS jamo_substitution FROM instructions UNION ALL SELECT a.k::BIGINT, 1, a.t, true FROM a"
    )
)
def jamo_substitute_clean_copy(s: SparkSession, d: str) -> DataFrame:
    return noise.substitute_jamo(records(s, d), clean_copies=True).select("rec_id", "copy", "instruction", "jamo_substitution")


@query(
    o.with_(
        [
            "src AS (SELECT rec_id::VARCHAR AS k, coalesce(instruction, '') AS t FROM instructions)", "srd AS (SELECT rec_id::VARCHAR AS k, coalesce(input, '') AS t FROM instructions)",
            *o.jamo_stage("a", "src", _pair_base("instruction")("jamo"), 0.10), *o.jamo_stage("b", "srd", _pair_base("input")("jamo"), 0.10), *o.compose_stage("ca", "a"), *o.compose_stage("cb", "b"),
        ],
        "SELECT (SELECT round(avg((ca.t = src.t)::INT), 6) FROM ca JOIN src USING (k)) AS instruction_rate, (SELECT round(avg((cb.t = srd.t)::INT), 6) FROM cb JOIN srd USING (k)) AS input_rate",
    )
)
def normalize_roundtrip_rate(s: SparkSession, d: str) -> DataFrame:
    """Per field: texts that composition brings back after jamo noise."""
    rows = noise.substitute_jamo(records(s, d), clean_fields=True)
    return rows.agg(*[F.round(F.avg((hangul.compose_text(F.col(f)) == F.col(f"clean_{f}")).cast("int")), 6).alias(f"{f}_rate") for f in ("instruction", "input")])


# --- multiple choice ----------------------------------------------------------------------------------------------


def raw_mcq(s: SparkSession, d: str) -> DataFrame:
    """Benchmark items as records of several shapes, as sources deliver them."""
    items = clean_items(s, d).select("id", "task", "subset", "question", "choices", "answer", "source")
    digit = F.pmod(F.length("id") + F.coalesce("answer", F.lit(0)), F.lit(3))
    letter = F.substring(F.lit("ABCDEFGH"), F.col("answer") + 1, 1)
    shaped = F.when(digit == 0, F.to_json(F.struct("id", "question", "choices", "answer"))).when(
        digit == 1, F.to_json(F.struct("id", F.col("question").alias("query"), F.to_json("choices").alias("options"), letter.alias("label")))
    )
    shaped = shaped.otherwise(F.to_json(F.struct("id", F.col("question").alias("passage"), F.col("choices").alias("candidates"), F.element_at("choices", F.col("answer") + 1).alias("target"))))
    return items.select(F.lit("other").alias("task"), "subset", F.lit(0).alias("idx"), "source", shaped.alias("record"))


@query(
    f"WITH m AS (SELECT *, list_transform(choices, lambda c: {o.strip_sql('c')}) AS cc FROM mcq_items WHERE (noise_type IS NULL OR noise_type = 'clean') AND answer IS NOT NULL AND len(choices) >= 2 AND {o.strip_sql('question')} <> '') "
    f"SELECT id, 'other' AS task, subset, {o.strip_sql('question')} AS question, cc AS choices, "
    f"CASE WHEN (length(id) + answer) % 3 = 2 AND NOT regexp_matches({o.strip_sql('choices[answer + 1]')}, '^([0-9]+|[A-Ea-e])$') THEN list_position(cc, {o.strip_sql('choices[answer + 1]')})::INT - 1 ELSE answer END AS answer, source FROM m"
)
def mcq_extract(s: SparkSession, d: str) -> DataFrame:
    return mcq.extract_items(raw_mcq(s, d))


_NAMED = ("boolq", "copa", "hellaswag", "sentineg", "wic")


def raw_named(s: SparkSession, d: str) -> DataFrame:
    """Benchmark items as records of the five named subsets; every seventh has no id."""
    items = clean_items(s, d)
    c = lambda i: F.get("choices", F.lit(i))
    kind = F.pmod(F.length("id"), F.lit(5))
    own = F.when(F.pmod(F.length("id"), F.lit(7)) != 0, F.col("id")).alias("id")
    shapes = [
        F.struct(own, F.col("question").alias("paragraph"), c(0).alias("question"), (F.col("answer") % 2).alias("label")),
        F.struct(own, F.col("question").alias("premise"), c(1).alias("question"), c(0).alias("alternative_1"), c(1).alias("alternative_2"), (F.col("answer") % 2).alias("label")),
        F.struct(own, F.col("question").alias("context"), *[c(i).alias(f"ending_{i + 1}") for i in range(4)], (F.col("answer") % 4).alias("label")),
        F.struct(own, F.col("question").alias("sentence"), (F.col("answer") % 2).alias("label")),
        F.struct(own, c(0).alias("word"), F.col("question").alias("context_1"), c(1).alias("context_2"), (F.col("answer") % 2).alias("label")),
    ]
    record, subset = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, shape in enumerate(shapes):
        record, subset = F.when(kind == k, F.to_json(shape)).otherwise(record), F.when(kind == k, F.lit(_NAMED[k])).otherwise(subset)
    return items.select(F.lit("kobest").alias("task"), subset.alias("subset"), (F.length("id") * 1000 + F.coalesce("answer", F.lit(0))).alias("idx"), "source", record.alias("record"))


@query(
    "WITH m AS (SELECT *, length(id) % 5 AS kind, coalesce(question, '') AS q, coalesce(choices[1], '') AS c1, coalesce(choices[2], '') AS c2 FROM mcq_items WHERE (noise_type IS NULL OR noise_type = 'clean') AND answer IS NOT NULL), "
    "n AS (SELECT *, ['boolq', 'copa', 'hellaswag', 'sentineg', 'wic'][kind + 1] AS sub, CASE kind WHEN 0 THEN '지문: ' || q || '질문: ' || c1 WHEN 1 THEN '전제: ' || q || '질문 유형: ' || c2 WHEN 2 THEN '문맥: ' || q || '다음에 이어질 가장 자연스러운 문장은?' "
    "WHEN 3 THEN '문장: ' || q || '이 문장의 감성은?' ELSE '단어: ' || c1 || '문맥 1: ' || q || '문맥 2: ' || c2 || '두 문맥에서 단어 의미가 같은가?' END AS t FROM m) "
    f"SELECT CASE WHEN length(id) % 7 <> 0 THEN id ELSE sub || '-' || (length(id) * 1000 + answer) END AS id, 'kobest' AS task, sub AS subset, {o.strip_sql('t')} AS question, "
    "CASE kind WHEN 0 THEN ['아니오', '예'] WHEN 1 THEN [c1, c2] WHEN 2 THEN [c1, c2, coalesce(choices[3], ''), coalesce(choices[4], '')] WHEN 3 THEN ['부정', '긍정'] ELSE ['다르다', '같다'] END AS choices, "
    "(answer % CASE WHEN kind = 2 THEN 4 ELSE 2 END)::INT AS answer, source FROM n"
)
def mcq_extract_named(s: SparkSession, d: str) -> DataFrame:
    return mcq.extract_items(raw_named(s, d))


def raw_chain(s: SparkSession, d: str) -> DataFrame:
    """Raw records of one task beside a task whose records are items already, with their positions."""
    from pyspark.sql import Window

    items = clean_items(s, d).select("id", "subset", "question", "choices", "answer", "source").where("answer IS NOT NULL AND length(question) > 0 AND size(choices) >= 2")
    rows = items.withColumn("idx", F.row_number().over(Window.orderBy(F.desc("id"))))
    ready = F.to_json(F.struct("id", F.lit("ready").alias("task"), "subset", "question", "choices", "answer", "source"))
    raw = F.to_json(F.struct("id", F.col("question").alias("query"), F.col("choices").alias("options"), F.col("answer").alias("gold")))
    out = rows.select(F.lit("raw").alias("task"), "subset", "idx", "source", raw.alias("record"))
    return out.unionByName(rows.select(F.lit("ready").alias("task"), F.lit("none").alias("subset"), "idx", F.lit("none").alias("source"), ready.alias("record")))


def _chain_sql() -> str:
    base = "it AS (SELECT *, row_number() OVER (ORDER BY id DESC) AS idx FROM mcq_items WHERE (noise_type IS NULL OR noise_type = 'clean') AND answer IS NOT NULL AND length(question) > 0 AND len(choices) >= 2)"
    both = f"ex AS (SELECT id, 'raw' AS task, subset, {o.strip_sql('question')} AS question, list_transform(choices, lambda c: {o.strip_sql('c')}) AS choices, answer, source, idx FROM it WHERE {o.strip_sql('question')} <> '' UNION ALL SELECT id, 'ready', subset, question, choices, answer, source, idx FROM it)"
    first = "fi AS (SELECT * FROM ex QUALIFY row_number() OVER (PARTITION BY task, question, choices, answer ORDER BY idx) = 1)"
    most = "src AS MATERIALIZED (SELECT id, task, subset, question AS t, row_number() OVER () AS k FROM (SELECT * FROM fi QUALIFY row_number() OVER (PARTITION BY task ORDER BY idx) <= 2000))"
    kinds = noise.BENCH_NOISES[1:]
    parts = "SELECT id, task, subset, 'clean' AS noise_type, t AS question FROM src " + " ".join(f"UNION ALL SELECT id, task, subset, '{k}', t FROM r_{k}" for k in kinds)
    return o.with_([base, both, first, most, *[c for k in kinds for c in o.bench_noise(f"r_{k}", "src", k, _bench_base(k, "question"))]], parts)


@query(_chain_sql())
def benchmark_chain(s: SparkSession, d: str) -> DataFrame:
    """From raw records to variants, with the limits of production."""
    return mcq.benchmark_chain(raw_chain(s, d)).select("id", "task", "subset", "noise_type", "question")


_ANSWERS = "(VALUES ('0'), ('1'), ('2'), ('4'), ('5'), ('9'), ('A'), ('b'), ('E'), ('x'), (' 3 '), ('')) v(a)"


@query(
    f"WITH i AS (SELECT id, choices, len(choices) AS n, list_transform(choices, lambda c: {o.strip_sql('c')}) AS cc FROM mcq_items WHERE noise_type IS NULL OR noise_type = 'clean'), "
    f"x AS (SELECT i.*, a, {o.strip_sql('a')} AS s FROM i, {_ANSWERS} UNION ALL SELECT i.*, choices[2], {o.strip_sql('choices[2]')} FROM i) "
    "SELECT id, a AS given, (CASE WHEN regexp_matches(s, '^[0-9]+$') AND s::BIGINT < n THEN s::INT WHEN regexp_matches(s, '^[0-9]+$') AND s::BIGINT BETWEEN 1 AND n THEN s::INT - 1 "
    "WHEN length(s) = 1 AND instr('ABCDEabcde', s) > 0 AND (instr('ABCDEabcde', s) - 1) % 5 < n THEN (instr('ABCDEabcde', s) - 1) % 5 "
    "WHEN list_position(cc, s) > 0 THEN list_position(cc, s) - 1 END)::INT AS answer FROM x"
)
def mcq_answer_resolve(s: SparkSession, d: str) -> DataFrame:
    forms = ["0", "1", "2", "4", "5", "9", "A", "b", "E", "x", " 3 ", ""]
    given = F.concat(F.array(*map(F.lit, forms)), F.array(F.get("choices", F.lit(1))))
    rows = clean_items(s, d).select("id", "choices", F.explode(given).alias("given"))
    return rows.select("id", "given", mcq.resolve_answer(F.col("given"), F.col("choices")).alias("answer"))


@query("SELECT min(id) AS id, question, choices, answer FROM mcq_items WHERE noise_type IS NULL OR noise_type = 'clean' GROUP BY question, choices, answer")
def mcq_dedup(s: SparkSession, d: str) -> DataFrame:
    return mcq.first_of_duplicates(clean_items(s, d).select("id", "question", "choices", "answer"))


@query(
    f"SELECT id, noise_type, '질문: ' || {o.strip_sql('question')} || chr(10) || '선택지:' || chr(10) || array_to_string(list_transform(choices, lambda c, i: chr((64 + i)::INT) || '. ' || c), chr(10)) || chr(10) || '정답:' AS prompt FROM mcq_items"
)
def mcq_prompt(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "mcq_items").select("id", "noise_type", mcq.prompt_prefix(F.col("question"), F.col("choices")).alias("prompt"))


_RIGHT = "coalesce(gold = pred, false)::INT"


@query(f"SELECT subset, count(*) AS n, sum({_RIGHT})::BIGINT AS n_right, avg({_RIGHT}) AS accuracy FROM mcq_results GROUP BY ROLLUP (subset)")
def mcq_accuracy(s: SparkSession, d: str) -> DataFrame:
    return metrics.accuracy(table(s, d, "mcq_results"), "gold", "pred", "subset")


@query("SELECT result_id, list_position(scores, list_max(scores))::INT - 1 AS best FROM mcq_results")
def mcq_best_choice(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "mcq_results").select("result_id", mcq.best_choice(F.col("scores")).alias("best"))


@query("SELECT result_id, id, subset, noise_type, gold, pred FROM mcq_results ORDER BY result_id LIMIT 50")
def head_examples(s: SparkSession, d: str) -> DataFrame:
    """The first 50 examples of a report."""
    return mcq.limited(table(s, d, "mcq_results").select("result_id", "id", "subset", "noise_type", "gold", "pred"), "result_id", 50)


# --- tokens and vocabularies --------------------------------------------------------------------------------------

_WORDS = "SELECT DISTINCT unnest(regexp_split_to_array(output, '[ \\t\\r\\n]+')) AS token FROM instructions WHERE output IS NOT NULL"


def _pattern_sql(kind: str, src: str, longest: int | None, none: str | None = None) -> list[str]:
    part = {"CHO": f"substr('{hangul.INITIALS}', ini::INT + 1, 1)", "JUNG": f"substr('{hangul.VOWELS}', vow::INT + 1, 1)", "JONG": f"CASE WHEN fin = 0 THEN '_' ELSE substr('{''.join(hangul.FINALS)}', fin::INT, 1) END"}[kind]
    limit = f"HAVING count(*) <= {longest}" if longest else ""
    return [
        f"e_{kind} AS (SELECT token, unnest(string_split(token, '')) AS c, generate_subscripts(string_split(token, ''), 1) AS i FROM {src})", f"f_{kind} AS (SELECT *, {o.PARTS} FROM e_{kind} WHERE {o.SYL})",
        f"p_{kind} AS (SELECT token, '<{kind}:' || string_agg({part}, '' ORDER BY i) || '>' AS label FROM f_{kind} GROUP BY token {limit})",
    ]


def _patterns_sql(source: str, longest: int) -> list[str]:
    return [f"w AS ({source})", *[c for k in hangul.KINDS for c in _pattern_sql(k, "w", longest)]]


def _labels(longest: int, source: str = _WORDS) -> tuple[list[str], str]:
    return _patterns_sql(source, longest), " UNION ALL ".join(f"SELECT token, '{k}' AS kind, label FROM p_{k}" for k in hangul.KINDS)


@query(o.with_(_labels(16)[0], _labels(16)[1]))
def jamo_patterns_16(s: SparkSession, d: str) -> DataFrame:
    return tokens.patterns(tokens.distinct_tokens(records(s, d), "output"), 16)


@query(o.with_(_labels(8)[0], _labels(8)[1]))
def jamo_patterns_8(s: SparkSession, d: str) -> DataFrame:
    return tokens.patterns(tokens.distinct_tokens(records(s, d), "output"), 8)


_BASE_WORDS = "SELECT word AS token FROM common_words"


def _vocabs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    base = tokens.vocabulary(table(s, d, "common_words").select(F.col("word").alias("token")))
    return base, tokens.vocabulary(tokens.distinct_tokens(records(s, d), "output"))


@query(o.with_(_patterns_sql(_BASE_WORDS, 16), f"SELECT DISTINCT label FROM ({_labels(16)[1]})"))
def vocab_base(s: SparkSession, d: str) -> DataFrame:
    return _vocabs(s, d)[0]


@query(o.with_(_patterns_sql(f"{_WORDS} UNION SELECT word FROM common_words", 16), f"SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS id FROM (SELECT DISTINCT label FROM ({_labels(16)[1]}))"))
def vocab_union_ids(s: SparkSession, d: str) -> DataFrame:
    a, b = _vocabs(s, d)
    return tokens.label_ids(a.unionByName(b).distinct())


@query()
def vocab_difference(s: SparkSession, d: str) -> DataFrame:
    a, b = _vocabs(s, d)
    return tokens.difference(b, a)


def _renamed(ctes: list[str], mark: str) -> tuple[list[str], str]:
    """The same CTEs under other names."""
    out = []
    for c in ctes:
        for k in hangul.KINDS:
            for x in "efp":
                c = c.replace(f"{x}_{k}", f"{mark}{x}_{k}")
        out.append(c.replace("w AS (", f"{mark}w AS (", 1).replace("FROM w)", f"FROM {mark}w)"))
    return out, " UNION ALL ".join(f"SELECT token, '{k}' AS kind, label FROM {mark}p_{k}" for k in hangul.KINDS)


_BASE_CTES, _BASE_LABELS = _renamed(_patterns_sql(_BASE_WORDS, 16), "b")
SQL["vocab_difference"] = o.with_([*_patterns_sql(_WORDS, 16), *_BASE_CTES], f"SELECT DISTINCT label FROM ({_labels(16)[1]}) WHERE label NOT IN (SELECT label FROM ({_BASE_LABELS}))")

_TYPO_WORDS = "SELECT unnest(regexp_split_to_array(correct_sentence, '[ \\t\\r\\n]+')) AS token FROM typo_pairs WHERE correct_sentence IS NOT NULL"


@query(
    o.with_(
        [f"occ AS (SELECT token, count(*) AS n FROM ({_TYPO_WORDS}) GROUP BY 1)", *_patterns_sql("SELECT token FROM occ", 16), *_renamed(_patterns_sql(_WORDS, 16), "v")[0]],
        f"SELECT kind, sum(n)::BIGINT AS n_occurrences, sum(CASE WHEN label IN (SELECT label FROM ({_renamed(_patterns_sql(_WORDS, 16), 'v')[1]})) THEN n ELSE 0 END)::BIGINT AS n_hits, "
        f"round(n_hits / n_occurrences, 9) AS coverage FROM occ JOIN ({_labels(16)[1]}) USING (token) GROUP BY kind",
    )
)
def vocab_coverage(s: SparkSession, d: str) -> DataFrame:
    """How much of the typo corpus the vocabulary of the outputs covers."""
    held_out = tokens.distinct_tokens(table(s, d, "typo_pairs"), "correct_sentence")
    return tokens.coverage(held_out, _vocabs(s, d)[1])


def _jamo_label_sql(flavour: str) -> str:
    miss = lambda k: f"coalesce(p_{k}.label, '<{k}:_>')" if flavour == "sft" else f"p_{k}.label"
    vctes, vlabels = _renamed(_patterns_sql(_WORDS, 16), "v")
    ctes = [f"w AS (SELECT DISTINCT token FROM ({_TYPO_WORDS}) WHERE token <> '')", *[c for k in hangul.KINDS for c in _pattern_sql(k, "w", None)], *vctes]
    ctes.append(f"ids AS (SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS id FROM (SELECT DISTINCT label FROM ({vlabels})))")
    joins = " ".join(f"LEFT JOIN p_{k} ON p_{k}.token = w.token LEFT JOIN ids i_{k} ON i_{k}.label = {miss(k)}" for k in hangul.KINDS)
    return o.with_(ctes, "SELECT w.token, " + ", ".join(f"coalesce(i_{k}.id, -100) AS {k.lower()}" for k in hangul.KINDS) + f" FROM w {joins}")


@query(_jamo_label_sql("cpt"))
def jamo_labels_cpt(s: SparkSession, d: str) -> DataFrame:
    ids = tokens.label_ids(_vocabs(s, d)[1])
    return tokens.jamo_labels(tokens.distinct_tokens(table(s, d, "typo_pairs"), "correct_sentence"), ids, "cpt")


@query(_jamo_label_sql("sft"))
def jamo_labels_sft(s: SparkSession, d: str) -> DataFrame:
    ids = tokens.label_ids(_vocabs(s, d)[1])
    return tokens.jamo_labels(tokens.distinct_tokens(table(s, d, "typo_pairs"), "correct_sentence"), ids, "sft")


# --- packing and examples -----------------------------------------------------------------------------------------


@query(
    "WITH l AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\r\\n]+'), lambda x: x <> '') AS ts FROM documents), "
    "o AS (SELECT doc_id, ts, sum(len(ts) + 1) OVER (ORDER BY doc_id) - len(ts) - 1 AS off FROM l WHERE len(ts) > 0), "
    "p AS (SELECT off + unnest(range(len(ts) + 1)) AS g, unnest(list_append(ts, '</s>')) AS token FROM o), "
    "b AS (SELECT (g // 2048)::BIGINT AS block, count(*) AS n, md5(string_agg(token, ' ' ORDER BY g)) AS digest FROM p GROUP BY 1) SELECT block, n, digest FROM b WHERE n >= 16"
)
def pack_blocks(s: SparkSession, d: str) -> DataFrame:
    blocks = pack.pack_blocks(table(s, d, "documents"), "doc_id", tokens.word_tokens(F.col("text")), "</s>")
    return blocks.select("block", F.size("tokens").cast("bigint").alias("n"), F.md5(F.array_join("tokens", " ")).alias("digest"))


_NI, _NN, _NO = o.lines_sql("instruction"), o.lines_sql("input"), o.lines_sql("output")


def _sft_sql(source: str, key: str, max_length: int, a: str, b: str) -> list[str]:
    """CTEs up to `x`: one row per key with its ids, prompt length and reason to skip."""
    na, nb = o.lines_sql(a), o.lines_sql(b)
    nl = "chr(10)"
    return [
        f"n AS (SELECT {key} AS k, {na} AS a, {nb} AS b, {_NO} AS c FROM {source})",
        f"q AS (SELECT k, a = '' AND b = '' OR c = '' AS empty, '<|system|>' || {nl} || {o.literal(text.SYSTEM_PROMPT)} || {nl} || '<|user|>' || {nl} || CASE WHEN b <> '' THEN a || {nl} || {nl} || b ELSE a END || {nl} || '<|assistant|>' || {nl} AS p, c FROM n)",
        f"x AS (SELECT k, empty, length(p) AS plen, substr(p || c || '</s>', 1, {max_length}) AS t, "
        f"CASE WHEN empty THEN 'empty' WHEN length(p) >= {max_length} THEN 'long_prompt' END AS skip_reason FROM q)",
    ]


@query(
    o.with_(
        _sft_sql("instructions", "rec_id", 1024, "instruction", "input"),
        "SELECT k AS rec_id, skip_reason, CASE WHEN skip_reason IS NULL THEN list_transform(string_split(t, ''), lambda c: unicode(c)::INT) END AS input_ids, "
        "CASE WHEN skip_reason IS NULL THEN list_transform(string_split(t, ''), lambda c, i: CASE WHEN i <= plen THEN -100 ELSE unicode(c)::INT END) END AS labels FROM x",
    )
)
def sft_items(s: SparkSession, d: str) -> DataFrame:
    return pack.sft_examples(records(s, d), eos="</s>", max_length=1024).select("rec_id", "skip_reason", "input_ids", "labels")


@query(o.with_(_sft_sql("instructions", "rec_id", 1024, "instruction", "input"), "SELECT coalesce(skip_reason, 'kept') AS reason, count(*) AS n FROM x GROUP BY 1"))
def sft_skip_reasons(s: SparkSession, d: str) -> DataFrame:
    return pack.skip_counts(pack.sft_examples(records(s, d), eos="</s>", max_length=1024))


@query(
    o.with_(
        [
            *_sft_sql("noisy_pairs", "pair_id", 1024, "coalesce(clean_instruction, instruction)", "coalesce(clean_input, input)"),
            *[c.replace("n AS (", "n2 AS (", 1).replace("q AS (", "q2 AS (", 1).replace("x AS (", "x2 AS (", 1).replace("FROM n)", "FROM n2)").replace("FROM q)", "FROM q2)") for c in _sft_sql("noisy_pairs", "pair_id", 1024, "noisy_instruction", "noisy_input")],
        ],
        "SELECT x.k AS pair_id, coalesce(noise_type, 'unknown') AS noise_type, CASE WHEN x.skip_reason = 'empty' THEN 'empty' WHEN x2.skip_reason = 'empty' THEN 'missing_pair' "
        "WHEN x.skip_reason IS NOT NULL OR x2.skip_reason IS NOT NULL THEN 'encoding' END AS skip_reason, CASE WHEN x.skip_reason IS NULL THEN length(x.t) END AS clean_n, CASE WHEN x2.skip_reason IS NULL THEN length(x2.t) END AS noisy_n "
        "FROM x JOIN x2 ON x.k = x2.k JOIN noisy_pairs p ON p.pair_id = x.k",
    )
)
def paired_sft(s: SparkSession, d: str) -> DataFrame:
    rows = pack.paired_examples(spread(table(s, d, "noisy_pairs")), eos="</s>", max_length=1024)
    return rows.select("pair_id", "noise_type", "skip_reason", F.when(F.col("clean_input_ids").isNotNull(), F.size("clean_input_ids").cast("bigint")).alias("clean_n"), F.when(F.col("noisy_input_ids").isNotNull(), F.size("noisy_input_ids").cast("bigint")).alias("noisy_n"))


@query(
    o.with_(
        _sft_sql("instructions", "rec_id", 1024, "instruction", "input"),
        "SELECT k AS rec_id, CASE WHEN skip_reason IS NULL THEN length(t) - greatest(plen, 1) END AS n_supervised FROM x WHERE skip_reason IS NULL",
    )
)
def supervised_tokens(s: SparkSession, d: str) -> DataFrame:
    rows = pack.sft_examples(records(s, d), eos="</s>", max_length=1024).where("skip_reason IS NULL")
    return rows.select("rec_id", metrics.supervised_tokens(F.col("labels")).alias("n_supervised"))


@query(
    o.with_(
        _sft_sql("noisy_pairs", "pair_id", 1024, "noisy_instruction", "noisy_input"),
        "SELECT pair_id, pos, input_id, label FROM (SELECT k AS pair_id, unnest(range(20)) AS pos, t, plen FROM x WHERE skip_reason IS NULL), "
        "LATERAL (SELECT unicode(substr(t, pos::INT + 1, 1)) AS input_id, CASE WHEN pos < plen THEN -100 ELSE unicode(substr(t, pos::INT + 1, 1)) END AS label) WHERE pos < length(t)",
    )
)
def alignment_rows(s: SparkSession, d: str) -> DataFrame:
    """The first 20 positions of every noisy example, for inspection."""
    noisy = spread(table(s, d, "noisy_pairs"))
    rows = pack.sft_examples(noisy, "pair_id", eos="</s>", max_length=1024, fields=("noisy_instruction", "noisy_input", "output")).where("skip_reason IS NULL")
    out = pack.aligned_tokens(rows, "pair_id", 20, input_id=F.col("input_ids"), label=F.col("labels"))
    return out.select("pair_id", F.col("pos").cast("bigint").alias("pos"), "input_id", "label")


def _char_labels(s: SparkSession, d: str, ids: DataFrame) -> DataFrame:
    """(token_id, cho, jung, jong) of the distinct ids, under the vocabulary of the outputs' characters."""
    texts = tokens.token_texts(ids, tokens.code_point_texts)
    vocab = tokens.vocabulary(tokens.distinct_tokens(records(s, d), "output", tokens.character_tokens))
    return tokens.jamo_labels(texts, tokens.label_ids(vocab), "cpt").join(texts, "token").select("token_id", "cho", "jung", "jong")


def _char_label_sql() -> list[str]:
    ctes = ["oc AS (SELECT DISTINCT unnest(string_split(output, '')) AS c FROM instructions)", f"os AS (SELECT {o.PARTS} FROM oc WHERE {o.SYL})"]
    part = {"CHO": f"'<CHO:' || substr('{hangul.INITIALS}', ini::INT + 1, 1) || '>'", "JUNG": f"'<JUNG:' || substr('{hangul.VOWELS}', vow::INT + 1, 1) || '>'", "JONG": f"'<JONG:' || CASE WHEN fin = 0 THEN '_' ELSE substr('{''.join(hangul.FINALS)}', fin::INT, 1) END || '>'"}
    union = " UNION ".join(f"SELECT {x} AS label FROM os" for x in part.values())
    ctes.append(f"ids AS (SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS id FROM ({union}))")
    look = ", ".join(f"coalesce((SELECT id FROM ids WHERE label = {x}), -100) AS {k.lower()}" for k, x in part.items())
    return [*ctes, f"syl AS (SELECT DISTINCT unicode(c) AS code, {o.PARTS} FROM ch WHERE {o.SYL})", f"lab AS (SELECT code, {look} FROM syl)"]


@query(
    o.with_(
        [
            *_sft_sql("instructions", "rec_id", 1024, "instruction", "input"), "ch AS (SELECT k, plen, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) - 1 AS i FROM x WHERE skip_reason IS NULL)", *_char_label_sql(),
            "z AS (SELECT k, i, " + ", ".join(f"CASE WHEN i < plen THEN -100 ELSE coalesce({c}, -100) END AS {c}" for c in ("cho", "jung", "jong")) + " FROM ch LEFT JOIN lab ON code = unicode(c))",
        ],
        "SELECT k AS rec_id, " + ", ".join(f"md5(string_agg({c}::VARCHAR, ',' ORDER BY i)) AS {c}_md5" for c in ("cho", "jung", "jong")) + ", count(*) AS n FROM z GROUP BY k",
    )
)
def sft_jamo_labels(s: SparkSession, d: str) -> DataFrame:
    """Examples with the labels of the initial, vowel and final of each answer token."""
    rows = pack.sft_examples(records(s, d), eos="</s>").where("skip_reason IS NULL")
    labels = _char_labels(s, d, rows.select(F.explode("input_ids").alias("token_id")))
    out = pack.with_jamo_labels(rows, labels, "rec_id")
    return out.select("rec_id", *[F.md5(F.array_join(f"{c}_labels", ",")).alias(f"{c}_md5") for c in ("cho", "jung", "jong")], F.size("cho_labels").cast("bigint").alias("n"))


@query(
    o.with_(
        [
            *_sft_sql("noisy_pairs", "pair_id", 1024, "coalesce(clean_instruction, instruction)", "coalesce(clean_input, input)"),
            *[c.replace("n AS (", "n2 AS (", 1).replace("q AS (", "q2 AS (", 1).replace("x AS (", "x2 AS (", 1).replace("FROM n)", "FROM n2)").replace("FROM q)", "FROM q2)") for c in _sft_sql("noisy_pairs", "pair_id", 1024, "noisy_instruction", "noisy_input")],
            "b AS (SELECT x.k, length(x.t) AS cn, length(x2.t) AS nn, ((row_number() OVER (ORDER BY x.k) - 1) // 16)::BIGINT AS batch FROM x JOIN x2 ON x.k = x2.k WHERE x.skip_reason IS NULL AND x2.skip_reason IS NULL)",
        ],
        "SELECT k AS pair_id, batch, (ceil(max(cn) OVER (PARTITION BY batch) / 8) * 8)::BIGINT AS clean_width, (ceil(max(nn) OVER (PARTITION BY batch) / 8) * 8)::BIGINT AS noisy_width FROM b",
    )
)
def paired_collate(s: SparkSession, d: str) -> DataFrame:
    """Batches of pairs in which the clean and the noisy side have widths of their own."""
    from pyspark.sql import Window

    rows = pack.paired_examples(spread(table(s, d, "noisy_pairs")), eos="</s>").where("skip_reason IS NULL")
    numbered = rows.select("pair_id").withColumn("pos", F.row_number().over(Window.orderBy("pair_id")).cast("bigint"))
    out = pack.collate_pairs(rows.join(numbered, "pair_id"), "pos", 0, 16)
    ids = numbered.select("pos", "pair_id")
    return out.join(ids, "pos").select("pair_id", "batch", F.size("clean_input_ids").cast("bigint").alias("clean_width"), F.size("noisy_labels").cast("bigint").alias("noisy_width"))


def _collate_sql(multiple: int) -> str:
    width = f"ceil(max(len(ids)) OVER (PARTITION BY batch) / {multiple})::INT * {multiple}"
    return (
        "WITH t AS (SELECT result_id, list_transform(string_split(coalesce(id, ''), ''), lambda c: unicode(c)::INT) AS ids FROM mcq_results WHERE coalesce(id, '') <> ''), "
        f"b AS (SELECT *, ((row_number() OVER (ORDER BY result_id) - 1) // 16)::BIGINT AS batch FROM t), w AS (SELECT *, {width} AS w FROM b) "
        "SELECT batch, result_id, list_concat(ids, list_transform(range(w - len(ids)), lambda x: 0::INT)) AS ids, list_concat(ids, list_transform(range(w - len(ids)), lambda x: (-100)::INT)) AS labels FROM w"
    )


def _collated(s: SparkSession, d: str, multiple: int) -> DataFrame:
    rows = table(s, d, "mcq_results").where("coalesce(id, '') <> ''").select("result_id", tokens.token_ids(tokens.character_tokens(F.col("id"))).alias("ids"))
    return pack.collate(rows.withColumn("labels", F.col("ids")), "result_id", {"ids": 0, "labels": -100}, 16, multiple)


@query(_collate_sql(8))
def collate_multiple8(s: SparkSession, d: str) -> DataFrame:
    return _collated(s, d, 8)


@query(_collate_sql(1))
def collate_plain(s: SparkSession, d: str) -> DataFrame:
    return _collated(s, d, 1)


# --- measures -----------------------------------------------------------------------------------------------------

_COUNTS = "u AS (SELECT c AS token, count(*) AS n FROM (SELECT unnest(string_split(correct_sentence, '')) AS c FROM typo_pairs) WHERE c <> '' GROUP BY 1), tot AS (SELECT sum(n) AS total, count(*) AS kinds FROM u)"


def _score_sql(col: str, name: str) -> str:
    return (
        f"{name}c AS (SELECT rn, unnest(string_split({col}, '')) AS token FROM d), "
        f"{name} AS (SELECT rn, count(*) AS n, sum(ln((coalesce(u.n, 0) + 1) / (total + kinds + 1))) AS s FROM {name}c LEFT JOIN u USING (token), tot WHERE token <> '' GROUP BY rn HAVING count(*) >= 2)"
    )


_SCORED = f"d AS (SELECT *, row_number() OVER (ORDER BY id, error_sentence, correct_sentence, dataset, error_type) AS rn FROM typo_pairs WHERE coalesce(error_sentence, '') <> '' AND coalesce(correct_sentence, '') <> ''), {_COUNTS}, {_score_sql('error_sentence', 'se')}, {_score_sql('correct_sentence', 'sc')}"


def scored_pairs(s: SparkSession, d: str) -> DataFrame:
    """Typo pairs with the unigram scores of both sentences; repeated rows stay rows of their own."""
    pairs = table(s, d, "typo_pairs")
    usable = pairs.where("coalesce(error_sentence, '') <> '' AND coalesce(correct_sentence, '') <> ''")
    counts = scoring.unigram_counts(pairs, "correct_sentence")
    texts = usable.select("error_sentence").union(usable.select("correct_sentence")).toDF("t").distinct()
    score = scoring.unigram_scores(texts, "t", "t", counts).select("t", "avg_logprob", "n_tokens", "sum_logprob")
    a = score.toDF("error_sentence", "error_logprob", "error_tokens", "error_sum")
    b = score.toDF("correct_sentence", "correct_logprob", "correct_tokens", "correct_sum")
    return usable.join(a, "error_sentence").join(b, "correct_sentence")


@query(
    f"WITH {_SCORED}, r AS (SELECT dataset, error_type, round(sc.s / sc.n, 9) AS lc, round(se.s / se.n, 9) AS le, lc - le AS delta, exp(-le) AS pe, exp(-lc) AS pc FROM d JOIN se USING (rn) JOIN sc USING (rn)) "
    "SELECT (grouping(dataset) * 2 + grouping(error_type))::BIGINT AS grain, dataset, error_type, count(*) AS n, round(avg((delta > 0)::INT), 6) AS preference_accuracy, round(avg(delta), 6) AS mean_delta, "
    "round(avg(pe), 4) AS mean_ppl_error, round(avg(pc), 4) AS mean_ppl_correct FROM r GROUP BY GROUPING SETS ((), (dataset), (error_type))"
)
def pair_preference_grouping_sets(s: SparkSession, d: str) -> DataFrame:
    rows = scored_pairs(s, d).where("error_tokens >= 2 AND correct_tokens >= 2")
    rows = rows.withColumns({c: F.round(c, 9) for c in ("error_logprob", "correct_logprob")})  # sums in any order
    out = metrics.pair_preference(rows, "error_logprob", "correct_logprob", "dataset", "error_type")
    return out.select("grain", "dataset", "error_type", "n", *[F.round(c, r).alias(c) for c, r in (("preference_accuracy", 6), ("mean_delta", 6), ("mean_ppl_error", 4), ("mean_ppl_correct", 4))])


@query(f"WITH {_SCORED} SELECT dataset, sum(sc.n)::BIGINT AS n_tokens, round(-sum(sc.s) / sum(sc.n), 6) AS loss, round(exp(-sum(sc.s) / sum(sc.n)), 4) AS ppl FROM d JOIN sc USING (rn) GROUP BY 1")
def ppl(s: SparkSession, d: str) -> DataFrame:
    rows = scored_pairs(s, d).where("correct_tokens >= 2").withColumn("loss", -F.col("correct_sum"))
    out = metrics.perplexity(rows, "loss", "correct_tokens", "dataset")
    return out.select("dataset", "n_tokens", F.round("loss", 6).alias("loss"), F.round("ppl", 4).alias("ppl"))


@query(f"WITH {_SCORED}, l AS (SELECT dataset, -sum(sc.s) / sum(sc.n) AS loss FROM d JOIN sc USING (rn) GROUP BY 1) SELECT dataset, round(exp(loss), 4) AS ppl, round(loss + 0.5 * loss * 2, 6) AS weighted FROM l")
def loss_measures(s: SparkSession, d: str) -> DataFrame:
    """Perplexity of a mean loss, and that loss with an auxiliary one; absent auxiliary losses count nothing."""
    rows = scored_pairs(s, d).where("correct_tokens >= 2").withColumn("loss", -F.col("correct_sum"))
    out = metrics.perplexity(rows, "loss", "correct_tokens", "dataset").withColumns({"aux": F.col("loss") * 2, "absent": F.lit(None).cast("double")})
    return out.select("dataset", F.round(metrics.perplexity_of_loss(F.col("loss")), 4).alias("ppl"), F.round(metrics.weighted_loss(F.col("loss"), {"aux": 0.5, "absent": 3.0}), 6).alias("weighted"))


@query(
    "WITH l AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\r\\n]+'), lambda x: x <> '') AS ts FROM documents), "
    "o AS (SELECT doc_id, ts, sum(len(ts) + 1) OVER (ORDER BY doc_id) - len(ts) - 1 AS off FROM l WHERE len(ts) > 0), "
    "p AS (SELECT off + unnest(range(len(ts) + 1)) AS g, unnest(list_append(ts, '</s>')) AS token FROM o), "
    "b AS (SELECT g // 2048 AS block, g % 2048 AS pos, token, count(*) OVER (PARTITION BY g // 2048) AS n FROM p), k AS (SELECT * FROM b WHERE n >= 16), "
    "u AS (SELECT token, count(*) AS m FROM (SELECT unnest(ts) AS token FROM l) GROUP BY 1), tot AS (SELECT sum(m) AS total, count(*) AS kinds FROM u), "
    "s AS (SELECT -ln((coalesce(m, 0) + 1) / (total + kinds + 1)) AS loss FROM k LEFT JOIN u USING (token), tot WHERE pos > 0) "
    "SELECT (SELECT count(DISTINCT block) FROM k) AS n_blocks, count(*) AS n_tokens, round(sum(loss) / count(*), 6) AS loss, round(exp(sum(loss) / count(*)), 2) AS ppl FROM s"
)
def ppl_blocks(s: SparkSession, d: str) -> DataFrame:
    """Perplexity over packed blocks."""
    docs = spread(table(s, d, "documents"))
    blocks = pack.pack_blocks(docs, "doc_id", tokens.word_tokens(F.col("text")), "</s>")
    losses = scoring.block_losses(blocks, scoring.unigram_counts(docs, "text", tokens.word_tokens))
    whole = losses.agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("n_tokens").alias("n"), F.sum("loss").alias("s"))
    out = metrics.perplexity(whole, "s", "n", "n_blocks")
    return out.select("n_blocks", "n_tokens", F.round("loss", 6).alias("loss"), F.round("ppl", 2).alias("ppl"))


_PAIRED = (
    "r AS (SELECT id, subset, coalesce(noise_type, 'clean') AS noise, max(coalesce(gold = pred, false)::INT) AS ok FROM mcq_results GROUP BY ALL), "
    "j AS (SELECT n.subset, n.noise, c.ok AS base, n.ok AS other FROM r n JOIN r c ON c.id = n.id AND c.subset = n.subset AND c.noise = 'clean' WHERE n.noise <> 'clean'), "
    "g AS (SELECT subset, noise, count(*) AS n, count(*) FILTER (WHERE other = 1 AND base = 0) AS other_only, count(*) FILTER (WHERE base = 1 AND other = 0) AS base_only, avg(base) AS base_acc, avg(other) AS other_acc FROM j GROUP BY ALL)"
)
_TERMS = (
    "t AS (SELECT subset, noise, other_only + base_only AS m, least(other_only, base_only) AS k, unnest(range(0, least(other_only, base_only) + 1)) AS i FROM g), "
    "l AS (SELECT subset, noise, sum(exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) - m * ln(2))) AS s FROM t GROUP BY ALL), "
    "p AS (SELECT g.*, CASE WHEN other_only = base_only THEN 1.0 ELSE least(1.0, 2 * s) END AS p FROM g JOIN l USING (subset, noise))"
)


def paired_results(s: SparkSession, d: str) -> DataFrame:
    """Per item and noise: whether it is solved clean and with noise (best of repeated deliveries)."""
    right = F.coalesce(F.col("gold") == F.col("pred"), F.lit(False)).cast("int")
    r = table(s, d, "mcq_results").groupBy("id", "subset", F.coalesce("noise_type", F.lit("clean")).alias("noise")).agg(F.max(right).alias("ok"))
    clean = r.where("noise = 'clean'").select("id", "subset", (F.col("ok") == 1).alias("base"))
    return r.where("noise <> 'clean'").select("id", "subset", "noise", (F.col("ok") == 1).alias("other")).join(clean, ["id", "subset"])


@query(f"WITH {_PAIRED}, {_TERMS} SELECT subset, noise, n, other_only, base_only, round(other_acc - base_acc, 9) AS delta, round(p, 8) AS p FROM p")
def mcnemar(s: SparkSession, d: str) -> DataFrame:
    out = metrics.paired_comparison(paired_results(s, d), "base", "other", "subset", "noise")
    return out.select("subset", "noise", "n", "other_only", "base_only", F.round("delta", 9).alias("delta"), F.round("p", 8).alias("p"))


@query(
    f"WITH {_PAIRED}, {_TERMS}, k AS (SELECT *, count(*) OVER () AS mm, row_number() OVER (ORDER BY p) AS rk FROM p), v AS (SELECT *, p * mm / rk AS v FROM k) "
    "SELECT subset, noise, round(least(1.0, min(v) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 7) AS q, q < 0.05 AS significant FROM v"
)
def bh_fdr(s: SparkSession, d: str) -> DataFrame:
    out = metrics.false_discovery(metrics.paired_comparison(paired_results(s, d), "base", "other", "subset", "noise"))
    return out.select("subset", "noise", F.round("q", 7).alias("q"), "significant")


@query(
    f"WITH {_PAIRED} SELECT subset, " + ", ".join(f"max(base_acc) FILTER (WHERE noise = '{n}') AS {n}, max(other_acc) FILTER (WHERE noise = '{n}') AS {n}_norm, max(other_acc - base_acc) FILTER (WHERE noise = '{n}') AS {n}_norm_delta" for n in ("jamo", "mixed", "spacing")) + " FROM g GROUP BY subset"
)
def norm_summary_pivot(s: SparkSession, d: str) -> DataFrame:
    rows = metrics.paired_comparison(paired_results(s, d), "base", "other", "subset", "noise")
    return metrics.summary_table(rows, ["subset"], "noise", ["jamo", "mixed", "spacing"], "base_acc", "other_acc")


@query(
    "WITH e AS (SELECT CASE WHEN noise_type IS NULL OR noise_type = 'clean' THEN 'clean' ELSE 'noisy_' || noise_type END AS name, avg(1 - coalesce(gold = pred, false)::INT) AS value FROM mcq_results GROUP BY 1) "
    "SELECT name, round(value, 9) AS value, round(CASE WHEN name LIKE 'noisy%' AND (SELECT value FROM e WHERE name = 'clean') <> 0 THEN (value / (SELECT value FROM e WHERE name = 'clean') - 1) * 100 END, 6) AS degradation_pct FROM e"
)
def degradation(s: SparkSession, d: str) -> DataFrame:
    kind = F.col("noise_type")
    name = F.when(kind.isNull() | (kind == "clean"), "clean").otherwise(F.concat(F.lit("noisy_"), kind))
    wrong = 1 - F.coalesce(F.col("gold") == F.col("pred"), F.lit(False)).cast("int")
    rows = table(s, d, "mcq_results").groupBy(name.alias("name")).agg(F.avg(wrong).alias("value"))
    return metrics.degradation(rows, "name", "value").select("name", F.round("value", 9).alias("value"), F.round("degradation_pct", 6).alias("degradation_pct"))


@query(
    "WITH x AS (SELECT DISTINCT i.id, n.noise_type FROM mcq_items i, (SELECT DISTINCT noise_type FROM mcq_items WHERE noise_type IS NOT NULL) n) "
    "SELECT x.id, x.noise_type FROM x ANTI JOIN (SELECT DISTINCT id, noise_type FROM mcq_results) r ON r.id = x.id AND r.noise_type = x.noise_type"
)
def missing_results_anti(s: SparkSession, d: str) -> DataFrame:
    """Items and noise types that no run has scored. The grid is the items times the few noise types."""
    items = table(s, d, "mcq_items")
    kinds = items.where("noise_type IS NOT NULL").select("noise_type").distinct()
    grid = items.select("id").distinct().crossJoin(kinds)
    return metrics.missing_results(grid, table(s, d, "mcq_results").select("id", "noise_type").distinct(), "id", "noise_type")


@query(
    "SELECT source, count(*) AS n, count(*) FILTER (WHERE coalesce(output, '') = '') AS n_empty, sum(length(coalesce(instruction, '')) + length(coalesce(input, '')))::BIGINT AS prompt_chars, "
    "count(*) FILTER (WHERE length(coalesce(instruction, '')) + length(coalesce(input, '')) BETWEEN 4 AND 4096) AS n_in_range FROM instructions GROUP BY source"
)
def source_counts(s: SparkSession, d: str) -> DataFrame:
    chars = F.length(text.as_text(F.col("instruction"))) + F.length(text.as_text(F.col("input")))
    return records(s, d).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(text.as_text(F.col("output")) == "").alias("n_empty"), F.sum(chars).cast("bigint").alias("prompt_chars"), F.count_if(chars.between(4, 4096)).alias("n_in_range")
    )


# --- files --------------------------------------------------------------------------------------------------------


@query("SELECT rec_id, instruction, input, output, source FROM instructions")
def jsonl_files(s: SparkSession, d: str) -> DataFrame:
    """Records written as JSON lines and read again, every field of every record."""
    path = scratch(s, "jsonl")
    sinks.write_jsonl(records(s, d).select("rec_id", "instruction", "input", "output", "source"), path)
    rows = sources.jsonl(s, path)
    return rows.select(sources.field(F.col("record"), "rec_id", "bigint").alias("rec_id"), *[sources.field(F.col("record"), c).alias(c) for c in ("instruction", "input", "output", "source")])


@query("SELECT count(*) AS n, count(DISTINCT i) AS n_positions, min(i) AS first, max(i) AS last FROM (SELECT row_number() OVER (ORDER BY rec_id) - 1 AS i FROM instructions)")
def jsonl_positions(s: SparkSession, d: str) -> DataFrame:
    """Lines of one file are numbered from 0 without gaps, however it is split."""
    path = scratch(s, "lines")
    sinks.write_jsonl(table(s, d, "instructions").select("rec_id", "instruction").coalesce(1), path)
    idx = F.col("idx").cast("bigint")
    return sources.jsonl(s, path).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(idx).alias("n_positions"), F.min(idx).alias("first"), F.max(idx).alias("last"))


@query(
    "SELECT id, dataset, error_type, nullif(error_sentence, '') AS error_sentence, nullif(correct_sentence, '') AS correct_sentence FROM typo_pairs"
)
def csv_files(s: SparkSession, d: str) -> DataFrame:
    """A table written as CSV and read with encoding and separator told from its first bytes; empty texts come back null."""
    path, columns = scratch(s, "csv"), ["id", "dataset", "error_type", "error_sentence", "correct_sentence"]
    sinks.write_csv(table(s, d, "typo_pairs"), path, columns)
    return sources.sniffed_csv(s, sources.only_file(s, path)).select(*columns)


@query(
    "SELECT task, k AS noise_type, count(*) AS n_rows FROM mcq_items, (SELECT unnest(['clean', 'spacing', 'jamo', 'pronunciation', 'mixed']) AS k) WHERE noise_type IS NULL OR noise_type = 'clean' GROUP BY ALL"
)
def variant_files(s: SparkSession, d: str) -> DataFrame:
    """Variants written as one folder per task and noise type; the rows that stand there."""
    path = scratch(s, "variants")
    sinks.write_variants(noise.bench_variants(clean_items(s, d)), path)
    back = s.read.option("basePath", path).text(path)
    return back.groupBy("task", "noise_type").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "WITH j AS (SELECT array_to_string(list_filter([coalesce(instruction, ''), coalesce(input, ''), coalesce(output, '')], lambda x: x <> ''), chr(10)) AS t FROM instructions), "
    f"c AS (SELECT replace({o.strip_sql('t')}, chr(13) || chr(10), chr(10)) AS t FROM j WHERE {o.strip_sql('t')} <> '') "
    f"SELECT l, count(*) AS n FROM (SELECT unnest(list_transform(regexp_split_to_array(replace(replace(t, chr(13), chr(10)), chr(65533), ''), chr(10)), lambda x: {o.strip_sql('x')})) AS l FROM c) WHERE l <> '' GROUP BY l"
)
def corpus_files(s: SparkSession, d: str) -> DataFrame:
    """A corpus written as plain text and read line by line; equal lines are counted."""
    path = scratch(s, "corpus")
    sinks.write_corpus(records(s, d), path)
    return sources.text_lines(s, path).groupBy(F.col("line").alias("l")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT subset, count(*) AS n, avg({_RIGHT}) AS accuracy, sum({_RIGHT})::BIGINT AS n_correct FROM mcq_results WHERE subset IS NOT NULL GROUP BY subset")
def result_files(s: SparkSession, d: str) -> DataFrame:
    """Result files, one per subset, written and read again: their metrics and the correct examples in them."""
    right = F.coalesce(F.col("gold") == F.col("pred"), F.lit(False))
    rows = table(s, d, "mcq_results").where("subset IS NOT NULL").groupBy("subset").agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg(right.cast("int")).alias("accuracy")).alias("metrics"), F.collect_list(F.struct(right.alias("correct"))).alias("examples"))
    path = scratch(s, "results")
    rows.select("subset", F.to_json(F.struct("metrics", "examples")).alias("value")).write.partitionBy("subset").text(path)
    back = sources.results(s, path)
    name = F.regexp_extract("path", "subset=([^/]+)/", 1)
    return back.groupBy(name.alias("subset")).agg(F.max("n").cast("bigint").alias("n"), F.max("accuracy").alias("accuracy"), F.sum(F.col("correct").cast("bigint")).alias("n_correct"))


@query(
    "SELECT rate, seed, 'cpt_m_lr' || replace(replace(rate, '-', 'm'), '.', '') || '_seed' || seed AS run FROM (SELECT unnest(['1e-5', '2e-5', '5.5e-6']) AS rate), (SELECT unnest([42, 43])::INT AS seed)"
)
def sweep_runs(s: SparkSession, d: str) -> DataFrame:
    """The grid of a learning-rate sweep with the names of its runs."""
    return pipeline.sweep(s, "cpt_m", ["1e-5", "2e-5", "5.5e-6"], [42, 43])


@query(
    "WITH v AS (SELECT DISTINCT unnest(string_split(output, '')) AS c FROM instructions WHERE output <> '') SELECT count(*) AS n_tokens, 100000::BIGINT AS n_model_rows, count(*) = 100000 AS sizes_agree, list_sort(list_filter(['ㄱ', '쀏'], lambda x: NOT list_contains(list(c), x))) AS missing FROM v"
)
def vocabulary_check(s: SparkSession, d: str) -> DataFrame:
    vocab = tokens.distinct_tokens(records(s, d), "output", tokens.character_tokens)
    return tokens.check_vocabulary(vocab, 100_000, ("ㄱ", "쀏"))


@query("SELECT date_trunc('day', event_time) AS day, event_type, count(*) AS n FROM (SELECT ts AS event_time, event_type FROM events) GROUP BY ALL")
def event_windows(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noisy_pairs(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


__all__ = ["Column", "flagship", "oracle_sql", "queries"]
