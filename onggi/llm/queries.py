"""Queries of the nine data problems, over whole tables with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onggi.llm import budget, crosssplit, leakage, lookalikes, mixing, packing, pairs, prose, tokenization
from onggi.session import materialize, spread, table


def _budget_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = table(spark, sf_dir, "source_info")
    records, docs = spread(table(spark, sf_dir, "instructions")), spread(table(spark, sf_dir, "documents"))
    text = F.concat_ws("\n", "instruction", "input", "output")
    a = budget.sliced(records, F.concat(F.lit("r"), F.col("rec_id").cast("string")), text, F.col("source"), F.col("lang"), info)
    b = budget.sliced(docs, F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.col("text"), F.col("source"), F.col("lang"), info)
    return a.unionByName(b)


def p5_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens per source, language and domain."""
    return budget.TokenBudget.in_checkpoint_folder(spark).update(_budget_documents(spark, sf_dir))


def p5_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per slice after an update of an earlier state, in which late documents were missing, some had another text or
    another source, and some stood that are gone now."""
    now = _budget_documents(spark, sf_dir)
    kind = F.pmod(F.xxhash64("key"), F.lit(10))
    old = now.where(kind != 0).select(
        "key", F.when(kind == 1, F.reverse("text")).otherwise(F.col("text")).alias("text"), F.when(kind == 2, F.lit("moved")).otherwise(F.col("source")).alias("source"), "lang", "domain_name"
    )
    gone = now.where(kind == 3).select(F.concat(F.lit("x"), F.col("key")).alias("key"), "text", "source", "lang", "domain_name")
    kept = budget.TokenBudget.in_checkpoint_folder(spark)
    kept.update(old.unionByName(gone))
    return kept.update(now).select("source", "lang", "domain_name", "n_docs")


def p5_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and characters of the same slices, which SQL can tell."""
    docs = _budget_documents(spark, sf_dir)
    return docs.groupBy("source", "lang", "domain_name").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))


def p6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen records with their repeats."""
    records = mixing.sized_records(table(spark, sf_dir, "instructions"))
    return mixing.mix(records, table(spark, sf_dir, "mix_targets")).withColumnRenamed("id", "rec_id")


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = mixing.sized_records(table(spark, sf_dir, "instructions"))
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.mixing_report(mixing.mix(records, targets), targets)


def p6_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source's records are needed."""
    plan = mixing.mixing_plan(mixing.sized_records(table(spark, sf_dir, "instructions")), table(spark, sf_dir, "mix_targets"))
    return plan.select("source", "max_repeats", "n_records", "size", F.round("repeats", 6).alias("repeats"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = materialize(tokenization.token_counts(spread(table(spark, sf_dir, "documents")).select("doc_id", "text")), "pack-sizes")
    return packing.pack(sizes, table(spark, sf_dir, "pack_sizes"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document or piece."""
    return _packed(spark, sf_dir).select("pack_name", "doc_id", "piece_no", F.col("size").alias("n_tokens"), "container")


def p8_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.container_fills(_packed(spark, sf_dir))


def p8_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: containers in use and the number that no packing can beat."""
    return packing.certificates(_packed(spark, sf_dir))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenization.encode_documents(spread(table(spark, sf_dir, "documents")))


def p7_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: documents, and those that encoding and decoding give back unchanged."""
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "lang", "text")
    back = tokenization.roundtrip(docs)
    return back.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("same").cast("long")).alias("n_same"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = crosssplit.same_exchanges(spread(table(spark, sf_dir, "instructions")))
    return pairs.select(F.least("e_id", "r_id").alias("rec_id_a"), F.greatest("e_id", "r_id").alias("rec_id_b"))


def p1_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation split and source: records that stand in train too, pairs, and mean overlap."""
    records = spread(table(spark, sf_dir, "instructions"))
    named = crosssplit.matched_records(records).join(records.select("rec_id", "split", "source"), "rec_id")
    return named.groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n_links").alias("n_pairs"), F.round(F.avg("overlap"), 6).alias("mean_overlap"))


def _lookalike_parts(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, str, list[str], str]]:
    return [
        (spread(table(spark, sf_dir, "instructions")), "rec_id", ["instruction", "input"], "instructions"),
        (spread(table(spark, sf_dir, "noisy_pairs")), "pair_id", ["noisy_instruction"], "noisy_pairs"),
    ]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (lookalikes.lookalike_values(*x) for x in _lookalike_parts(spark, sf_dir))
    return a.unionByName(b)


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of values with one skeleton that are written in several ways."""
    a, b = (lookalikes.skeletons(*x) for x in _lookalike_parts(spark, sf_dir))
    return lookalikes.skeleton_groups(a.unionByName(b))


def _test_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_kind, item_id, text): clean questions, their choices, and outputs of validation and test records."""
    mcq = table(spark, sf_dir, "mcq_items").where("noise_type IS NULL OR noise_type = 'clean'")
    texts = F.concat(F.array("question"), F.coalesce("choices", F.array().cast("array<string>")))
    questions = mcq.select(F.lit("mcq").alias("item_kind"), F.col("id").alias("item_id"), F.explode(texts).alias("text"))
    held_out = table(spark, sf_dir, "instructions").where("split IN ('validation', 'test')")
    return questions.unionByName(held_out.select(F.lit("instruction").alias("item_kind"), F.col("rec_id").cast("string").alias("item_id"), F.col("output").alias("text")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(spread(table(spark, sf_dir, "documents")), _test_items(spark, sf_dir)).select("doc_id", "item_kind", "item_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.broken_pairs(spread(table(spark, sf_dir, "instructions")))


def p4_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects per source: the narrow result joined back by id, counted before the shuffle."""
    records = spread(table(spark, sf_dir, "instructions"))
    return pairs.broken_pairs(records).join(records.select("rec_id", "source"), "rec_id").groupBy("source", "defect").agg(F.count(F.lit(1)).alias("n_records"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.structural_kinds(spread(table(spark, sf_dir, "documents"))).where("kind <> 'prose'")


def p9_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.text_statistics(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "common_words"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_by_source": p1_by_source, "p2_found": p2_found, "p2_groups": p2_groups, "p3_found": p3_found, "p4_found": p4_found, "p4_by_source": p4_by_source, "p5_budget": p5_budget, "p5_update": p5_update, "p5_slices": p5_slices, "p6_mix": p6_mix, "p6_shares": p6_shares, "p6_plan": p6_plan, "p7_ids": p7_ids, "p7_roundtrip": p7_roundtrip, "p8_containers": p8_containers, "p8_fills": p8_fills, "p8_certificates": p8_certificates, "p9_found": p9_found, "p9_stats": p9_stats}


def oracle_sql() -> dict[str, str]:
    sql = _sql()
    sql["p5_update"] = f"SELECT source, lang, domain_name, n_docs FROM ({sql['p5_slices']})"
    return sql


def _sql() -> dict[str, str]:
    return {
        "p5_slices": r"""
            WITH d AS (SELECT concat_ws(chr(10), instruction, input, output) AS t, nullif(regexp_replace(lower(regexp_replace(source, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')), '[- ]+', '_', 'g'), '') AS source, CASE nullif(regexp_extract(lower(regexp_replace(lang, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')), '^[a-z]+', 0), '')
                WHEN 'kor' THEN 'ko' WHEN 'korean' THEN 'ko' WHEN 'eng' THEN 'en' WHEN 'english' THEN 'en' WHEN 'jpn' THEN 'ja' WHEN 'japanese' THEN 'ja' WHEN 'jp' THEN 'ja'
                WHEN 'ger' THEN 'de' WHEN 'deu' THEN 'de' WHEN 'german' THEN 'de' ELSE nullif(regexp_extract(lower(regexp_replace(lang, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')), '^[a-z]+', 0), '') END AS lang FROM instructions
            UNION ALL SELECT coalesce(text, ''), nullif(regexp_replace(lower(regexp_replace(source, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')), '[- ]+', '_', 'g'), ''), CASE nullif(regexp_extract(lower(regexp_replace(lang, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')), '^[a-z]+', 0), '')
                WHEN 'kor' THEN 'ko' WHEN 'korean' THEN 'ko' WHEN 'eng' THEN 'en' WHEN 'english' THEN 'en' WHEN 'jpn' THEN 'ja' WHEN 'japanese' THEN 'ja' WHEN 'jp' THEN 'ja'
                WHEN 'ger' THEN 'de' WHEN 'deu' THEN 'de' WHEN 'german' THEN 'de' ELSE nullif(regexp_extract(lower(regexp_replace(lang, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')), '^[a-z]+', 0), '') END FROM documents)
            SELECT coalesce(d.source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, coalesce(domain_name, 'unknown') AS domain_name,
                   count(*) AS n_docs, sum(length(t))::BIGINT AS n_chars
            FROM d LEFT JOIN source_info i ON d.source = i.source GROUP BY ALL""",
        "p6_plan": r"""
            WITH r AS (SELECT nullif(regexp_replace(lower(regexp_replace(source, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')), '[- ]+', '_', 'g'), '') AS source, length(output) AS size FROM instructions
                       WHERE length(regexp_replace(output, '[ \t\r\n]+', '', 'g')) > 0),
            p AS (SELECT m.source, target_share, max_repeats, count(size) AS n_records, coalesce(sum(size), 0)::BIGINT AS size
                  FROM mix_targets m LEFT JOIN r USING (source) GROUP BY ALL),
            s AS (SELECT min(size * max_repeats / target_share) AS scale FROM p WHERE size > 0)
            SELECT source, max_repeats, n_records, size,
                   round(CASE WHEN size > 0 THEN least(target_share * scale / size, max_repeats::DOUBLE) ELSE 0.0 END, 6) AS repeats FROM p, s""",
        "p9_stats": r"""
            WITH c AS (SELECT lang, list(DISTINCT word) AS common FROM common_words GROUP BY lang),
            d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
            w AS (SELECT d.*, coalesce(c.common, []) AS common,
                         list_filter(regexp_split_to_array(t, '[ \t\n\r]+'), lambda x: x <> '') AS ws,
                         list_filter(regexp_split_to_array(t, '[\n\r]+'), lambda x: regexp_replace(x, '[ \t]+', '', 'g') <> '') AS ls,
                         length(regexp_replace(t, '[ \t\n\r]+', '', 'g')) AS chars,
                         length(regexp_replace(t, '[\p{L}\p{N} \t\n\r]+', '', 'g')) AS symbols
                  FROM d LEFT JOIN c USING (lang))
            SELECT doc_id, lang, len(ws)::BIGINT AS n_words,
                   CASE WHEN len(ws) > 0 THEN round(chars / len(ws), 6) END AS mean_word_len,
                   CASE WHEN chars > 0 THEN round(symbols / chars, 6) END AS symbol_ratio,
                   CASE WHEN len(ls) > 0 THEN round(len(list_filter(ls, lambda x: regexp_matches(x, '[.!?。][ \t]*$'))) / len(ls), 6) END AS line_stop_share,
                   CASE WHEN len(ws) > 0 THEN round(len(list_filter(list_transform(ws, lambda x: regexp_replace(lower(x), '[.,!?]+$', '')),
                        lambda x: list_contains(common, x))) / len(ws), 6) END AS common_share
            FROM w""",
        "p7_roundtrip": "SELECT lang, count(*) AS n_docs, count(*) AS n_same FROM documents GROUP BY lang",
    }
