"""Registered queries of the operators over the supplied tables, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import alignment, decontaminate, extract, fingerprints, language, lines, maxent, merkle, mixing, passages, rules, shards, simhash, sql

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_lm_scores(spark: SparkSession, sf: str) -> DataFrame:
    return maxent.score_documents(table(spark, sf, "documents"))


def op2_shards(spark: SparkSession, sf: str) -> DataFrame:
    return shards.shard_documents(table(spark, sf, "documents"))


def op3_main_text(spark: SparkSession, sf: str) -> DataFrame:
    return extract.main_text(table(spark, sf, "pages"))


def op4_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf, "documents"))


def op5_language(spark: SparkSession, sf: str) -> DataFrame:
    return language.language_of_documents(table(spark, sf, "documents"))


def op6_rules(spark: SparkSession, sf: str) -> DataFrame:
    rows, name = rules.ledger(table(spark, sf, "documents").select("doc_id", "text"))
    bits = rows[name]["fail_bits"]
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select(
        "doc_id", *(rows[name][c].alias(c) for c in columns),
        (~rules.passes(bits, "base")).alias("base_failed"), rules.passes(bits, "v1").alias("kept"), bits.alias("fail_bits"),
    )


def op7_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.component_ids(table(spark, sf, "documents"))


def op8_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op9_site_lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines.site_lines(table(spark, sf, "pages"))


def op10_passages(spark: SparkSession, sf: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf, "documents"))


def op11_merkle(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.verify_documents(table(spark, sf, "documents"))


def op12_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.likeness_of_documents(table(spark, sf, "documents"))


def op13_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_lm_scores, op2_shards, op3_main_text, op4_mixture, op5_language, op6_rules, op7_simhash, op8_decontamination, op9_site_lines,
        op10_passages, op11_merkle, op12_fingerprints, op13_alignment,
    )
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op6_rules": sql.RULES,
    "op11_merkle": sql.MERKLE,
    "op12_fingerprints": sql.FINGERPRINTS,
    "op8_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
it AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, list_slice(w, s, s + 12) AS x
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS s FROM it WHERE len(w) > 0) t),
lens AS (SELECT DISTINCT len(x) AS n FROM win),
occ AS (SELECT rid, s, n, list_slice(w, s, s + n - 1) AS x
  FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, lens WHERE len(w) >= n) t),
hit AS (SELECT rid, s, n, item_id FROM occ JOIN win USING (x)),
cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(s, s + n - 1)) AS p FROM hit) t GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT rid, item_id FROM hit) t GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN ids USING (rid)""",
}
