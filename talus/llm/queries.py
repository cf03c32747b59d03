"""The registered queries of the corpus operators and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm import automaton_dedup, hard_negatives, line_dedup, minhash, mixing, oracles, packing, pitman_yor, quality_rules, secrets_scan, source_audit, suffix_dedup, token_counts, winnowing
from talus.session import table


def op1_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.digest(secrets_scan.find_secrets(table(spark, sf_dir, "documents")))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=4)


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.pitman_yor_scores(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_edited(table(spark, sf_dir, "documents"))


def op10_automaton_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton_dedup.automaton_dedup(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.source_audit(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_temperature_mixing": op1_temperature_mixing,
    "op2_token_counts": op2_token_counts,
    "op3_secret_scans": op3_secret_scans,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_pitman_yor": op5_pitman_yor,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_winnowing": op9_winnowing,
    "op10_automaton_dedup": op10_automaton_dedup,
    "op11_line_dedup": op11_line_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_source_audit": op13_source_audit,
}

ORACLES: dict[str, str] = {
    "op4_minhash_dedup": oracles.NEAR_DUPLICATES,
    "op7_quality_rules": oracles.QUALITY,
    "op8_suffix_array_dedup": oracles.SUBSTRINGS,
    "op10_automaton_dedup": oracles.WORD_WINDOWS,
    "op11_line_dedup": oracles.LINES,
    "op12_hard_negatives": oracles.NEGATIVES,
    "op13_source_audit": oracles.SOURCES,
}
