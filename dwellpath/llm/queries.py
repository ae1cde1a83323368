"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dwellpath.llm import chat, fim, fingerprints, jaccard, langid, licenses, merkle, mixing, packing, pii, quality, secret_scan, sharding
from dwellpath.llm.spark import table


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(table(spark, sf_dir, "conversations"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_chat": op1_chat,
        "op2_fingerprints": op2_fingerprints,
        "op3_sharding": op3_sharding,
        "op4_secrets": op4_secrets,
        "op5_mixing": op5_mixing,
        "op6_packing": op6_packing,
        "op7_jaccard": op7_jaccard,
        "op8_quality": op8_quality,
        "op9_licenses": op9_licenses,
        "op10_language": op10_language,
        "op11_manifest": op11_manifest,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_personal_data": op13_personal_data,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_sharding": sharding.oracle(),
        "op5_mixing": mixing.oracle(),
        "op8_quality": quality.oracle(),
        "op9_licenses": licenses.oracle(),
        "op11_manifest": merkle.oracle(),
        "op12_fill_in_middle": fim.oracle(),
    }
