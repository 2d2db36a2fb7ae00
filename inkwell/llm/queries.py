"""Registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import (
    bpe,
    decontaminate,
    license_scan,
    lm_score,
    mixing,
    multiset_hash,
    oracles,
    quality_mil,
    quality_rules,
    resample,
    sharding,
    simhash_dedup,
    source_audit,
    suffix_dedup,
)


def _on_documents(query: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": _on_documents(quality_rules.query),
    "op2_sharding": _on_documents(sharding.query),
    "op3_license_scan": _on_documents(license_scan.query),
    "op4_suffix_dedup": _on_documents(suffix_dedup.query),
    "op5_mix_sources": _on_documents(mixing.query),
    "op6_lm_score": lambda spark, sf_dir: lm_score.query(
        spark.read.parquet(f"{sf_dir}/documents.parquet"),
        spark.read.parquet(f"{sf_dir}/labels.parquet")),
    "op7_bpe": _on_documents(bpe.query),
    "op8_simhash_dedup": _on_documents(simhash_dedup.query),
    "op9_multiset_hash": _on_documents(multiset_hash.query),
    "op10_quality_mil": lambda spark, sf_dir: quality_mil.query(
        spark.read.parquet(f"{sf_dir}/documents.parquet"),
        spark.read.parquet(f"{sf_dir}/labels.parquet")),
    "op11_decontaminate": lambda spark, sf_dir: decontaminate.query(
        spark.read.parquet(f"{sf_dir}/documents.parquet"),
        spark.read.parquet(f"{sf_dir}/benchmark.parquet")),
    "op12_source_audit": _on_documents(source_audit.query),
    "op13_resample": lambda spark, sf_dir: resample.query(
        spark.read.parquet(f"{sf_dir}/documents.parquet"),
        spark.read.parquet(f"{sf_dir}/benchmark.parquet")),
}

ORACLES: dict[str, str] = {
    "op1_quality_rules": oracles.rules_sql(),
    "op2_sharding": oracles.shard_sql(),
    "op3_license_scan": oracles.licence_sql(),
    "op4_suffix_dedup": oracles.SUFFIX_SQL,
    "op5_mix_sources": oracles.MIX_SQL,
    "op9_multiset_hash": oracles.fingerprint_sql(),
    "op11_decontaminate": oracles.LEAK_SQL,
    "op12_source_audit": oracles.AUDIT_SQL,
    "op13_resample": oracles.RESAMPLE_SQL,
}
