"""One thin query per operator, over whole tables; ``sql()`` gives the oracles that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from confluo.llm import attention_lm, circulant, crf, cube, drake, licenses, mcd, oracles, ordinal, packing, repair, secrets, token_scan, wu_manber
from confluo.session import ship, table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return token_scan.document_token_counts(table(spark, sf_dir, "documents"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return attention_lm.score(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return wu_manber.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "items")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    return ordinal.rate(docs, ordinal.fit(docs, table(spark, sf_dir, "labels")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mcd.judged(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return crf.identify(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return circulant.near_duplicates(table(spark, sf_dir, "documents"), circulant.Similarity(shingle=2))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return cube.mixed(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return repair.audited(repair.damaged(table(spark, sf_dir, "conversations")), copies="copies")


def op13_drake_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return drake.clusters(table(spark, sf_dir, "embeddings")).drop("went")


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def sql() -> dict[str, str]:
    return {"op5_benchmark_decontamination": oracles.op5, "op9_minhash_near_dedup": oracles.op9, "op10_license_scans": oracles.op10(), "op12_conversation_repair": oracles.op12(), "op13_drake_clustering": oracles.op13()}
