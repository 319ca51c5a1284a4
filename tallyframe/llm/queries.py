"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import (
    alignment, chat, decontaminate, divergence, exact_dedup, fingerprints, html_text, line_dedup, mixing, near_dup, secrets,
    suffix_dedup, toxicity,
)
from tallyframe.llm.oracles import AUDIT_SQL, CHAT_SQL, EXACT_SQL, MIX_SQL

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, folder, "documents"), rule=line_dedup.PAIRS)


def op2_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_groups(table(spark, folder, "documents"))


def op3_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.main_texts(table(spark, folder, "pages"))


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, folder, "documents"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels")))


def op6_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_report(table(spark, folder, "documents"))


def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_report(table(spark, folder, "documents"))


def op10_chat(spark: SparkSession, folder: str) -> DataFrame:
    shown = chat.rotate(table(spark, folder, "conversations"))
    return shown.withColumn("masks", chat.mask_text(F.col("masks")))


def op11_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence_audit(table(spark, folder, "documents"))


def op12_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.dedup_exact(table(spark, folder, "documents"))


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_minhash": op2_minhash,
    "op3_html_text": op3_html_text,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_mix": op6_mix,
    "op7_decontaminate": op7_decontaminate,
    "op8_fingerprints": op8_fingerprints,
    "op9_secrets": op9_secrets,
    "op10_chat": op10_chat,
    "op11_divergence": op11_divergence,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_alignment": op13_alignment,
}
ORACLES: dict[str, str] = {
    "op6_mix": MIX_SQL, "op10_chat": CHAT_SQL, "op11_divergence": AUDIT_SQL, "op12_exact_dedup": EXACT_SQL,
}
