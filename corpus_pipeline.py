"""The pipeline over `documents`: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import decontaminate, line_dedup, mixing, near_dup, toxicity
from tallyframe.llm.common import stored


def civil_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not predict toxic. It is fitted on the labelled rows of this input."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_civil(docs, model)


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks leave the texts (`n_chars` follows); a document of which nothing is left goes."""
    out = line_dedup.dedup_lines(docs, keep=True)
    emptied = (F.col("n_removed_chunks") > 0) & (F.length(F.trim(F.translate("text", "\n\t\r", "   "))) == 0)
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    columns = [changed[c].alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return out.filter(~F.coalesce(emptied, F.lit(False))).select(*columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id."""
    return near_dup.keep_one(docs)


def unleaked_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of the benchmark was found."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, with `takes`, how often each is to be read."""
    out = mixing.mix(docs, keep=True)
    takes = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(0)).cast("int")
    return out.filter("taken > 0").select("row.*", takes.alias("takes"))


STAGES = [
    ("toxicity", civil_documents),
    ("line dedup", unrepeated_lines),
    ("near duplicates", distinct_documents),
    ("decontamination", unleaked_documents),
    ("mix", mixed_sources),
]

# Hash boundaries, signatures and a trained classifier are not SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
