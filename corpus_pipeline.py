"""The corpus pipeline: documents through five operators, each stage written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteloom.llm import lines, packing, quality, simhash, winnow
from quoteloom.session import cut_lineage


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are neither of low quality nor toxic."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of templates that recur across documents; ``n_chars`` follows the text where lines went."""
    out = lines.deduplicated(docs)
    changed = F.when(F.col("lines_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(*docs.columns) if "n_chars" in docs.columns else out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints are linked, as ``op5_simhash`` links them."""
    return simhash.kept_by_fingerprint(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return winnow.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents in training sequences: one row per piece."""
    return packing.packed(docs).withColumnRenamed("id", "doc_id").drop("row")


STAGES = [
    ("quality_classifier", quality_classifier), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]
#: A fitted scorer and similarity components are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
