"""Tables by name, and the canonical views that the detectors take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIMENSIONS = 64


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def samples(spark: SparkSession, base: str) -> DataFrame:
    """sample_id, contributor, text: documents as contributed samples."""
    return table(spark, base, "documents").select(F.col("doc_id").alias("sample_id"), F.col("source").alias("contributor"), "text", "n_chars")


def vectors(spark: SparkSession, base: str) -> DataFrame:
    """sample_id, label, vector (array of double): embeddings as image features."""
    return table(spark, base, "embeddings").select(F.col("vec_id").alias("sample_id"), "label", F.col("embedding").cast("array<double>").alias("vector"))
