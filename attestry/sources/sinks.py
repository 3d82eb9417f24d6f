"""Sinks and the ledgers' loader.

Appending goes through Spark's committers, so a reader sees all rows of a write or none. Overwriting a folder deletes
its rows first; where a reader must never miss them, write a new folder instead.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_table(df: DataFrame, path: str, *partitions: str) -> None:
    """An append-only table: chains, registries and ledgers grow by their new rows alone."""
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def load_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A ledger, chain or registry kept as JSON lines; a line that isn't of the schema is an error when it is read, never skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def coco_tables(samples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, annotations (renumbered from 1, with area) and categories (without 0) of samples."""
    numbered = samples.withColumn("image_id", F.row_number().over(W.orderBy("sample_id")))
    images = numbered.select(F.col("image_id").alias("id"), "file_name", "width", "height", "contributor", F.col("batch").alias("batch_id"))
    boxes = numbered.select("image_id", F.posexplode("boxes").alias("p", "b"))
    notes = boxes.select(F.row_number().over(W.orderBy("image_id", "p")).alias("id"), "image_id", "b.category_id", F.array("b.x", "b.y", "b.width", "b.height").alias("bbox"), (F.col("b.width") * F.col("b.height")).alias("area"))
    names = boxes.filter("b.category_id <> 0").groupBy(F.col("b.category_id").alias("id")).agg(F.max_by("b.category_name", F.struct("image_id", "p")).alias("name"))
    return images, notes, names


@dataclass(frozen=True)
class Thresholds:
    """Frozen calibration; the defaults are those that the detectors use."""

    mean_hash_bits: int = 6
    ssim: float = 0.82
    label_margin: float = 0.05
    ood_norm: float = 0.7
    peak_z: float = 6.0
    provenance: dict[str, str] = field(default_factory=dict)

    def save(self, spark: SparkSession, path: str) -> None:
        write_json(spark.createDataFrame([(json.dumps(asdict(self), sort_keys=True),)], "thresholds string").coalesce(1), path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Thresholds:
        """The saved thresholds; a missing folder is an error rather than the defaults."""
        return cls(**json.loads(spark.read.schema("thresholds string").json(path).first().thresholds))
