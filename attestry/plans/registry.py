"""All queries of the library over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attestry.plans import data, integrity, models, records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**data.QUERIES, **integrity.QUERIES, **models.QUERIES, **records.QUERIES}
ORACLES: dict[str, str] = {**data.ORACLES, **integrity.ORACLES, **models.ORACLES, **records.ORACLES}
FLAGSHIP = "disposition"
