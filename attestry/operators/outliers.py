"""Out-of-distribution scores: distance to a reference, normalised, and an isolation forest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TREES, SUBSAMPLE = 100, 256


def min_max_scores(scored: DataFrame, score: str = "score", flag_at: float = 0.7) -> DataFrame:
    """scored with norm_score (0 for all where the score is constant) and is_ood; the two bounds are one broadcast row."""
    bounds = scored.agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
    span = F.col("_high") - F.col("_low")
    norm = F.round(F.when(span > 0, (F.col(score) - F.col("_low")) / span).otherwise(F.lit(0.0)), 4)
    return scored.join(F.broadcast(bounds)).withColumn("norm_score", norm).withColumn("is_ood", norm >= flag_at).drop("_low", "_high")


def ratio(flagged: DataFrame) -> DataFrame:
    """One row: samples, flagged samples and their share."""
    n = F.count("*")
    return flagged.agg(n.alias("total_samples"), F.count_if("is_ood").alias("ood_samples"), F.round(F.try_divide(F.count_if("is_ood"), n), 4).alias("ood_ratio"))


def _harmonic(n: int) -> float:
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n if n > 2 else float(max(0, n - 1))


def _grow(rows: np.ndarray, rng: np.random.Generator, depth: int, limit: int):
    spread = np.ptp(rows, axis=0) if len(rows) else np.zeros(0)
    usable = np.flatnonzero(spread > 0)
    if depth >= limit or len(rows) <= 1 or not len(usable):
        return depth + _harmonic(len(rows))
    axis = int(rng.choice(usable))
    at = rng.uniform(rows[:, axis].min(), rows[:, axis].max())
    below = rows[:, axis] < at
    return axis, at, _grow(rows[below], rng, depth + 1, limit), _grow(rows[~below], rng, depth + 1, limit)


def _depths(tree, rows: np.ndarray, out: np.ndarray, which: np.ndarray) -> None:
    if not isinstance(tree, tuple):
        out[which] += tree
        return
    below = rows[which, tree[0]] < tree[1]
    _depths(tree[2], rows, out, which[below])
    _depths(tree[3], rows, out, which[~below])


def isolation_forest(vectors: DataFrame, reference: DataFrame | None = None, contamination: float = 0.1, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 42) -> DataFrame:
    """sample_id, score (higher: more isolated), norm_score and is_ood.

    Trees grow from trees * subsample rows of the reference, the least by hash;
    that many rows and the trees are all that the driver and a broadcast hold.
    The cut is the contamination quantile of the scores, or a normalised score of 0.7.
    """
    base = vectors if reference is None else reference
    rows = base.orderBy(F.xxhash64("sample_id", F.lit(seed)), "sample_id").limit(trees * subsample).select("vector").toPandas()["vector"]
    spark = vectors.sparkSession
    if not len(rows):
        return spark.createDataFrame([], "sample_id long, score double, norm_score double, is_ood boolean")
    data = np.stack(rows.to_numpy())
    rng = np.random.default_rng(seed)
    size = min(subsample, len(data))
    limit = int(np.ceil(np.log2(max(2, size))))
    forest = spark.sparkContext.broadcast([_grow(data[rng.choice(len(data), size, replace=False)], rng, 0, limit) for _ in range(trees)])
    scale = max(_harmonic(size), 1e-9)

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        points = np.stack(column.to_numpy())
        total = np.zeros(len(points))
        for tree in forest.value:
            _depths(tree, points, total, np.arange(len(points)))
        return pd.Series(2.0 ** (-total / len(forest.value) / scale))

    scored = vectors.select("sample_id", F.round(score("vector"), 6).alias("score"))
    cut = scored.agg(F.percentile("score", F.lit(1.0 - contamination)).alias("_cut"))
    return min_max_scores(scored).join(F.broadcast(cut)).withColumn("is_ood", F.col("is_ood") | (F.col("score") > F.col("_cut"))).drop("_cut")
