"""Backdoor triggers in a vector seen as a square grid: a corner patch, a blended mark, a spectral spike."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import columns as C

SIDE = 8


def _spread(cells: Column) -> Column:
    """Population variance of an array."""
    m = C.array_mean(cells)
    return C.array_mean(F.transform(cells, lambda x: (x - m) * (x - m)))


def corner_candidates(vectors: DataFrame, size: int = 3, side: int = SIDE) -> DataFrame:
    """One row for each sample and corner: variance of the patch's Laplacian, spread and mean of its cells.

    The corners' places are exploded first, so that one set of expressions serves all of them.
    """
    corners = {"top_left": (0, 0), "top_right": (0, side - size), "bottom_left": (side - size, 0), "bottom_right": (side - size, side - size)}
    places = []
    for name, (r0, c0) in corners.items():
        cells = [r * side + c for r in range(r0, r0 + size) for c in range(c0, c0 + size)]
        inner = [r * side + c for r in range(max(1, r0), min(side - 1, r0 + size)) for c in range(max(1, c0), min(side - 1, c0 + size))]
        places.append(F.struct(F.lit(name).alias("corner"), F.array(*map(F.lit, cells)).alias("cells"), F.array(*map(F.lit, inner)).alias("inner")))
    v = F.col("vector")
    each = vectors.select("sample_id", "vector", F.explode(F.array(*places)).alias("p"))
    laplacian = F.transform("p.inner", lambda i: F.get(v, i - side) + F.get(v, i + side) + F.get(v, i - 1) + F.get(v, i + 1) - 4 * F.get(v, i))
    patches = each.select("sample_id", "p.corner", F.transform("p.cells", lambda i: F.get(v, i)).alias("patch"), laplacian.alias("laplacian"))
    return patches.select("sample_id", "corner", _spread(F.col("laplacian")).alias("laplacian_variance"), F.sqrt(_spread(F.col("patch"))).alias("spread"), C.array_mean(F.col("patch")).alias("mean"))


def corner_scores(vectors: DataFrame, variance_at: float = 0.25, spread_at: float = 0.1) -> DataFrame:
    """Best corner of each sample (ties: the first name) with its confidence."""
    hot = (F.col("laplacian_variance") > variance_at) & (F.col("spread") > spread_at)
    confidence = F.round(F.when(hot, F.least(F.lit(1.0), 0.5 + F.col("laplacian_variance"))).otherwise(F.lit(0.0)), 4)
    rows = corner_candidates(vectors).withColumn("confidence", confidence)
    best = rows.groupBy("sample_id").agg(F.min_by(F.struct("corner", "confidence"), F.struct(-F.col("confidence"), F.col("corner"))).alias("b"))
    return best.select("sample_id", "b.corner", F.col("b.confidence").alias("corner_confidence"))


def blended_score(v: Column, side: int = SIDE) -> Column:
    """Mean size of the two diagonals' cells against that of all cells, to four places."""
    places = [i * side + i for i in range(side)] + [i * side + side - 1 - i for i in range(side)]
    diagonal = F.transform(F.array(*map(F.lit, places)), lambda i: F.abs(F.get(v, i)))
    return F.round(C.array_mean(diagonal) / (C.array_mean(F.transform(v, lambda x: F.abs(x))) + 1e-7), 4)


def _peak(side: int):
    """A vectorised function of grids: how far the highest log magnitude of the Fourier transform stands above the mean."""

    @F.pandas_udf("double")
    def peak(column: pd.Series) -> pd.Series:
        if not len(column):
            return pd.Series([], dtype="float64")
        grids = np.stack(column.to_numpy()).reshape(-1, side, side)
        # a real grid's spectrum is symmetric, so half of its rows hold all values
        power = 20 * np.log(np.abs(np.fft.fft2(grids)) + 1e-7)[:, : side // 2 + 1].reshape(len(grids), -1)[:, 1:]
        return pd.Series((power.max(1) - power.mean(1)) / (power.std(1) + 1e-7))

    return peak


def peak_z(vectors: DataFrame, side: int = SIDE) -> DataFrame:
    """sample_id and how many standard deviations the highest magnitude stands above the mean."""
    return vectors.select("sample_id", F.round(_peak(side)("vector"), 4).alias("peak_z"))


def cascade(vectors: DataFrame, corner_at: float = 0.65, blended_at: float = 1.65, z_at: float = 2.5) -> DataFrame:
    """Family of each sample: corner, else blended, else spectral, else none, with its confidence."""
    rows = vectors.join(corner_scores(vectors), "sample_id").join(peak_z(vectors), "sample_id").withColumn("blended_ratio", blended_score(F.col("vector")))
    corner, blended, spectral = F.col("corner_confidence") >= corner_at, F.col("blended_ratio") > blended_at, F.col("peak_z") > z_at
    family = F.when(corner, "corner").when(blended, "blended").when(spectral, "spectral").otherwise("none")
    confidence = F.when(corner, F.col("corner_confidence")).when(blended, F.least(F.lit(1.0), 0.70 + 0.25 * F.least(F.lit(1.0), F.col("blended_ratio") / 2.8))).when(spectral, F.least(F.lit(1.0), 0.65 + F.col("peak_z") / 8)).otherwise(F.lit(0.0))
    return rows.select("sample_id", "label", "corner_confidence", "blended_ratio", "peak_z", family.alias("family"), F.round(confidence, 4).alias("confidence"))


def family_breakdown(found: DataFrame) -> DataFrame:
    """Samples and mean confidence of each family, and its share of all samples."""
    total = found.agg(F.count("*").alias("_n"))
    rows = found.groupBy("family").agg(F.count("*").alias("samples"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))
    return rows.join(F.broadcast(total)).select("family", "samples", "mean_confidence", F.round(F.col("samples") / F.col("_n"), 4).alias("share"))


def population_z(scores: DataFrame, value: str) -> DataFrame:
    """scores with z: distance from the population mean in standard deviations; the two moments are one broadcast row."""
    moments = scores.agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return scores.join(F.broadcast(moments)).withColumn("z", F.round((F.col(value) - F.col("_m")) / (F.col("_s") + 1e-7), 4)).drop("_m", "_s")
