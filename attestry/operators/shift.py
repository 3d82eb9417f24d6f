"""Distribution shift: two-sample statistics in one sorted pass, and their classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def two_sample(values: DataFrame) -> DataFrame:
    """For each dimension: Kolmogorov-Smirnov statistic, its asymptotic p-value and Wasserstein distance.

    values: dimension, is_target, value. Rows are first counted by value, so equal values make one row. The cumulative
    counts run over a window for each dimension and value slice; what lies before a slice is one small row for each.
    """
    counted = values.filter("value is not null and not isnan(value)").groupBy("dimension", "value").agg(F.count_if(~F.col("is_target")).alias("r"), F.count_if("is_target").alias("t"))
    bounds = counted.groupBy("dimension").agg(F.min("value").alias("_low"), F.max("value").alias("_high"), F.sum("r").alias("_nr"), F.sum("t").alias("_nt"))
    width = (F.col("_high") - F.col("_low")) / 256
    sliced = counted.join(F.broadcast(bounds), "dimension").withColumn("_slice", F.when(width > 0, F.least(F.lit(255), F.floor((F.col("value") - F.col("_low")) / width))).otherwise(F.lit(0)))
    before = W.partitionBy("dimension").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("dimension").orderBy("_slice").rowsBetween(1, W.unboundedFollowing)
    slices = sliced.groupBy("dimension", "_slice").agg(F.sum("r").alias("_r"), F.sum("t").alias("_t"), F.min("value").alias("_first"))
    carried = slices.select("dimension", "_slice", F.coalesce(F.sum("_r").over(before), F.lit(0)).alias("_cr"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_ct"), F.first("_first").over(after).alias("_next"))
    within = W.partitionBy("dimension", "_slice").orderBy("value")
    running = within.rowsBetween(W.unboundedPreceding, 0)
    rows = sliced.join(F.broadcast(carried), ["dimension", "_slice"]).select(
        "dimension",
        ((F.col("_cr") + F.sum("r").over(running)) / F.col("_nr")).alias("f"),
        ((F.col("_ct") + F.sum("t").over(running)) / F.col("_nt")).alias("g"),
        (F.coalesce(F.lead("value").over(within), F.col("_next")) - F.col("value")).alias("gap"),
        "_nr",
        "_nt",
    )
    out = rows.groupBy("dimension").agg(F.max("_nr").alias("n_reference"), F.max("_nt").alias("n_target"), F.max(F.abs(F.col("f") - F.col("g"))).alias("_ks"), F.sum(F.abs(F.col("f") - F.col("g")) * F.col("gap")).alias("_w"))
    return out.filter("n_reference > 0 and n_target > 0").select("dimension", "n_reference", "n_target", F.round("_ks", 6).alias("ks_statistic"), F.round(kolmogorov_p(F.col("_ks"), F.col("n_reference"), F.col("n_target")), 6).alias("p_value"), F.round(F.coalesce("_w", F.lit(0.0)), 6).alias("wasserstein"))


def kolmogorov_p(ks: Column, n: Column, m: Column, terms: int = 20) -> Column:
    """Asymptotic two-sided p-value; for small samples it differs a little from the exact one."""
    en = F.sqrt(n * m / (n + m))
    x = (en + 0.12 + 0.11 / en) * ks
    series = sum((F.lit(2.0 * (-1) ** (j - 1)) * F.exp(-2.0 * j * j * x * x) for j in range(1, terms + 1)), F.lit(0.0))
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))


def classify(statistics: DataFrame, sensor: str, season: str, illumination: str, least: int = 5) -> DataFrame:
    """One row: verdict over the dimensions, drift_score (share of shifted ones) and confidence.

    A dimension is shifted at p < .10, KS >= .25 or Wasserstein >= 1.5. A severe sensor shift alone, or any
    sensor shift alone, is suspicious; other shifts are operational drift.
    """
    shifted = (F.col("p_value") < 0.10) | (F.col("ks_statistic") >= 0.25) | (F.col("wasserstein") >= 1.5)
    severe = (F.col("ks_statistic") >= 0.35) | (F.col("wasserstein") >= 3.0)
    has = lambda name, flag: F.coalesce(F.bool_or(flag & (F.col("dimension") == name)), F.lit(False))
    row = statistics.agg(
        F.count("*").alias("dimensions"),
        F.count_if(shifted).alias("shifted_dimensions"),
        has(sensor, shifted).alias("sensor"),
        has(sensor, severe).alias("severe"),
        has(season, shifted).alias("season"),
        has(illumination, shifted).alias("light"),
        F.coalesce(F.min(F.least("n_reference", "n_target")), F.lit(0)).alias("samples"),
    )
    n, k = F.col("samples"), F.col("shifted_dimensions")
    alone = F.col("sensor") & (k == 1)
    verdict = F.when((n < least) | (k == 0), "NO_SHIFT").when(F.col("severe") & ~F.col("season") & ~F.col("light"), "SUSPICIOUS_MANIPULATION").when(alone, "SUSPICIOUS_MANIPULATION").otherwise("OPERATIONAL_DRIFT")
    score = F.when(n < least, 0.0).otherwise(F.coalesce(F.try_divide(k, F.col("dimensions")), F.lit(0.0)))
    return row.select("dimensions", "shifted_dimensions", verdict.alias("verdict"), F.round(score, 4).alias("drift_score"), F.round(F.least(F.lit(1.0), n / 30.0), 4).alias("confidence"), (n < least).alias("insufficient"))


def environment_features(rows: DataFrame, group: str, value: str, low: float, high: float) -> DataFrame:
    """Brightness-like features of each group: mean, population spread, share below low and above high, energy of the histogram of ten levels, and peak signal to noise."""
    bins = rows.filter(F.col(value).isNotNull()).withColumn("_b", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(9.0), (F.col(value) - low) / (high - low) * 10))))
    level = bins.groupBy(group, "_b").agg(F.count("*").alias("_n"))
    total = level.groupBy(group).agg(F.sum("_n").alias("_t"), F.sum(F.col("_n") * F.col("_n")).alias("_q"))
    stats = bins.groupBy(group).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.avg(F.when(F.col(value) < low, 1.0).otherwise(0.0)).alias("_l"), F.avg(F.when(F.col(value) > high, 1.0).otherwise(0.0)).alias("_h"))
    return stats.join(total, group).select(group, F.round("_m", 2).alias("mean_value"), F.round("_s", 2).alias("value_std"), F.round("_l", 4).alias("low_share"), F.round("_h", 4).alias("high_share"), F.round(F.col("_q") / (F.col("_t") * F.col("_t")), 4).alias("histogram_energy"), F.round(20 * F.log10(255 / (F.col("_s") + 1e-5)), 2).alias("psnr"))
