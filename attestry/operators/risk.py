"""Contributor risk from four kinds of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions import columns as C

#: Weights of a flagged label by its confidence; fixed values.
LABEL_WEIGHTS = {"HIGH": 1.0, "MEDIUM": 0.6, "LOW": 0.3}
#: Shares of the four evidences in the raw risk; fixed values.
SHARES = {"trigger": 0.40, "label": 0.30, "duplicate": 0.20, "ood": 0.10}
#: Least risk of each level; fixed values.
LEVELS = {"CRITICAL": 0.50, "HIGH": 0.28, "MEDIUM": 0.12}


def contributor_evidence(samples: DataFrame, flooding: DataFrame, labels: DataFrame, ood: DataFrame, triggers: DataFrame, systematic: DataFrame | None = None) -> DataFrame:
    """One row for each contributor (null is one too) with the counts that risk() takes.

    samples: sample_id, contributor. flooding: contributor, duplicate_samples, is_flooding. labels: sample_id, confidence.
    ood: sample_id. triggers: sample_id, confidence. systematic: contributor. A sample flagged twice counts once, with its greatest weight.
    """
    weight = F.lit(LABEL_WEIGHTS["LOW"])
    for name in ("MEDIUM", "HIGH"):
        weight = F.when(F.col("confidence") == name, LABEL_WEIGHTS[name]).otherwise(weight)
    by_label = labels.withColumn("_w", weight).groupBy("sample_id").agg(F.max("_w").alias("label_weight"))
    by_trigger = triggers.groupBy("sample_id").agg(F.max("confidence").alias("trigger_confidence"))
    rows = samples.select("sample_id", "contributor").join(by_label, "sample_id", "left").join(by_trigger, "sample_id", "left").join(ood.select("sample_id").distinct().withColumn("is_ood", F.lit(True)), "sample_id", "left")
    flagged = F.col("label_weight").isNotNull() | F.col("trigger_confidence").isNotNull() | F.col("is_ood").isNotNull()
    totals = rows.groupBy("contributor").agg(
        F.count("*").alias("total_samples"),
        F.count("label_weight").alias("label_count"),
        F.coalesce(F.sum("label_weight"), F.lit(0.0)).alias("label_weight"),
        F.count("is_ood").alias("ood_count"),
        F.count("trigger_confidence").alias("trigger_count"),
        F.coalesce(F.sum("trigger_confidence"), F.lit(0.0)).alias("trigger_weight"),
        F.coalesce(F.max("trigger_confidence"), F.lit(0.0)).alias("trigger_best"),
        F.count_if(flagged).alias("flagged_count"),
    )
    flood = flooding.select(F.col("contributor").alias("_c"), "duplicate_samples", "is_flooding")
    out = totals.join(flood, F.col("contributor").eqNullSafe(F.col("_c")), "left").drop("_c")
    if systematic is None:
        out = out.withColumn("is_systematic", F.lit(False))
    else:
        named = systematic.select(F.col("contributor").alias("_c")).distinct().withColumn("is_systematic", F.lit(True))
        out = out.join(named, F.col("contributor").eqNullSafe(F.col("_c")), "left").drop("_c").fillna(False, "is_systematic")
    return out.fillna(0, "duplicate_samples").fillna(False, "is_flooding")


def risk(evidence: DataFrame) -> DataFrame:
    """contributor, the four evidences, risk_score, risk_level and dominant_factor (ties: in the order Backdoor, Label, Duplicate, OOD)."""
    total = F.col("total_samples")
    share = F.col("duplicate_samples") / total
    flooding = F.col("is_flooding") | ((F.col("duplicate_samples") >= 2) & (share >= 0.20))
    dup = F.when(flooding, F.least(F.lit(1.0), 2 * share)).otherwise(F.least(F.lit(0.3), share))
    label = F.least(F.lit(1.0), 2.5 * F.col("label_weight") / total)
    label = F.when(F.col("is_systematic"), F.least(F.lit(1.0), label + 0.35)).otherwise(label)
    ood = F.least(F.lit(1.0), 1.5 * F.col("ood_count") / total)
    trigger = F.least(F.lit(1.0), 4 * F.col("trigger_weight") / total)
    rows = evidence.select("*", F.round(dup, 4).alias("duplicate_evidence"), F.round(label, 4).alias("label_evidence"), F.round(ood, 4).alias("ood_evidence"), F.round(trigger, 4).alias("trigger_evidence"))
    d, la, o, t = (F.col(f"{k}_evidence") for k in ("duplicate", "label", "ood", "trigger"))
    raw = SHARES["trigger"] * t + SHARES["label"] * la + SHARES["duplicate"] * d + SHARES["ood"] * o
    widespread = (F.col("flagged_count") / total >= 0.40) & ((d >= 0.5) | (la >= 0.5))
    final = F.round(C.clamp(F.when(F.col("trigger_best") >= 0.75, F.greatest(raw, F.lit(0.60))).when(widespread, F.greatest(raw, F.lit(0.35))).otherwise(raw)) + 1e-9, 4)  # the same way in any engine where four places are a tie
    scored = rows.withColumn("risk_score", final)
    r = F.col("risk_score")
    level = (
        F.when((r >= LEVELS["CRITICAL"]) | (F.col("trigger_count") >= 2), "CRITICAL")
        .when((r >= LEVELS["HIGH"]) | (F.col("is_systematic") & (F.col("label_count") >= 3)) | (F.col("is_flooding") & (F.col("duplicate_samples") >= 3)), "HIGH")
        .when(r >= LEVELS["MEDIUM"], "MEDIUM")
        .otherwise("CLEAN")
    )
    top = F.greatest(t, la, d, o)
    factor = F.when(top <= 0, "None").when(t == top, "Backdoor").when(la == top, "Label").when(d == top, "Duplicate").otherwise("OOD")
    return scored.select("contributor", "total_samples", "duplicate_evidence", "label_evidence", "ood_evidence", "trigger_evidence", "risk_score", level.alias("risk_level"), factor.alias("dominant_factor"))


def affected_batches(samples: DataFrame, flagged: DataFrame) -> DataFrame:
    """For each contributor, the sorted batches (null as the empty text) with a flagged sample."""
    hit = samples.join(flagged.select("sample_id"), "sample_id", "left_semi")
    return hit.groupBy("contributor").agg(F.sort_array(F.collect_set(F.coalesce("batch", F.lit("")))).alias("affected_batches"))
