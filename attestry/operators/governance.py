"""Findings, health score, disposition and severity counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Points for the first, second and every further finding of a severity; fixed values.
PENALTIES = {"CRITICAL": (18, 12, 6), "HIGH": (10, 6, 3), "MEDIUM": (5, 3, 3), "LOW": (2, 2, 2)}
#: Slices that the ranks of a severity are made in.
SLICES = 256
CONTRIBUTOR_PREFIX = "FND-CONTRIB-"


def penalty(severity: Column, n: Column) -> Column:
    """Points for n findings of one severity."""
    total = F.lit(0)
    for name, (first, second, more) in PENALTIES.items():
        points = F.when(n >= 1, first).otherwise(0) + F.when(n >= 2, second).otherwise(0) + F.greatest(F.lit(0), n - 2) * more
        total = F.when(severity == name, points).otherwise(total)
    return total


def health(findings: DataFrame, group: str | None = None) -> DataFrame:
    """health_score (100 less all points, at least 0), counts by severity and disposition; findings: finding_id, severity[, group].

    Only counts matter, so each severity is counted before any point is given. Contributor findings repeat
    others and cost nothing, but count for the disposition.
    """
    keys = [group] if group else []
    own = ~F.coalesce(F.startswith(F.col("finding_id"), F.lit(CONTRIBUTOR_PREFIX)), F.lit(False))
    counts = findings.groupBy(*keys, "severity").agg(F.count("*").alias("n"), F.count_if(own).alias("own"))
    per = counts.withColumn("points", penalty(F.col("severity"), F.col("own")))
    of = lambda s: F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n"))), F.lit(0)).cast("long").alias(f"{s.lower()}_count")
    rows = per.groupBy(*keys).agg(*(of(s) for s in PENALTIES), F.round(F.greatest(F.lit(0.0), 100.0 - F.coalesce(F.sum("points"), F.lit(0))), 1).alias("health_score"))
    return rows.withColumn("disposition", disposition())


def disposition() -> Column:
    critical, high, medium, score = (F.col(c) for c in ("critical_count", "high_count", "medium_count", "health_score"))
    return F.when((critical > 0) | (score < 50), "QUARANTINE").when((high > 0) | (medium >= 2) | (score < 80), "REVIEW").otherwise("ACCEPT")


def ranked_penalties(findings: DataFrame, order: str) -> DataFrame:
    """Each finding with its rank inside its severity, by the number ``order``, and the points that rank costs.

    Ranks run inside slices of about equally many findings; what lies before a slice is one small row for each.
    """
    cuts = findings.agg(F.percentile_approx(F.col(order).cast("double"), [i / SLICES for i in range(1, SLICES)], 10_000)).first()[0] or []
    after = F.filter(F.array(*map(F.lit, sorted(set(cuts)))).cast("array<double>"), lambda c: c < F.col(order).cast("double"))
    sliced = findings.withColumn("_slice", F.when(F.col(order).isNull(), -1).otherwise(F.size(after)))
    before = W.partitionBy("severity").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = sliced.groupBy("severity", "_slice").count().select(F.col("severity").alias("_severity"), F.col("_slice").alias("_s"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    rows = sliced.join(F.broadcast(carried), F.col("severity").eqNullSafe(F.col("_severity")) & (F.col("_slice") == F.col("_s")))
    rank = (F.row_number().over(W.partitionBy("severity", "_slice").orderBy(order)) + F.col("_before")).cast("int")
    points = F.lit(0)
    for name, (first, second, more) in PENALTIES.items():
        points = F.when(F.col("severity") == name, F.when(F.col("rank") == 1, first).when(F.col("rank") == 2, second).otherwise(more)).otherwise(points)
    return rows.withColumn("rank", rank).withColumn("points", points).select(*findings.columns, "rank", "points")


def contributor_findings(risks: DataFrame) -> DataFrame:
    """A finding for each contributor that isn't clean."""
    return risks.filter("risk_level <> 'CLEAN'").select(F.concat(F.lit(CONTRIBUTOR_PREFIX), F.coalesce("contributor", F.lit("unknown"))).alias("finding_id"), F.lit("contributor_risk").alias("kind"), F.col("risk_level").alias("severity"), F.col("risk_score").alias("evidence"))


def detector_findings(kind: str, rows: DataFrame, evidence: Column, severity: Column) -> DataFrame:
    """At most one finding from a one-row detector summary: none where severity is null."""
    return rows.select(F.lit(f"FND-{kind.upper()}").alias("finding_id"), F.lit(kind).alias("kind"), severity.alias("severity"), F.round(evidence, 4).alias("evidence")).filter(F.col("severity").isNotNull())
