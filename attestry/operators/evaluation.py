"""Confusion metrics, calibration, splits, leakage and manifest rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.functions import columns as C


def binary_metrics(universe: DataFrame, group: str | None = None) -> DataFrame:
    """TP, FP, FN, TN and the rates from them; universe: actual, predicted (booleans, null as false) of every row.

    Specificity is 1 without negatives; false negative and detection rates are null without positives.
    """
    a, p = F.coalesce("actual", F.lit(False)), F.coalesce("predicted", F.lit(False))
    keys = [group] if group else []
    n = universe.groupBy(*keys).agg(F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    rounded = lambda c, name: F.round(c, 4).alias(name)
    return n.select(
        *keys,
        *("tp", "fp", "fn", "tn"),
        rounded(precision, "precision"),
        rounded(recall, "recall"),
        rounded(F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)), "f1"),
        rounded(F.coalesce(F.try_divide(tn, tn + fp), F.lit(1.0)), "specificity"),
        rounded(F.coalesce(F.try_divide(fp, fp + tn), F.lit(0.0)), "fpr"),
        rounded(F.try_divide(fn, tp + fn), "fnr"),
        rounded(F.try_divide(tp, tp + fn), "detection_rate"),
        rounded(F.coalesce(F.try_divide(tp + tn, tp + fp + fn + tn), F.lit(0.0)), "accuracy"),
    )


def macro_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.count("*").alias("families"), *(F.round(F.avg(c), 4).alias(f"macro_{c}") for c in ("precision", "recall", "f1")))


def contributor_evaluation(risks: DataFrame, labels: DataFrame) -> DataFrame:
    """How many compromised contributors were flagged and clean ones left alone; labels: contributor, is_compromised."""
    rows = labels.join(risks.select("contributor", (F.col("risk_level") != "CLEAN").alias("flagged")), "contributor", "left").fillna(False, "flagged")
    bad, hit = F.col("is_compromised"), F.col("flagged")
    return rows.agg(
        F.count_if(bad).alias("compromised"),
        F.count_if(bad & hit).alias("compromised_flagged"),
        F.count_if(~bad & ~hit).alias("clean_kept"),
        F.round(F.coalesce(F.try_divide(F.count_if(~bad & hit), F.count_if(~bad)), F.lit(0.0)), 4).alias("clean_fpr"),
        F.round(F.try_divide(F.count_if(bad & hit), F.count_if(bad)), 4).alias("detection_rate"),
    )


def quantile_threshold(values: DataFrame, column: str, q: float = 0.99, margin: float = 0.5, floor: float = 5.5) -> DataFrame:
    """One row: the exact quantile (linear between ranks) and the threshold, margin above it and at least floor."""
    p = F.percentile(column, F.lit(q))
    return values.agg(F.count(column).alias("n"), F.round(p, 4).alias("quantile"), F.round(F.greatest(F.lit(floor), p + margin), 4).alias("threshold"))


def hash_order(key: str, seed: int) -> Column:
    """A text whose order is a fixed shuffle of the keys, the same in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def three_way_split(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """rows with part: calibration and clean (a quarter each), attack_1 to attack_5 (the rest in even parts).

    Parts follow the first digits of the keyed hash, so that a row's part needs no other row and stays when rows are added.
    """
    h = F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("long")
    share = h / F.lit(float(1 << 32))
    attack = F.concat(F.lit("attack_"), (F.floor((share - 0.5) * 10) + 1).cast("string"))
    return rows.withColumn("part", F.when(share < 0.25, "calibration").when(share < 0.5, "clean").otherwise(attack))


def exact_split(rows: DataFrame, key: str, seed: int = 42, parts: int = 4) -> DataFrame:
    """rows with part from 1: sizes that differ by one at most, by hash order; for benchmark sets of bounded size (one sorted window)."""
    return rows.withColumn("part", F.ntile(parts).over(W.orderBy(hash_order(key, seed), key)))


def deterministic_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows of least keyed hash."""
    return rows.orderBy(hash_order(key, seed), key).limit(n)


def leakage(parts: DataFrame, name: str, member: str) -> DataFrame:
    """For each pair of parts the number of base names that both have; every pair is checked. parts: name, member (a path)."""
    each = parts.select(F.col(name).alias("p"), C.base_name(F.col(member)).alias("m")).distinct()
    members = each.groupBy("m").agg(F.array_sort(F.collect_set("p")).alias("ps"))  # at most as long as there are parts
    pairs = members.select(F.explode(F.flatten(F.transform("ps", lambda x: F.transform(F.filter("ps", lambda y: y > x), lambda y: F.struct(x.alias("left_part"), y.alias("right_part")))))).alias("q"))
    return pairs.groupBy("q.left_part", "q.right_part").agg(F.count("*").alias("shared"))


def assert_disjoint(parts: DataFrame, name: str, member: str) -> DataFrame:
    """parts, if no two of them share a member; an error that names the first pair otherwise."""
    first = leakage(parts, name, member).orderBy("left_part", "right_part").first()
    if first:
        raise ValueError(f"{first.left_part} and {first.right_part} share {first.shared} members")
    return parts


def preferred_first(rows: DataFrame, key: str, preferred: Column, order: list[str]) -> DataFrame:
    """For each key one row: the first (by order) that is preferred, or the first at all."""
    rank = F.struct(F.when(preferred, 0).otherwise(1).alias("_p"), *order)
    return rows.groupBy(key).agg(F.min_by(F.struct(*(c for c in rows.columns if c != key)), rank).alias("_r")).select(key, "_r.*")


def benchmark_errors(manifest: DataFrame, parts: DataFrame, expected: list[str], files: DataFrame | None = None) -> DataFrame:
    """(subject, rule) of everything wrong with a benchmark: broken manifest rules, pairs of parts that share members, and expected parts without any.

    parts: part, member (a path).
    """
    rules = manifest_errors(manifest, files).select(F.col("sample_id").cast("string").alias("subject"), "rule")
    shared = leakage(parts, "part", "member").select(F.concat_ws("+", "left_part", "right_part").alias("subject"), F.lit("leakage").alias("rule"))
    wanted = manifest.sparkSession.createDataFrame([(e,) for e in expected], "subject string")
    missing = wanted.join(parts.select(F.col("part").cast("string").alias("subject")).distinct(), "subject", "left_anti").select("subject", F.lit("missing_part").alias("rule"))
    return rules.unionByName(shared).unionByName(missing)


#: Attack and shift types that a manifest may name; fixed values.
ATTACKS = ["label_flip", "systematic_mislabel", "near_duplicate_flood", "ood_insertion", "corner", "blended", "spectral"]
SHIFTS = ["illumination", "blur", "noise", "weather", "compression"]


def manifest_errors(manifest: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(sample_id, rule) of every broken rule of a benchmark manifest."""
    attacked, shifted = F.col("is_attacked"), F.col("is_shifted")
    label_attack = F.col("attack_type").isin("label_flip", "systematic_mislabel")
    counted = manifest.withColumn("_n", F.count("*").over(W.partitionBy("sample_id")))
    if files is None:
        counted = counted.withColumn("_there", F.lit(True))
    else:
        counted = counted.join(files.select(F.col("path").alias("current_image")).distinct().withColumn("_there", F.lit(True)), "current_image", "left").fillna(False, "_there")
    rules = {
        "duplicate_id": F.col("_n") > 1,
        "invalid_attack_type": attacked & ~F.coalesce(F.col("attack_type").isin(ATTACKS), F.lit(False)),
        "attack_type_without_attack": ~attacked & F.col("attack_type").isNotNull(),
        "invalid_shift_type": shifted & ~F.coalesce(F.col("shift_type").isin(SHIFTS), F.lit(False)),
        "attacked_and_shifted": attacked & shifted,
        "missing_original": F.coalesce(F.trim("original_image"), F.lit("")) == "",
        "label_unchanged": attacked & F.coalesce(label_attack, F.lit(False)) & F.col("original_label").eqNullSafe(F.col("modified_label")),
        "missing_parameters": attacked & (F.coalesce(F.length("parameters"), F.lit(0)) == 0),
        "missing_file": ~F.col("_there"),
    }
    broken = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules.items())))
    return counted.select("sample_id", F.explode(broken).alias("rule"))


def attack_summary(manifest: DataFrame) -> DataFrame:
    """Samples by attack, shift_<type> or clean."""
    kind = F.when(F.col("is_attacked"), F.col("attack_type")).when(F.col("is_shifted"), F.concat(F.lit("shift_"), F.col("shift_type"))).otherwise("clean")
    return manifest.groupBy(kind.alias("kind")).agg(F.count("*").alias("samples"))
