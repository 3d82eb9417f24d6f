"""Model integrity: artefact digests, layer statistics, behavioural fingerprints, comparison, trigger probes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions import columns as C

#: File formats by extension; fixed values.
FORMATS = {"pt": "pytorch_pt", "pth": "pytorch_pt", "safetensors": "pytorch_pt", "onnx": "onnx", "torchscript": "torchscript"}


def artefact_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, format (null where unknown), size_bytes and sha256 of every file under path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    known = F.create_map(*(F.lit(x) for kv in FORMATS.items() for x in kv))
    return files.select("path", F.try_element_at(known, F.lower(F.regexp_extract("path", r"\.([^.\\/]+)$", 1))).alias("format"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def digest_check(digest: Column, reference: Column) -> Column:
    """PASS, FAIL, or UNVERIFIED without a reference."""
    return F.when(reference.isNull(), "UNVERIFIED").when(F.lower(F.trim(digest)) == F.lower(F.trim(reference)), "PASS").otherwise("FAIL")


def layer_statistics(weights: DataFrame) -> DataFrame:
    """layer, n, mean, std (population), l2 and zero_ratio. weights: layer, value."""
    v = F.col("value")
    return weights.groupBy("layer").agg(F.count("*").alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_pop(v), 4).alias("std"), F.round(F.sqrt(F.sum(v * v)), 4).alias("l2"), F.round(F.avg(F.when(F.abs(v) < 1e-8, 1.0).otherwise(0.0)), 4).alias("zero_ratio"))


def layer_anomalies(statistics: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """statistics with deviation from the reference's spread (same layer and size) and is_anomalous."""
    rows = statistics
    if reference is None:
        rows = rows.withColumn("deviation", F.lit(0.0))
    else:
        rows = rows.join(reference.select("layer", "n", F.col("std").alias("_r")), ["layer", "n"], "left")
        rows = rows.withColumn("deviation", F.round(F.coalesce(F.abs(F.col("std") - F.col("_r")) / (F.col("_r") + 1e-7), F.lit(0.0)), 4)).drop("_r")
    odd = (F.col("std") > 1) | (F.col("zero_ratio") > 0.95) | ((F.col("l2") > 50) & F.contains(F.col("layer"), F.lit("weight"))) | (F.col("deviation") > 3)
    return rows.withColumn("is_anomalous", odd)


def layer_rollup(layers: DataFrame) -> DataFrame:
    share = F.try_divide(F.count_if("is_anomalous"), F.count("*"))
    level = F.when(share >= 0.3, "HIGH").when(share >= 0.1, "MEDIUM").otherwise("LOW")
    return layers.agg(F.count("*").alias("layers"), F.sum("n").alias("parameters"), F.count_if("is_anomalous").alias("anomalous_layers"), F.round(F.avg(F.when(F.col("zero_ratio") > 0.95, 1.0).otherwise(0.0)), 4).alias("dead_ratio"), F.round(share, 4).alias("anomaly_ratio"), level.alias("risk"))


def predict(samples: DataFrame, predictor: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """sample_id and logits by a caller's function over batches; rows for which it fails are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                yield pd.DataFrame({"sample_id": batch["sample_id"], "logits": predictor(batch)})
            except Exception:  # one bad sample must not cost its batch
                for k in range(len(batch)):
                    one = batch.iloc[k : k + 1]
                    try:
                        yield pd.DataFrame({"sample_id": one["sample_id"], "logits": predictor(one)})
                    except Exception:  # noqa: S112  counted by the caller as missing
                        continue

    return samples.mapInPandas(run, "sample_id long, logits array<double>")


def linear_logits(vectors: DataFrame, weights: DataFrame, scale: float = 10.0) -> DataFrame:
    """Logits of each sample against each class' weight vector, in class order; the classes are one broadcast row."""
    matrix = weights.agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("_w"))
    return vectors.join(F.broadcast(matrix)).select("sample_id", F.transform("_w", lambda w: F.round(F.lit(scale) * C.dot(F.col("vector"), w["centroid"]), 6)).alias("logits"))


def predictions(logits: DataFrame) -> DataFrame:
    """sample_id, predicted, confidence and entropy."""
    rows = logits.withColumn("_p", C.softmax(F.col("logits")))
    return rows.select("sample_id", C.argmax(F.col("_p")).alias("predicted"), F.round(F.array_max("_p"), 6).alias("confidence"), F.round(C.entropy(F.col("_p")), 6).alias("entropy"))


def class_distribution(found: DataFrame) -> DataFrame:
    """predicted, samples and share of all samples."""
    total = found.agg(F.count("*").alias("_n"))
    return found.groupBy("predicted").agg(F.count("*").alias("samples")).join(F.broadcast(total)).select("predicted", "samples", F.round(F.col("samples") / F.col("_n"), 4).alias("share"))


def fingerprint(found: DataFrame) -> DataFrame:
    """One row: samples, classes, mean confidence and entropy, stability, top class share, is_anomalous."""
    classes = found.groupBy("predicted").agg(F.count("*").alias("n"), F.sum("confidence").alias("c"), F.sum("entropy").alias("e"), F.sum(F.col("confidence") * F.col("confidence")).alias("q"))
    row = classes.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.max("n").alias("top"), F.sum("c").alias("c"), F.sum("e").alias("e"), F.sum("q").alias("q"))
    n = F.col("n")
    conf, ent, top = F.col("c") / n, F.col("e") / n, F.col("top") / n
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / n - conf * conf))
    odd = (conf < 0.30) | ((F.col("k") > 1) & (top > 0.95)) | ((ent < 0.30) & (F.col("k") > 1))
    return row.select(n.alias("samples"), F.col("k").alias("classes"), F.round(conf, 4).alias("mean_confidence"), F.round(ent, 4).alias("mean_entropy"), F.round(C.clamp(1 - spread), 4).alias("stability"), F.round(top, 4).alias("top_class_share"), F.coalesce(odd, F.lit(False)).alias("is_anomalous"))


def compare(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row: agreement on common samples, changes of confidence and entropy, deviation and is_anomalous."""
    other = candidate.select("sample_id", F.col("predicted").alias("_p"), F.col("confidence").alias("_c"), F.col("entropy").alias("_e"))
    both = reference.join(other, "sample_id")
    row = both.agg(F.count("*").alias("samples"), F.avg(F.when(F.col("predicted") == F.col("_p"), 1.0).otherwise(0.0)).alias("a"), F.avg(F.abs(F.col("confidence") - F.col("_c"))).alias("c"), F.avg(F.abs(F.col("entropy") - F.col("_e"))).alias("e"))
    deviation = 0.60 * (1 - F.col("a")) + 0.25 * F.least(F.col("c"), F.lit(1.0)) + 0.15 * F.least(F.col("e") / 2, F.lit(1.0))
    return row.select("samples", F.round("a", 4).alias("agreement"), F.round("c", 4).alias("confidence_change"), F.round("e", 4).alias("entropy_change"), F.round(deviation, 4).alias("deviation"), (F.round(deviation, 4) >= 0.20).alias("is_anomalous"))


def probe(clean: DataFrame, triggered: DataFrame, target: int) -> DataFrame:
    """One row: share of samples whose class a trigger changes, share that it moves to the target, mean confidence gain, score and is_suspicious."""
    other = triggered.select("sample_id", F.col("predicted").alias("_p"), F.col("confidence").alias("_c"))
    row = clean.join(other, "sample_id").agg(
        F.count("*").alias("samples"),
        F.avg(F.when(F.col("predicted") != F.col("_p"), 1.0).otherwise(0.0)).alias("change"),
        F.avg(F.when((F.col("_p") == target) & (F.col("predicted") != target), 1.0).otherwise(0.0)).alias("hit"),
        F.avg(F.col("_c") - F.col("confidence")).alias("gain"),
    )
    score = 0.50 * F.col("change") + 0.35 * F.col("hit") + 0.15 * C.clamp(F.col("gain"))
    return row.select("samples", F.round("change", 4).alias("change_rate"), F.round("hit", 4).alias("target_rate"), F.round("gain", 4).alias("mean_gain"), F.round(score, 4).alias("score"), (F.round(score, 4) >= 0.50).alias("is_suspicious"))


def assessment(scenarios: DataFrame) -> DataFrame:
    """Evidence, disposition and confidence of each scenario from its flags: hash_failed, params_changed, trigger_found, behaviour_changed (null: not tested).

    Unlike a verdict by name, nothing here looks at the scenario's label.
    """
    weights = {"hash_failed": 0.30, "params_changed": 0.30, "trigger_found": 0.40, "behaviour_changed": 0.20}
    raw = sum((F.when(F.coalesce(F.col(k), F.lit(False)), w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    evidence = F.round(F.least(F.lit(1.0), raw), 4)
    coverage = sum((F.col(k).isNotNull().cast("double") for k in weights), F.lit(0.0)) / len(weights)
    worst = F.coalesce(F.col("hash_failed"), F.lit(False)) | F.coalesce(F.col("trigger_found"), F.lit(False))
    disposition = F.when((evidence >= 0.60) | worst, "QUARANTINE").when(evidence >= 0.20, "REVIEW").otherwise("ACCEPT")
    return scenarios.select("scenario", evidence.alias("evidence"), disposition.alias("disposition"), F.round(0.75 * evidence + 0.25 * coverage, 4).alias("confidence"))


def activation_stats(activations: DataFrame) -> DataFrame:
    """For each layer of activations (layer, value): values, mean, population deviation, share of zeros, least and greatest. Nulls count as no value."""
    value = F.col("value")
    return activations.groupBy("layer").agg(
        F.count("value").alias("n_values"),
        F.round(F.avg("value"), 6).alias("mean"),
        F.round(F.stddev_pop("value"), 6).alias("std"),
        F.round(F.count_if(value == 0) / F.count("value"), 6).alias("zero_share"),
        F.min("value").alias("least"),
        F.max("value").alias("greatest"),
    )
