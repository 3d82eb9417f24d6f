"""Bound and signed inference records: canonical forms, verification, replay and sequence rules."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.functions import columns as C

#: Stands for a null part of a binding, so that no two records with nulls at different places have one hash.
NULL_SIGN = "\x01"
DEMO_KEY = b"demo-key"
KEY_VARIABLE, KEY_FILE_VARIABLE = "ATTESTRY_KEY", "ATTESTRY_KEY_FILE"


def resolve_key(key: str | None = None, key_file: str | None = None) -> bytes:
    """A key file (argument, else environment), then the key given, then the environment's, then the demo key.

    A key and a key file at once, or an empty file, are errors.
    """
    path = key_file or os.environ.get(KEY_FILE_VARIABLE)
    if key is not None and path:
        raise ValueError("give a key or a key file, not both")
    if path:
        found = Path(path).read_bytes().strip()
        if not found:
            raise ValueError("the key file is empty")
        return found
    return (key or os.environ.get(KEY_VARIABLE) or "").encode() or DEMO_KEY


def canonical_predictions(predictions: Column) -> Column:
    """Compact JSON of array<struct<box, confidence, category_id, category_name>>, in an order that doesn't depend on the input's.

    Boxes to 4 places, confidences to 6, names stripped; by category, name, falling confidence and box.
    """
    rows = F.transform(
        predictions,
        lambda p: F.struct(
            F.transform(p["box"], lambda x: F.bround(x, 4)).alias("box"),
            p["category_id"].alias("category_id"),
            F.trim(p["category_name"]).alias("category_name"),
            F.bround(p["confidence"], 6).alias("confidence"),
        ),
    )
    keyed = F.transform(rows, lambda p: F.struct(p["category_id"].alias("a"), p["category_name"].alias("b"), (-p["confidence"]).alias("c"), p["box"].alias("d"), p.alias("p")))
    return F.to_json(F.transform(F.array_sort(keyed), lambda k: k["p"]))


@F.udf(T.StringType())
def canonical_config(text):
    """JSON of any nesting with its keys sorted, compact; what isn't JSON stays as it is. Python, as no built-in sorts keys at all depths."""
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), default=str)
    except ValueError:
        return text


def binding_hash(image: Column, model: Column, config: Column, predictions: Column, timestamp: Column, nonce: Column, sequence: Column, inference_config: Column | None = None) -> Column:
    """SHA-256 over the parts joined by |, digests in lower case; a null part is a control sign, but a null inference config is left out."""
    parts = [F.lower(image), F.lower(model), F.lower(config), F.lower(predictions), timestamp, nonce, sequence.cast("string")]
    there = [F.coalesce(p, F.lit(NULL_SIGN)) for p in parts]
    return F.sha2(F.concat_ws("|", *there, *([] if inference_config is None else [F.lower(inference_config)])), 256)


def model_digest(value: Column) -> Column:
    """A digest given as text, stripped and in lower case."""
    return F.lower(F.trim(value))


def bind(records: DataFrame, key: bytes) -> DataFrame:
    """records with predictions_hash, binding_hash and signature.

    records: image_hash, model_digest, config_hash, predictions_json, ts_micros, nonce, sequence. Times are whole
    microseconds, so that no text form of a float enters a hash.
    """
    hashed = records.withColumn("predictions_hash", F.sha2("predictions_json", 256))
    bound = hashed.withColumn("binding_hash", binding_hash(F.col("image_hash"), model_digest(F.col("model_digest")), F.col("config_hash"), F.col("predictions_hash"), F.col("ts_micros").cast("string"), F.col("nonce"), F.col("sequence")))
    return bound.withColumn("signature", C.hmac_sha256(key, F.col("binding_hash")))


#: Fields compared with the original record.
COMPARED = ["image_hash", "model_digest", "config_hash", "predictions_json", "ts_micros", "nonce", "sequence", "predictions_hash", "binding_hash", "signature"]


def verify(records: DataFrame, key: bytes, originals: DataFrame | None = None) -> DataFrame:
    """record_id, passed, tampered_fields and checks (name to result) of every record, from the record alone and, if given, from its original.

    Repeated ids are each judged; of several originals of an id the first by sequence counts.
    """
    again = {c: f"_{c}" for c in ("predictions_hash", "binding_hash", "signature")}
    given = records.select("*", *(F.col(c).alias(f"_given_{c}") for c in again))
    fresh = bind(given, key).withColumnsRenamed(again)
    rows = fresh.withColumnsRenamed({f"_given_{c}": c for c in again})
    checks = {c: F.coalesce(F.lower(F.col(c)) == F.lower(F.col(n)), F.lit(False)) for c, n in again.items()}
    checks["ts_micros"] = F.col("ts_micros").isNotNull() & (F.col("ts_micros") > 0)
    checks["nonce"] = F.coalesce(F.length(F.trim("nonce")) > 0, F.lit(False))
    checks["sequence"] = F.coalesce(F.col("sequence") >= 0, F.lit(False))
    changed = F.array().cast("array<string>")
    if originals is not None:
        one = originals.groupBy("record_id").agg(F.min(F.struct("sequence", *(F.col(c).alias(f"_o_{c}") for c in COMPARED))).alias("_o")).select("record_id", *(f"_o._o_{c}" for c in COMPARED))
        rows = rows.join(one, "record_id", "left")
        known = F.coalesce(*(F.col(f"_o_{c}").cast("string") for c in COMPARED)).isNotNull()
        changed = F.when(known, F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"_o_{c}")), F.lit(c)) for c in COMPARED)))).otherwise(changed)
    failed = F.array_compact(F.array(*(F.when(~ok, F.lit(name)) for name, ok in checks.items())))
    tampered = F.array_sort(F.array_union(failed, changed))
    return rows.select("record_id", (F.size(tampered) == 0).alias("passed"), tampered.alias("tampered_fields"), F.map_from_arrays(F.array(*(F.lit(k) for k in checks)), F.array(*checks.values())).alias("checks"))


def reused(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """events with is_replay: whether an earlier event (by order) has the same keys."""
    return events.withColumn("is_replay", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) > 1)


def _seen_before(records: DataFrame, c: str, order: str, counts: Column | None = None) -> Column:
    """Whether an earlier record (of those that count) has the same value; null values are spread and never seen."""
    spread = F.when(F.col(c).isNull(), F.xxhash64(*records.columns))
    earlier = W.partitionBy(c, spread).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return F.col(c).isNotNull() & (F.coalesce(F.count_if(F.lit(True) if counts is None else counts).over(earlier), F.lit(0)) > 0)


#: The checks of a record, in the order in which they are made; fixed values.
CHECKS = ["image", "model", "config", "inference_config", "predictions", "timestamp", "sequence", "binding", "signature", "replay"]


def full_verification(records: DataFrame, key: bytes, order: str) -> DataFrame:
    """record_id, passed, tampered, replayed, tampered_fields and checks of every record.

    Besides the columns of ``bind`` with their hashes, records have what they are held against, null where nothing is
    known, and then nothing is judged: observed_image_hash, expected_model_digest, config_json, inference_config_json and
    inference_config_hash (one without the other fails), ts_iso (UTC, to the second), expected_sequence. A record is a
    replay if an earlier intact one (by order) has its id, nonce or binding.
    """
    same = lambda a, b: F.lower(a) == F.lower(b)
    fresh = binding_hash(F.col("image_hash"), model_digest(F.col("model_digest")), F.col("config_hash"), F.sha2("predictions_json", 256), F.col("ts_micros").cast("string"), F.col("nonce"), F.col("sequence"), F.col("inference_config_hash"))
    rows = records.withColumn("_fresh", fresh)
    inference = F.col("inference_config_json"), F.col("inference_config_hash")
    judged = {
        "image": same(F.col("observed_image_hash"), F.col("image_hash")),
        "model": same(model_digest(F.col("expected_model_digest")), model_digest(F.col("model_digest"))),
        "config": same(F.sha2("config_json", 256), F.col("config_hash")),
        "inference_config": F.when(inference[0].isNull() & inference[1].isNull(), F.lit(None)).otherwise(F.coalesce(same(F.sha2(inference[0], 256), inference[1]), F.lit(False))),
        "predictions": F.coalesce(same(F.sha2("predictions_json", 256), F.col("predictions_hash")), F.lit(False)),
        "timestamp": F.col("ts_micros").isNotNull() & F.coalesce(F.date_format(F.timestamp_micros("ts_micros"), "yyyy-MM-dd'T'HH:mm:ss") == F.col("ts_iso"), F.col("ts_iso").isNull()),
        "sequence": F.col("sequence") == F.col("expected_sequence"),
        "binding": F.coalesce(same(F.col("_fresh"), F.col("binding_hash")), F.lit(False)),
        "signature": F.coalesce(same(C.hmac_sha256(key, F.col("_fresh")), F.col("signature")), F.lit(False)),
    }
    rows = rows.withColumns({f"_{n}": c for n, c in judged.items()})
    intact = F.coalesce(F.expr(" AND ".join(f"coalesce(_{n}, true)" for n in judged)), F.lit(True))
    rows = rows.withColumn("_intact", intact)
    for c in ("record_id", "nonce", "binding_hash"):
        rows = rows.withColumn(f"_seen_{c}", _seen_before(rows, c, order, F.col("_intact")))
    rows = rows.withColumn("_replay", ~(F.col("_seen_record_id") | F.col("_seen_nonce") | F.col("_seen_binding_hash")))
    failed = F.array_compact(F.array(*(F.when(~F.col(f"_{n}"), F.lit(n)) for n in CHECKS)))
    checks = F.map_from_arrays(F.array(*map(F.lit, CHECKS)), F.array(*(F.col(f"_{n}") for n in CHECKS)))
    return rows.select("record_id", (F.size(failed) == 0).alias("passed"), (~F.col("_intact")).alias("tampered"), (~F.col("_replay")).alias("replayed"), failed.alias("tampered_fields"), checks.alias("checks"))


def record_counts(verified: DataFrame) -> DataFrame:
    """Records, and how many of them passed, were replayed, or were tampered with and not replayed."""
    return verified.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if("replayed").alias("replayed"), F.count_if(~F.col("passed") & ~F.col("replayed")).alias("tampered"))


def replay_reason(records: DataFrame, order: str) -> DataFrame:
    """records with reason: record_id, nonce or binding seen before, the first of these that holds, or null."""
    rows = records
    for c in ("record_id", "nonce", "binding_hash"):
        rows = rows.withColumn(f"_{c}", _seen_before(rows, c, order))
    reason = F.when(F.col("_record_id"), "record_id").when(F.col("_nonce"), "nonce").when(F.col("_binding_hash"), "binding_hash")
    return rows.withColumn("reason", reason).drop("_record_id", "_nonce", "_binding_hash")


def sequence_breaks(rows: DataFrame, key: str, sequence: str, order: list[str]) -> DataFrame:
    """For each key: rows, neighbours whose sequence isn't the one before plus one, and the first such place."""
    w = W.partitionBy(key).orderBy(*order)
    placed = rows.select(key, F.row_number().over(w).alias("_pos"), (F.col(sequence) - F.lag(sequence).over(w)).alias("_step"))
    broken = F.col("_step").isNotNull() & (F.col("_step") != 1)
    return placed.groupBy(key).agg(F.count("*").alias("n_rows"), F.count_if(broken).alias("breaks"), F.min(F.when(broken, F.col("_pos"))).alias("first_break"))


def accepted_sequence(rows: DataFrame, key: str, sequence: str, order: list[str]) -> DataFrame:
    """For each key, the registry's fold: the first row is accepted, then only the last accepted sequence plus one; rejected rows don't advance it."""
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(sequence).cast("long").alias("_s")))).alias("_rows"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).cast("long").alias("accepted"), F.lit(0).cast("long").alias("rejected"))

    def step(acc: Column, row: Column) -> Column:
        ok = acc["last"].isNull() | (row["_s"] == acc["last"] + 1)
        return F.struct(F.when(ok, row["_s"]).otherwise(acc["last"]).alias("last"), (acc["accepted"] + ok.cast("long")).alias("accepted"), (acc["rejected"] + (~ok).cast("long")).alias("rejected"))

    return listed.select(key, F.aggregate("_rows", start, step).alias("_f")).select(key, F.col("_f.accepted").alias("accepted"), F.col("_f.rejected").alias("rejected"), F.col("_f.last").alias("last_sequence"))


def chain_checks(records: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adjacent-row checks of an inference chain: sequence_ok, time_ok and nonce_ok for each record of its chain."""
    w = W.partitionBy(key).orderBy(*order)
    first = F.row_number().over(w) == 1
    nonce = F.row_number().over(W.partitionBy(key, "nonce").orderBy(*order)) == 1
    return records.select(
        "record_id",
        key,
        (first | F.coalesce(F.col("sequence") == F.lag("sequence").over(w) + 1, F.lit(False))).alias("sequence_ok"),
        (first | F.coalesce(F.col("ts_micros") >= F.lag("ts_micros").over(w), F.lit(False))).alias("time_ok"),
        nonce.alias("nonce_ok"),
    )
