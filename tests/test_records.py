import json

import pytest
from pyspark.sql import functions as F

from attestry.operators import evaluation as E
from attestry.operators import ledger as L
from attestry.operators import provenance as P
from attestry.sources import sinks

RECORD = "record_id string, image_hash string, model_digest string, config_hash string, predictions_json string, ts_micros long, nonce string, sequence long"


def signed(spark, rows):
    return P.bind(spark.createDataFrame(rows, RECORD), P.DEMO_KEY)


def test_nulls_at_different_places_have_different_bindings(spark):
    rows = signed(spark, [("a", "i", "m", "c", "[]", None, "7", 1), ("b", "i", "m", "c", "[]", 7, None, 1)]).collect()
    assert rows[0].binding_hash != rows[1].binding_hash


def test_repeated_ids_are_each_verified(spark):
    good = signed(spark, [("a", "i", "m", "c", "[]", 5, "n", k) for k in range(3)])
    assert P.verify(good, P.DEMO_KEY).count() == 3
    got = P.verify(good, P.DEMO_KEY, good).orderBy("passed").collect()
    assert len(got) == 3 and [r.passed for r in got] == [False, False, True]  # the first by sequence is the original


def test_replays_count_intact_earlier_records_only(spark):
    rows = signed(spark, [("a", "i", "m", "c", "[]", 5, None, 1)] * 2 + [("b", "i", "m", "c", "[]", 5, None, 2)])
    more = ["observed_image_hash", "expected_model_digest", "config_json", "inference_config_json", "inference_config_hash", "ts_iso"]
    rows = rows.select("*", *(F.lit(None).cast("string").alias(c) for c in more), F.lit(None).cast("long").alias("expected_sequence"), F.monotonically_increasing_id().alias("at"))
    got = P.full_verification(rows, P.DEMO_KEY, "at")
    assert sorted((r.record_id, r.passed, r.replayed) for r in got.collect()) == [("a", False, True), ("a", True, False), ("b", True, False)]
    assert tuple(P.record_counts(got).first()) == (3, 2, 1, 0)
    broken = P.full_verification(rows.withColumn("signature", F.lit("x")), P.DEMO_KEY, "at")
    assert tuple(P.record_counts(broken).first()) == (3, 0, 0, 3)
    assert P.full_verification(rows.limit(0), P.DEMO_KEY, "at").count() == 0


def test_event_hash_leaves_out_what_the_ledger_sets(spark):
    e = L.model_registered(spark.createDataFrame([("m", "1", " AB ", 5_000_000)], "model_id string, version string, model_digest string, ts_micros long"))
    a = e.select(L.event_hash(e)).first()[0]
    more = e.withColumn("tx_id", F.lit("t")).withColumn("block_number", F.lit(3))
    assert a == more.select(L.event_hash(more)).first()[0]
    row = e.first()
    assert (row.event_id, row.hash, json.loads(row.metadata)) == ("EVT-MODEL-m-5", "ab", {"version": "1"})


def test_benchmark_errors(spark):
    schema = "sample_id long, is_attacked boolean, is_shifted boolean, attack_type string, shift_type string, original_image string, current_image string, original_label string, modified_label string, parameters string"
    manifest = spark.createDataFrame([(1, False, False, None, None, "o", "c", "x", "x", "")] * 2, schema)
    parts = spark.createDataFrame([("train", "p/a.png"), ("test", "q/a.png"), ("test", "q/b.png")], "part string, member string")
    got = sorted(map(tuple, E.benchmark_errors(manifest, parts, ["train", "drift"]).collect()))
    assert got == [("1", "duplicate_id"), ("1", "duplicate_id"), ("drift", "missing_part"), ("test+train", "leakage")]
    with pytest.raises(ValueError):
        E.assert_disjoint(parts, "part", "member")
    assert E.assert_disjoint(parts.filter("part = 'test'"), "part", "member").count() == 2


def test_a_corrupt_ledger_is_an_error(spark, tmp_path):
    path = tmp_path / "ledger.json"
    path.write_text('{"event_id": "a"}\n{"event_id": \n')
    with pytest.raises(Exception):  # noqa: B017
        sinks.load_ledger(spark, f"file://{path}", "event_id string").collect()
    path.write_text('{"event_id": "a"}\n')
    assert sinks.load_ledger(spark, f"file://{path}", "event_id string").count() == 1
