from pyspark.sql import functions as F

from attestry.operators import ledger
from attestry.streaming import replay

EVENTS = [("a", 1, 5), ("a", 2, 6), ("a", 3, 6), ("a", 4, 8), ("b", 5, 1), ("b", 6, 2)]


def run(stream, base, name):
    q = stream.writeStream.format("parquet").option("path", f"{base}/{name}").option("checkpointLocation", f"{base}/{name}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(f"{base}/{name}")


def test_sequence_guard(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.createDataFrame(EVENTS, "key string, event_id long, sequence long").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("key string, event_id long, sequence long").parquet(src)
    got = {r.event_id: (r.accepted, r.reason) for r in run(replay.sequence_guard(stream), tmp_path, "guard").collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, "replay"), 4: (False, "gap"), 5: (True, None), 6: (True, None)}


def test_fresh_nonces(spark, tmp_path):
    src = f"{tmp_path}/in"
    rows = spark.range(6).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"), (F.col("id") % 3).alias("nonce"))
    rows.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, nonce long").parquet(src)
    assert run(replay.fresh_nonces(stream, "ts", ["nonce"]), tmp_path, "fresh").count() == 3


def test_anchor_batches(spark, tmp_path):
    src = f"{tmp_path}/in"
    leaves = spark.range(10).select("id", F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    leaves.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("id long, leaf string").parquet(src)
    q = replay.anchor_batches(stream, f"{tmp_path}/anchors", "leaf", "id").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/anchors").first()
    want = ledger.merkle_roots(leaves.withColumn("batch", F.lit(0)), "batch", "id", "leaf").first()
    assert got.root == want.root and got.n_leaves == 10


def test_windows_and_sessions(spark):
    rows = spark.createDataFrame([(0, "u", 1.0), (30, "u", 2.0), (4000, "u", 4.0)], "s long, key string, value double").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.total for r in replay.windowed(rows, "ts", "1 hour").collect()) == [3.0, 4.0]
    assert sorted(r.events for r in replay.sessions(rows, "ts", "10 minutes", "key").collect()) == [1, 2]
