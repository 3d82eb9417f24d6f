"""Streaming counterparts: replay and sequence rules with state, event-time windows, batch anchoring."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

VERDICT = "key string, event_id long, sequence long, accepted boolean, reason string"


def _judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Accepts the first sequence, then only the next one; a rejected event changes nothing."""
    last = state.get[0] if state.exists else None
    out = []
    rows = pd.concat(list(batches)).sort_values(["sequence", "event_id"]) if not state.hasTimedOut else pd.DataFrame()
    for event_id, sequence in rows[["event_id", "sequence"]].itertuples(index=False) if len(rows) else []:
        ok = last is None or sequence == last + 1
        reason = None if ok else "replay" if sequence <= last else "gap"
        last = sequence if ok else last
        out.append((key[0], event_id, sequence, ok, reason))
    if state.hasTimedOut:
        state.remove()
    elif last is not None:
        state.update((int(last),))
    yield pd.DataFrame(out, columns=["key", "event_id", "sequence", "accepted", "reason"])


def sequence_guard(events: DataFrame) -> DataFrame:
    """A verdict for each event of a stream (key, event_id, sequence): contiguous sequences for each key, kept as one number of state."""
    return events.groupBy("key").applyInPandasWithState(_judge, VERDICT, "last long", "append", GroupStateTimeout.NoTimeout)


def fresh_nonces(events: DataFrame, time: str, nonces: list[str], delay: str = "1 hour") -> DataFrame:
    """Events whose nonce wasn't seen within the delay; the state is bounded by the watermark."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(nonces)


def windowed(events: DataFrame, time: str, width: str, slide: str | None = None, delay: str = "1 hour", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and sums in tumbling or sliding event-time windows; later rows than the delay are dropped."""
    span = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, delay).groupBy(span.alias("w"), *by).agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "events", "total")


def sessions(events: DataFrame, time: str, gap: str, key: str, delay: str = "1 hour") -> DataFrame:
    """Sessions for each key, ended by a gap."""
    return events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def anchor_batches(stream: DataFrame, path: str, leaf: str, index: str, batch_rows: int = 1024):
    """foreachBatch writer that appends a Merkle root for each group of batch_rows leaves of a micro-batch; a batch done twice is written over."""
    from attestry.operators.ledger import merkle_roots

    def write(rows: DataFrame, epoch: int) -> None:
        grouped = rows.withColumn("batch", F.pmod(F.xxhash64(index), F.greatest(F.lit(1), F.lit(rows.count() // batch_rows))))
        merkle_roots(grouped, "batch", index, leaf).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write)
