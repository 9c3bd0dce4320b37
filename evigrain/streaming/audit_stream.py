"""Structured Streaming forms: appending to hash chains, replay guards, rates and state by review."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.audit import GENESIS

CHAINED = "review_id long, seq long, event_id string, body string, previous_hash string, event_hash string, accepted boolean"


def append_stream(events: DataFrame) -> DataFrame:
    """Chain a stream of (review_id, seq, event_id, body) per review, across batches.

    The state of a review is its head and last seq. An event whose seq is not above the
    last one came late or twice: it passes through with accepted = false and no hashes.
    """

    def chain(key, frames, state: GroupState):
        head, last = state.get if state.exists else (GENESIS, -1)
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for seq, event_id, body in rows[["seq", "event_id", "body"]].itertuples(index=False):
            if seq <= last:
                out.append((key[0], seq, event_id, body, None, None, False))
                continue
            now = hashlib.sha256(f"{head}\n{body}".encode()).hexdigest()
            out.append((key[0], seq, event_id, body, head, now, True))
            head, last = now, int(seq)
        state.update((head, last))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHAINED.split(", ")])

    return events.groupBy("review_id").applyInPandasWithState(chain, CHAINED, "head string, last long", "append", GroupStateTimeout.NoTimeout)


def type_counts_stream(events: DataFrame) -> DataFrame:
    """Running counts by review and event type (update or complete mode)."""
    return events.groupBy("review_id", "event_type").agg(F.count("*").alias("n"))


def guarded_stream(events: DataFrame, at: str, key: list[str], delay: str = "10 minutes") -> DataFrame:
    """Each key's first event within the watermark."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)


def rate_stream(events: DataFrame, at: str, actor: str, window: str = "60 seconds", slide: str = "10 seconds", delay: str = "1 minute") -> DataFrame:
    """Requests of each actor in sliding windows."""
    return events.withWatermark(at, delay).groupBy(F.window(at, window, slide), actor).agg(F.count("*").alias("n"))


def living_batches(stream: DataFrame, folder: str, checkpoint: str):
    """Write each micro-batch's snapshot differences: a foreachBatch query against the snapshot in ``folder``/current."""
    from ..operators.living import diff

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{folder}/snapshot={batch_id - 1}") if batch_id else batch.limit(0)
        diff(before, batch).write.mode("overwrite").parquet(f"{folder}/changes={batch_id}")
        batch.write.mode("overwrite").parquet(f"{folder}/snapshot={batch_id}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
