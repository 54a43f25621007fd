"""The event operators over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_time(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Events with a known user and time, the time as a timestamp."""
    return events.where(F.col("user_id").isNotNull() & (F.trim("user_id") != "") & F.col(ts).isNotNull()).withColumn("at", F.timestamp_millis(F.col(ts)))


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """STR-04 on a stream: one row per key within the watermark."""
    return event_time(events).withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a stream; one is emitted when the watermark has passed its end.

    session_window closes a session at the gap itself, so two events exactly one gap apart are two
    sessions here and one in the batch operator; events later than the watermark are left out
    (STR-11), which the batch operator takes in.
    """
    w = F.session_window("at", gap)
    return deduplicated(events, late=late).groupBy("user_id", w).agg(F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts")).drop("session_window")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events per kind and window, with late data up to the watermark."""
    return event_time(events).withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "event").agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "event", "n")


def rate_limited(events: DataFrame, most: int, window_ms: int) -> DataFrame:
    """STR-09 on a stream: user_id, ts, allowed; the state of a user is the times allowed within the window.

    Hits of one micro-batch are walked in order of time; one that arrives out of order is judged by
    the state of its arrival.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        hits = pd.concat(list(batches)).sort_values("ts")
        allowed = []
        for t in hits["ts"]:
            held = [h for h in held if h > t - window_ms]
            allowed.append(len(held) < most)
            if allowed[-1]:
                held.append(int(t))
        state.update((held,))
        yield pd.DataFrame({"user_id": key[0], "ts": hits["ts"], "allowed": allowed})

    x = event_time(events).select("user_id", "ts")
    return x.groupBy("user_id").applyInPandasWithState(step, "user_id string, ts bigint, allowed boolean", "held array<bigint>", "append", "NoTimeout")


def delivery_states(outbox: DataFrame) -> DataFrame:
    """STR-06 on a stream of outbox changes (event_id, status, attempts): the receiver's state of each and the seconds to its next attempt."""
    from pagelens.operators.eventlog import retry_delay, sync_state

    return outbox.select("event_id", sync_state(F.col("status")).alias("sync_state"), F.when(F.col("status") == "PENDING", retry_delay(F.col("attempts"))).alias("next_in_s"))


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Drain what is there into Parquet and stop."""
    q = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
