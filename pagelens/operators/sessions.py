"""Grouping activity into sessions, chunk by chunk of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.session import nonblank

GAP_MS = 1_800_000
CHUNK_MS = 21_600_000


def sessionize(events: DataFrame, user: str = "user_id", ts: str = "ts", event_id: str = "event_id", gap_ms: int = GAP_MS, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Sessions of each user: user_id, start_ts, end_ts, duration_ms, n_events.

    A session begins where more than gap_ms have passed since the user's previous event.
    Events are shuffled by (user, chunk of time), so that a user with any share of the rows
    is spread over as many tasks as there are chunks; each chunk yields local sessions, and
    local sessions of neighbouring chunks are merged where the gap between them is small
    enough.  A chunk holds at most chunk_ms / gap_ms + 1 local sessions, which bounds what
    one user brings to the merge by the span of time, not by the number of events.

    Null or blank users and null times are left out.  An event delivered again (same id, user
    and time) counts once; rows without an id count each.  Events at the same time are one
    session.  An empty table gives no rows; other columns are ignored.
    """
    e = events.select(F.col(user).alias("user_id"), F.col(ts).cast("bigint").alias("ts"), F.col(event_id).alias("event_id"))
    e = e.where(nonblank(F.col("user_id")).isNotNull() & F.col("ts").isNotNull())
    e = e.withColumn("chunk", F.expr(f"ts div {chunk_ms}")).repartition("user_id", "chunk")
    inside = Window.partitionBy("user_id", "chunk").orderBy("ts", "event_id")
    before, same = F.lag("ts").over(inside), F.lag("event_id").over(inside)
    e = e.withColumn("again", F.coalesce((before == F.col("ts")) & (same == F.col("event_id")), F.lit(False))).withColumn("starts", F.coalesce(F.try_subtract("ts", before) <= gap_ms, F.lit(False)).cast("int"))
    e = e.withColumn("part", F.sum(1 - F.col("starts")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    parts = e.groupBy("user_id", "chunk", "part").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count_if(~F.col("again")).alias("n_events"))

    along = Window.partitionBy("user_id").orderBy("start_ts", "chunk")
    joins = F.coalesce(F.try_subtract("start_ts", F.lag("end_ts").over(along)) <= gap_ms, F.lit(False)).cast("int")
    parts = parts.withColumn("joins", joins).withColumn("session", F.sum(1 - F.col("joins")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    merged = parts.groupBy("user_id", "session").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.sum("n_events").alias("n_events"))
    return merged.select("user_id", "start_ts", "end_ts", F.try_subtract("end_ts", "start_ts").alias("duration_ms"), "n_events")
