"""Structured Streaming: exactly-once append of a chunk feed to a routed table, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspan import schemas as S
from quillspan.operators.incremental import new_rows
from quillspan.sources.readers import existing_ids
from quillspan.sources.sinks import accepted, write_routed


def append_feed(spark: SparkSession, feed: str, table: str, checkpoint: str) -> StreamingQuery:
    """Appends the new chunks of a JSON-lines folder to a routed table, batch by batch, then stops. A batch that is repeated after a failure adds nothing,
    since ids that are there are left out; rows that :func:`quillspan.sources.sinks.accepted` refuses are skipped."""
    stream = spark.readStream.schema(S.CHUNK).option("mode", "DROPMALFORMED").json(feed).where("chunk_id is not null")

    def batch(df: DataFrame, _: int) -> None:
        good, _refused = accepted(df)
        write_routed(new_rows(good, existing_ids(spark, table)), table)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling windows per event type; on a stream, events later than ``late`` are left out and a window comes once."""
    src = events.withWatermark("ts", late) if events.isStreaming else events
    out = src.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions per user: events less than ``gap`` apart belong together."""
    out = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return out.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "events")
