"""Leases kept alive by heartbeats, in batch or as a stream.

A lease lives ``lifetime`` seconds past its last heartbeat, and clocks may
differ by ``slop`` seconds. Heartbeats of one holder that come in time are one
lease; a gap longer than both ends it. That is a session window, which Spark
keeps as state in a stream and merges before the shuffle in a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LIFETIME = 35
SLOP = 10


def leases(beats: DataFrame, holder: str, at: str, lifetime: int = LIFETIME, slop: int = SLOP) -> DataFrame:
    """(holder, taken, last_beat, beats) of each lease.

    For a stream, ``beats`` carries a watermark on ``at``; a lease comes out
    once the watermark has passed its end, and beats later than that are left out.
    """
    # A session takes in what starts at its very end; a lease is over by then.
    window = F.session_window(at, f"{lifetime + slop - 1} seconds 999999 microseconds")
    found = beats.groupBy(holder, window.alias("w")).agg(F.min(at).alias("taken"), F.max(at).alias("last_beat"), F.count("*").alias("beats"))
    return found.drop("w")


def attempts(events: DataFrame, key: str, at: str, event_id: str, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Attempts of each key by ``every``; an event reported twice within ``late`` counts once. For streams and batches.

    A batch knows all reports of an event and counts it once however far apart
    they are. A stream forgets an event ``late`` after it; one that is reported
    again beyond that counts again.
    """
    own = events.withWatermark(at, late)
    own = own.dropDuplicatesWithinWatermark([event_id]) if events.isStreaming else own.dropDuplicates([event_id])
    return own.groupBy(F.window(at, every).alias("w"), key).agg(F.count("*").alias("attempts")).select(F.col("w.start").alias("start"), key, "attempts")


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what a stream has finished to a Parquet table: all input that is there now, then stop. Each row is written once over restarts."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
