"""Streams of events: windowed sums with late data, sessions, and recursive averages kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Events of a folder of parquet files as a stream, with their schema taken from the files there now."""
    schema = spark.read.parquet(folder).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) of tumbling or sliding windows; rows later than ``late`` are left out (in a stream)."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    sums = marked.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return sums.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with less than ``gap`` between them."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    sums = marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return sums.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def online_average(events: DataFrame, alpha: float = 0.1) -> DataFrame:
    """(event_type, n, average): after each batch, the recursive average of a type's values in order of time.

    The state of a type is two numbers, whatever the number of events.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, average = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(batches)).sort_values("ts")
        for v in rows["value"].dropna():
            average = v if n == 0 else alpha * v + (1 - alpha) * average
            n += 1
        state.update((n, float(average)))
        yield pd.DataFrame({"event_type": [key[0]], "n": [n], "average": [average]})

    return events.select("event_type", "ts", "value").groupBy("event_type").applyInPandasWithState(update, "event_type string, n long, average double", "n long, average double", "update", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now and give the table of its results (for jobs and tests)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
