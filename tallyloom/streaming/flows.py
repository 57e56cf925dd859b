"""The polled inbox, queue and ledgers as Structured Streaming queries. Each has the same result as its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def file_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(kind).load(path)


def inbox(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """New files of a folder: path, modificationTime, length, content."""
    return spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def deduplicated(events: DataFrame, key: list[str], at: str, delay: str) -> DataFrame:
    """The first event of each key within the watermark, so that the state stays bounded."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)


def hit_counts(events: DataFrame, key: list[str], at: str) -> DataFrame:
    """Count, first and last time of each key so far, for output modes complete and update."""
    return events.groupBy(*key).agg(F.count("*").alias("hit_count"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))


def windowed_counts(events: DataFrame, at: str, key: str, width: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts in tumbling (or sliding) windows of event time."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    out = events.withWatermark(at, delay) if events.isStreaming else events
    return out.groupBy(window.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n")


def session_counts(events: DataFrame, at: str, key: str, gap: str, delay: str = "1 hour") -> DataFrame:
    """Counts in sessions that end after a gap without events."""
    out = events.withWatermark(at, delay) if events.isStreaming else events
    return out.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n")


def run_available(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there into Parquet files at target, then stop; started again it goes on where it stopped."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def routed(stream: DataFrame, sinks: dict[str, str], checkpoint: str, decision: str = "decision") -> None:
    """Rows to a folder by decision, one pass over each micro-batch. A batch that is run again replaces its own files (batch=<id>) and doubles nothing."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        for value, path in sinks.items():
            kept.filter(F.col(decision) == value).write.mode("overwrite").parquet(f"{path}/batch={number}")
        kept.unpersist()

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
