"""Structured Streaming forms: windowed counts with a watermark, sessions, and incremental registration of new rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, folder: str, like: DataFrame, files_per_trigger: int = 16, **options) -> DataFrame:
    return spark.readStream.schema(like.schema).options(maxFilesPerTrigger=files_per_trigger, **options).parquet(folder)


def _watermarked(events: DataFrame, ts: str, late: str) -> DataFrame:
    """Watermarks need times with a zone; times without one are taken in the session's."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events


def windowed(events: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(start, key, n, total) per window. On a stream, rows later than the watermark are dropped once their window closed."""
    e = _watermarked(events, ts, late)
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return e.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), key, "n", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    e = _watermarked(events, ts, late)
    return e.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


def drain(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Everything that is there, in micro-batches, exactly once per checkpoint; then the query ends."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()
    q.awaitTermination()


def append_new(target: str, key: str) -> Callable[[DataFrame, int], None]:
    """A batch function that appends rows whose key the target doesn't hold yet, one per key."""

    def write(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        fresh = df.dropDuplicates([key])
        try:
            fresh = fresh.join(spark.read.parquet(target).select(key), key, "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        fresh.write.mode("append").parquet(target)

    return write
