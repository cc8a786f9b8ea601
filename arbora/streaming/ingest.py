"""Structured Streaming over point files, and windowed counts over events (an extension of its own)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arbora.grid import Grid
from arbora.schema import point_schema
from arbora.sources.catalog import PointTable


def stream_points(spark: SparkSession, source: str, files_per_batch: int = 64) -> DataFrame:
    """New Parquet point files under ``source``, with the ``file`` that each row came from."""
    return spark.readStream.schema(point_schema()).option("maxFilesPerTrigger", files_per_batch).parquet(source).withColumn("file", F.col("_metadata.file_path"))


def ingest_stream(points: DataFrame, table: PointTable, checkpoint: str) -> StreamingQuery:
    """Appends each file's points once, also after a restart: a batch counts when the manifest names it with its files."""

    def write(batch: DataFrame, _: int) -> None:
        names = [r["file"] for r in batch.select("file").distinct().collect()]  # one row for each file of the batch
        if names:
            table.ingest_files(batch, names)

    return points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def mergeable_cells(points: DataFrame, grid: Grid) -> DataFrame:
    """Counts, sums and extremes by pixel; those of batches merge into those of all points."""
    return grid.bins(points).groupBy("row", "col").agg(F.count("*").alias("n"), F.sum("Z").alias("z_sum"), F.min("Z").alias("z_min"), F.max("Z").alias("z_max"))


def merge_cells(parts: DataFrame) -> DataFrame:
    """The cells of all parts together, with density left to the reader: n, z_mean, z_min, z_max."""
    merged = parts.groupBy("row", "col").agg(F.sum("n").alias("n"), F.sum("z_sum").alias("z_sum"), F.min("z_min").alias("z_min"), F.max("z_max").alias("z_max"))
    return merged.select("row", "col", "n", (F.col("z_sum") / F.col("n")).alias("z_mean"), "z_min", "z_max")


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events of each type by tumbling window of ``ts``; works on streams, where late ones are dropped after ``late``."""
    stamped = events.withWatermark("ts", late) if events.isStreaming else events
    return stamped.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
