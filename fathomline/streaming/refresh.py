"""Continuous refresh: new file rows arrive as a stream and are merged into the index, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fathomline.functions.current import current_rows
from fathomline.operators.indexing import IndexConfig, index_files
from fathomline.operators.store import IndexStore
from fathomline.session import stored

SCHEMA = "file_path string, relative_path string, project_name string, content string, modified_at timestamp"


def latest_files(rows: DataFrame) -> DataFrame:
    """The newest row of each file within a batch."""
    return current_rows(rows, ["file_path"], "modified_at")


def refresh_stream(spark: SparkSession, source: str, store: IndexStore, project: str, checkpoint: str, config: IndexConfig | None = None, available_now: bool = True) -> StreamingQuery:
    """Starts the refresh of one project from Parquet files that appear under `source`.

    The stored `files` table holds the newest row of every file seen, so a batch replayed after a failure changes nothing. A
    batch reads and writes the buckets of its own files only.
    """
    rows = spark.readStream.schema(SCHEMA).parquet(source)

    def merge(batch: DataFrame, _: int) -> None:
        mine = batch.where(F.col("project_name") == project)
        newest = latest_files(mine.withColumn("relative_path", F.regexp_replace("relative_path", r"\\", "/"))).select("file_path", "relative_path", "project_name", "content", "modified_at")
        paths = newest.select(F.col("relative_path").alias("path"))
        with store.lock(wait=60):
            have = store.read("files")
            if have is not None:  # a row that is not newer than the stored one changes nothing
                newest = latest_files(have.where(F.col("project_name") == project).join(paths.select(F.col("path").alias("relative_path")), "relative_path", "left_semi").select(*newest.columns).unionByName(newest)).select(*newest.columns)
            newest = stored(newest)
            store.update("files", newest, newest.select(F.col("relative_path").alias("path")), F.col("project_name") == project)
            index_files(store, newest, project, config, partial=True)

    writer = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and kind with a watermark; works on batch and streaming tables alike."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), kind, "n")
