"""Trees kept up to date from a stream of files, and windowed counts of events."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.languages import BUILT_IN

FILE = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, folder: str, pattern: str = "*.py") -> DataFrame:
    """New files of a folder as (file_path, text, modified)."""
    raw = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", pattern).load(folder)
    return raw.select(F.regexp_replace("path", "^file:/*(?=/)", "").alias("file_path"), F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("modified"))


def keep_trees(files: DataFrame, table: str, checkpoint: str):
    """Write the trees of each batch of files beside those before, by batch number; a batch that is run again replaces itself."""

    def one(batch: DataFrame, number: int) -> None:
        last = Window.partitionBy("file_path").orderBy(F.desc("modified"))
        newest = batch.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth")
        BUILT_IN.nodes(newest).write.mode("overwrite").parquet(os.path.join(table, f"batch={number}"))

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)


def current_trees(spark: SparkSession, table: str) -> DataFrame:
    """The nodes of each file as its latest batch has them."""
    nodes = spark.read.parquet(table)
    latest = nodes.groupBy("file_path").agg(F.max("batch").alias("batch"))
    return nodes.join(latest, ["file_path", "batch"], "left_semi").drop("batch")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, users): events by tumbling window, for a stream or a table; later ones than ``late`` are dropped in a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if timed.isStreaming else timed
    grouped = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users") if timed.isStreaming else F.countDistinct("user_id").alias("users"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "n", "users")
