"""Text files as (file_path, text), one row for each file, whole."""

from __future__ import annotations

import glob as _glob
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listed(pattern: str, root: str | None = None) -> list[str]:
    """Files of a glob, for sources on the driver's file system; ``**`` goes into folders."""
    path = pattern if os.path.isabs(pattern) or not root else os.path.join(root, pattern)
    return sorted(p for p in _glob.glob(path, recursive=True) if os.path.isfile(p))


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One multi-path scan of whole files. Without paths, no rows of the same schema."""
    if not paths:
        return spark.createDataFrame([], "file_path string, text string, modified timestamp")
    df = spark.read.format("binaryFile").load(paths)
    bare = F.regexp_replace(F.col("path"), "^file:/*(?=/)", "")
    return df.select(bare.alias("file_path"), F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("modified"))


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Rows over all cores by a key. A few row groups of a table may name more files than one core can parse."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *key)


#: Bytes of stored tables for each task that sorts their rows, which take some sixty times as much there.
TASK_BYTES = 4 << 20


def parts_of(df: DataFrame) -> int | None:
    """How many tasks the tables behind a DataFrame need, so that a task's rows don't grow with them; None if the session's own number will do."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size())]
    n = sum(x for x in sizes if x < 1 << 60) // TASK_BYTES + 1  # what isn't stored has no size
    return n if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def sorted_apart(df: DataFrame, *key: str, parts: int | None) -> DataFrame:
    """Rows by a key in so many parts, for windows and joins over the key; as it is without a number."""
    return df if parts is None else df.repartition(parts, *key)


def measuring(spark: SparkSession) -> SparkSession:
    """A session with the same settings, in which a join is broadcast only if what was written for it is small.

    Spark guesses the nodes of a file as no larger than its row in a table, and would send all of them to the driver.
    """
    out = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if name.startswith("spark.sql.") and spark.conf.isModifiable(name):
            out.conf.set(name, value)
    most = "spark.sql.autoBroadcastJoinThreshold"
    out.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) or spark.conf.get(most))
    out.conf.set(most, "-1")
    return out
