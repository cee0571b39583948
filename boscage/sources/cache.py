"""Parsed trees kept as Parquet, by pattern, and brought up to date file by file."""

from __future__ import annotations

import hashlib
import os
import shutil
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import NODE
from . import files
from .languages import BUILT_IN, Languages


class TreeCache:
    """``get`` parses only files that are new or changed since the pattern was last asked for; gone files leave.

    ``folder`` must be one that all executors share. Each refresh writes a new
    version of the table beside the old one, and the index then names it, so
    a reader never sees a table half written.
    """

    def __init__(self, spark: SparkSession, folder: str, languages: Languages = BUILT_IN):
        self.spark, self.folder, self.languages = spark, folder, languages

    @staticmethod
    def key(pattern: str) -> str:
        return hashlib.sha256(pattern.encode()).hexdigest()[:16]

    def _index(self, pattern: str) -> str:
        return os.path.join(self.folder, f"{self.key(pattern)}.index")

    def _read_index(self, pattern: str) -> tuple[str, DataFrame] | None:
        path = self._index(pattern)
        if not os.path.exists(path):
            return None
        with open(path) as f:
            table = f.read().strip()
        return table, self.spark.read.parquet(table + ".files")

    def get(self, pattern: str, root: str | None = None) -> DataFrame:
        os.makedirs(self.folder, exist_ok=True)
        now = files.read(self.spark, [p for p in files.listed(pattern, root) if self.languages.reads(p)])
        known = self._read_index(pattern)
        stamps = now.select("file_path", "modified")
        if known:
            old_table, old = known
            changed = stamps.join(old.withColumnRenamed("modified", "was"), "file_path", "full").where("NOT (modified <=> was)")
            if changed.isEmpty():
                return self.spark.read.schema(NODE).parquet(old_table)
            same = old.join(stamps, ["file_path", "modified"], "left_semi").select("file_path")
            kept = self.spark.read.schema(NODE).parquet(old_table).join(same, "file_path", "left_semi")
            nodes = kept.unionByName(self.languages.nodes(now.join(same, "file_path", "left_anti")))
        else:
            nodes = self.languages.nodes(now)
        table = os.path.join(self.folder, f"{self.key(pattern)}-{time.time_ns()}")
        nodes.write.parquet(table)
        stamps.write.parquet(table + ".files")
        part = f"{self._index(pattern)}.{os.getpid()}"
        with open(part, "w") as f:
            f.write(table)
        os.replace(part, self._index(pattern))
        self._clean(pattern, {table} | ({known[0]} if known else set()))
        return self.spark.read.schema(NODE).parquet(table)

    def _clean(self, pattern: str, kept: set[str]) -> None:
        """Versions before the last are removed; that one stays for readers that have begun."""
        for name in os.listdir(self.folder):
            path = os.path.join(self.folder, name)
            if name.startswith(self.key(pattern) + "-") and path.removesuffix(".files") not in kept:
                shutil.rmtree(path, ignore_errors=True)

    def listing(self, pattern: str) -> DataFrame:
        """(file_path, modified, nodes) of a pattern's table."""
        table, stamps = self._read_index(pattern)
        counts = self.spark.read.parquet(table).groupBy("file_path").agg(F.count("*").alias("nodes"))
        return stamps.join(counts, "file_path", "left")
