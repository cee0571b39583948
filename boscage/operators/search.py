"""BM25 over collections of texts: an inverted index as DataFrames, scored by joins and sums.

Terms are the runs of ASCII letters and digits in lower case. A term's weight in a
document is idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean length)), with
idf = ln(1 + (N - df + 0.5) / (df + 0.5)). Each collection has its own N, df and
mean length.
"""

from __future__ import annotations

import functools
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+"), lambda t: t != "")


#: Terms of texts that a task counts and sorts at once.
TASK_TERMS = 1_000_000


def postings(texts: DataFrame, parts: int | None = None) -> DataFrame:
    """(id, term, tf, length) of a table (id, text); counted in so many parts."""
    texts = texts if parts is None else texts.repartition(parts, "id")
    words = texts.select("id", terms(F.col("text")).alias("words")).withColumn("length", F.size("words"))
    return words.select("id", "length", F.explode("words").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def statistics(texts: DataFrame) -> DataFrame:
    """One row: number of texts and their mean length; texts without a term count."""
    return texts.agg(F.count("*").alias("n"), F.avg(F.size(terms(F.coalesce("text", F.lit(""))))).alias("mean_length"))


def score(posted: DataFrame, stats: DataFrame, asked: list[str]) -> DataFrame:
    """(id, score) of all texts with a term that was asked for. The filter on terms reaches the scan of the index."""
    hits = posted.where(F.col("term").isin(asked)) if asked else posted.limit(0)
    # one row for each term that was asked for
    df = F.broadcast(hits.groupBy("term").agg(F.count("*").alias("df")))
    hits = hits.join(df, "term").crossJoin(F.broadcast(stats))  # stats is one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    return hits.groupBy("id").agg(F.round(F.sum(weight), 6).alias("score"))


def asked_terms(query: str) -> list[str]:
    out, now = [], ""
    for c in query.translate(str.maketrans(_UPPER, _LOWER)) + " ":
        if c.isascii() and c.isalnum():
            now += c
        elif now:
            out.append(now)
            now = ""
    return sorted(set(out))


def search(texts: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """(id, score), best first, ties by id; without an index."""
    found = score(postings(texts), statistics(texts), asked_terms(query)).orderBy(F.desc("score"), "id")
    return found if limit is None else found.limit(limit)


KINDS = {"DEFINITION_FUNCTION": "function", "DEFINITION_CLASS": "class", "DEFINITION_MODULE": "module", "EXTERNAL_IMPORT": "import", "METADATA_COMMENT": "comment"}


def content(definitions: DataFrame | None, sections: DataFrame | None) -> DataFrame:
    """What is searched: (id, text, file_path, ordinal, extractor, kind) of code nodes with their ``text`` and of sections."""
    parts = []
    if definitions is not None:
        kind = F.coalesce(*[F.when(F.col("semantic_name") == k, F.lit(v)) for k, v in KINDS.items()], F.lower("semantic_name"))
        parts.append(definitions.select(F.concat_ws("#", "file_path", F.col("node_id").cast("string")).alias("id"), "text", "file_path", F.col("node_id").alias("ordinal"), F.lit("code").alias("extractor"), kind.alias("kind")))
    if sections is not None:
        parts.append(sections.select(F.col("section_id").alias("id"), F.col("content").alias("text"), "file_path", F.col("start_line").cast("long").alias("ordinal"), F.lit("docs").alias("extractor"), F.lit("section").alias("kind")))
    return functools.reduce(DataFrame.unionByName, parts)


class Collection:
    """A named collection of (id, text, metadata), indexed as Parquet in a folder that executors share."""

    def __init__(self, spark: SparkSession, folder: str, name: str):
        self.spark, self.path = spark, os.path.join(folder, name)

    def create(self, rows: DataFrame) -> None:
        """Replace the collection: a new version is written beside the old one and then named, so a reader never sees a mix.

        Postings are in order of terms, so a search reads the row groups that hold its terms. Parts are
        ranges of terms and ids, as many as there are terms for, so one that all texts have is no single task's.
        """
        if "metadata" not in rows.columns:
            rows = rows.withColumn("metadata", F.lit(None).cast("map<string,string>"))
        rows = rows.select("id", "text", F.col("metadata").cast("map<string,string>"))
        path = f"{self.path}/{uuid.uuid4().hex}"
        rows.write.parquet(path + "/texts")
        kept = self.spark.read.parquet(path + "/texts")
        statistics(kept).write.parquet(path + "/statistics")
        said = self.spark.read.parquet(path + "/statistics").first()
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), int(said["n"] * (said["mean_length"] or 0)) // TASK_TERMS + 1)
        postings(kept, parts).repartitionByRange(parts, "term", "id").sortWithinPartitions("term", "id").write.parquet(path + "/postings")
        old = self._version()
        self.spark.createDataFrame([(path,)], "path string").coalesce(1).write.mode("overwrite").parquet(self.path + "/current")
        if old:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(old)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def _version(self) -> str | None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path + "/current")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.parquet(self.path + "/current").first()[0]

    def _read(self, part: str) -> DataFrame:
        version = self._version()
        if version is None:
            raise ValueError(f"{self.path} has not been created")
        return self.spark.read.parquet(f"{version}/{part}")

    def search(self, query: str, limit: int | None = 10, where: str | Column | None = None) -> DataFrame:
        """(id, text, metadata, score), best first; ``where`` is a condition on the metadata."""
        found = score(self._read("postings"), self._read("statistics"), asked_terms(query))
        texts = self._read("texts")
        if where is not None:
            texts = texts.where(where)
            found = found.join(texts.select("id"), "id", "left_semi")
        if limit is not None:
            found = found.orderBy(F.desc("score"), "id").limit(limit)
            found = F.broadcast(found) if limit <= 10_000 else found
        return found.join(texts, "id").select("id", "text", "metadata", "score").orderBy(F.desc("score"), "id")
