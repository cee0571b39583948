"""A corpus pipeline: from raw documents to token ids.

``run`` applies ``STAGES`` to the table documents. What a stage returns is
written as Parquet in the shared folder and read again for the next, so a lost
executor costs a stage's tasks at most, and no stage's work is done twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from boscage.llm import bpe, decontaminate, langid, ngram_join, toxicity
from boscage.llm.common import fresh_path, release, scratch, table

#: Name and function of each stage; a function takes the session, what the stage before returned, and the folder of the tables.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity.stage),
    ("language_id", langid.stage),
    ("ngram_join", ngram_join.stage),
    ("decontaminate", decontaminate.stage),
    ("bpe", bpe.stage),
]
#: Compression distances and filters aren't SQL; tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of the documents that all stages kept.

    Each stage handles nulls in any column, empty and very long texts, ties, repeated rows,
    an empty table and further columns as its operator's docstring says: rows with a null text go in
    the language stage, rows with a null doc_id are never compared with others but are judged by all
    other stages, and an empty table gives no rows. What a stage stored and what it was given are
    deleted once its result is written.
    """
    docs, given = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if given:
            release(spark, given)
        docs, given = spark.read.parquet(path), path
    return docs
