"""Small functions over columns of text and records, for corpora of instructions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def garbled(text: Column) -> Column:
    """Whether text is broken: odd quotes, brackets that don't balance, or marks of a template that was not filled."""
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    odd = (count('"') % 2 != 0) | (count("(") != count(")")) | (count("[") != count("]")) | (count("{") != count("}"))
    marks = text.contains("{{") | text.contains("}}") | text.contains("TODO") | text.contains("...(")
    return F.coalesce(odd | marks | (F.trim(text) == ""), F.lit(True))


def keep_first(df: DataFrame, key: list[str], order: list[str], blocked: Column | None = None) -> DataFrame:
    """The first row of each key. Rows that are ``blocked`` are gone before any counts as first."""
    df = df if blocked is None else df.where(~blocked)
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def split_exactly(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """``df`` with ``part``: train for exactly int(n * share) rows, the ones with the least md5 of key and seed, else val.

    The rank comes from counts by the first two hex digits, so no task orders all rows.
    """
    hashed = df.withColumn("_h", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))).withColumn("_b", F.substring("_h", 1, 2))
    sizes = hashed.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    ranked = hashed.join(F.broadcast(before), "_b").withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)))
    part = F.when(F.col("_rank") <= F.floor(F.col("_all") * F.lit(share)), "train").otherwise("val")
    return ranked.withColumn("part", part).drop("_h", "_b", "_before", "_all", "_rank")


def chat_messages(df: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """One row for each conversation: its messages in order as JSON, and how many."""
    message = F.sort_array(F.collect_list(F.struct(turn, role, text)))
    pairs = F.transform(message, lambda m: F.struct(m[role].alias("role"), m[text].alias("content")))
    return df.groupBy(conversation).agg(pairs.alias("messages")).select(conversation, F.size("messages").alias("n"), F.to_json("messages").alias("messages"))


def sha16(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:16]
