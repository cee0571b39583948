"""A corpus of instructions and chains: parse, check, clean, split and format, as batch operators.

A chain is text such as ``select('.fn').filter(name="x").count()``. It is parsed in
workers into an array of steps; checks over steps are plain array functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import garbled, keep_first

STEPS = "array<struct<op:string,args:array<string>>>"


def parse_calls(text: str) -> list[tuple[str, list[str]]]:
    """The calls of ``a(x).b(y)``, with their arguments as written; ValueError if it doesn't read so."""
    at, out, n = 0, [], len(text)
    while at < n:
        start = at
        while at < n and (text[at].isalnum() or text[at] == "_"):
            at += 1
        name = text[start:at]
        if not name or at >= n or text[at] != "(":
            raise ValueError(f"no call at {start}")
        at += 1
        depth, quote, args, last = 1, "", [], at
        while at < n and depth:
            c = text[at]
            if quote:
                if c == "\\":
                    at += 1
                elif c == quote:
                    quote = ""
            elif c in "'\"":
                quote = c
            elif c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
            elif c == "," and depth == 1:
                args.append(text[last:at].strip())
                last = at + 1
            at += 1
        if depth or quote:
            raise ValueError("a bracket or quote is open")
        if text[last : at - 1].strip():
            args.append(text[last : at - 1].strip())
        out.append((name, args))
        if at < n:
            if text[at] != ".":
                raise ValueError(f"no dot at {at}")
            at += 1
            if at == n:
                raise ValueError("ends in a dot")
    return out


def steps(chain: str | Column) -> Column:
    """The steps of chains; null where one can't be parsed."""

    @F.pandas_udf(STEPS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for text in batch:
                try:
                    out.append(None if text is None else [{"op": o, "args": a} for o, a in parse_calls(text.strip())])
                except ValueError:
                    out.append(None)
            yield pd.Series(out, dtype=object)

    return run(chain)


def chat_record(records: DataFrame, system: str) -> DataFrame:
    """Records as training messages in JSON."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return records.select(F.to_json(F.struct(F.array(message("system", F.lit(system)), message("user", F.col("intent")), message("assistant", F.col("chain"))).alias("messages"))).alias("record"))


def completion_record(records: DataFrame) -> DataFrame:
    return records.select(F.to_json(F.struct(F.concat(F.col("intent"), F.lit("\n")).alias("prompt"), F.col("chain").alias("completion"))).alias("record"))


def judged(records: DataFrame, least: int = 2, path: str | None = None) -> DataFrame:
    """``records`` with ``error`` (null if the chain is valid), ``warnings`` and ``ends_in``, the type of what the chain gives.

    The types of the steps are walked by the specification at ``path``; then selectors and steps are held against
    each other. A null chain can't be parsed.
    """
    from .grammar import DEFAULT, check, load

    spec = load(path or DEFAULT)

    @F.pandas_udf("struct<error:string,warnings:array<string>,ends_in:string>")
    def run(chains: pd.Series) -> pd.DataFrame:
        found = [check(c, spec, least) if isinstance(c, str) else ("can't be parsed", [], None) for c in chains]
        return pd.DataFrame({"error": [f[0] for f in found], "warnings": [f[1] for f in found], "ends_in": [f[2] for f in found]})

    return records.withColumn("_said", run("chain")).select("*", "_said.error", "_said.warnings", "_said.ends_in").drop("_said")


def cleaned(records: DataFrame, least: int = 2, path: str | None = None) -> DataFrame:
    """Records (position, intent, chain, ...) with ``valid``, ``error`` and ``warnings``; garbled and repeated intents are gone.

    An invalid first record of an intent still stands for it, as the order is garbled, repeated, invalid.
    """
    first = keep_first(records, ["intent"], ["position"], garbled(F.col("intent")))
    return judged(first, least, path).withColumn("valid", F.col("error").isNull())


def read_lines(spark: SparkSession, path: str, schema: str = "intent string, chain string") -> tuple[DataFrame, DataFrame]:
    """Records of a JSON-lines file and, apart, the lines that are none: (line)."""
    read = spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE").json(path)
    raw = spark.read.text(path).where("trim(value) <> ''")
    whole = raw.select(F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("r"), "value")
    good = whole.where("r._bad IS NULL").select(*[f"r.{f.name}" for f in read.schema if f.name != "_bad"])
    return good, whole.where("r._bad IS NOT NULL").select(F.col("value").alias("line"))


def write_split(checked: DataFrame, valid: str, rejected: str) -> dict[str, int]:
    """Valid and rejected records, each as JSON lines in a folder of its own; how many there are of each."""
    kept = checked.persist()
    try:
        kept.where("valid").write.mode("overwrite").json(valid)
        kept.where("NOT valid").write.mode("overwrite").json(rejected)
        said = {r["valid"]: r["count"] for r in kept.groupBy("valid").count().collect()}
        return {"valid": said.get(True, 0), "rejected": said.get(False, 0)}
    finally:
        kept.unpersist()


def generate(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """Examples and ``n`` made-up records, the same for the same seed."""
    from .sampling import generate as made

    return made(spark, n, seed)
