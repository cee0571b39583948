"""Edits of many files: computed and checked in workers, written by the driver all or none."""

from __future__ import annotations

import difflib
import os
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import nav
from ..functions.rewriting import Edit, splice
from ..sources.languages import BUILT_IN, Languages


class RewriteError(ValueError):
    """A rewrite that would break a file."""


_OUT = "file_path string, old_text string, new_text string, errors int, failure string"


def plan(chosen: DataFrame, sources: DataFrame, make: Callable[[dict], Edit], languages: Languages = BUILT_IN) -> DataFrame:
    """One row for each file with a chosen node: old and new text, and how many syntax errors the edit adds.

    ``sources`` is (file_path, text). ``make`` gives each node's edit; it is sent to the workers.
    """
    fields = ["node_id", "name", "type", "language", "start_line", "end_line", *[c for c in ("anchor_start", "anchor_end") if c in chosen.columns]]
    nodes = chosen.groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("nodes"))
    files = nodes.join(sources.select("file_path", "text").hint("merge"), "file_path").select("file_path", "text", "nodes")
    schema = pa.schema([("file_path", pa.string()), ("old_text", pa.string()), ("new_text", pa.string()), ("errors", pa.int32()), ("failure", pa.string())])

    def edited(path: str, old: str, listed: list[dict]) -> tuple:
        failure, new, errors = None, old, 0
        try:
            new = splice(old, [(n, make(n)) for n in listed])
        except ValueError as e:
            failure = str(e)
        if languages.reads(path) and new != old:
            errors = languages.errors(new, path)
            errors = max(0, errors - languages.errors(old, path)) if errors else 0
        return path, old, new, errors, failure

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = zip(*(edited(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("file_path", "text", "nodes")))))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return files.mapInArrow(run, _OUT)


def faults(planned: DataFrame) -> list[str]:
    """What is wrong with the files of a plan."""
    return sorted(f"{r.file_path}: {r.failure or 'syntax error'}" for r in planned.where("errors > 0 OR failure IS NOT NULL").select("file_path", "failure").collect())


def applied(sources: DataFrame, planned: DataFrame) -> DataFrame:
    """The sources as a plan leaves them; nothing is written."""
    new = planned.where("failure IS NULL").select("file_path", "new_text")
    return sources.select("file_path", "text").join(new, "file_path", "left").select("file_path", F.coalesce("new_text", "text").alias("text"))


def between(before: DataFrame, after: DataFrame) -> DataFrame:
    """The plan that leads from some sources to others."""
    both = before.select("file_path", F.col("text").alias("old_text")).join(after.select("file_path", F.col("text").alias("new_text")), "file_path")
    return both.select("file_path", "old_text", "new_text", F.lit(0).alias("errors"), F.lit(None).cast("string").alias("failure"))


def commit(planned: DataFrame) -> list[str]:
    """Write the files of a plan, which must be visible to the driver. Nothing is written if any file would break."""
    rows = planned.where("new_text <> old_text OR errors > 0 OR failure IS NOT NULL").collect()
    bad = [f"{r.file_path}: {r.failure or 'syntax error'}" for r in rows if r.failure or r.errors]
    if bad:
        raise RewriteError("; ".join(sorted(bad)))
    written = []
    part = None
    try:
        for r in sorted(rows, key=lambda r: r.file_path):
            part = f"{r.file_path}.{os.getpid()}.part"
            with open(part, "w", encoding="utf-8", newline="") as f:
                f.write(r.new_text)
            os.replace(part, r.file_path)
            part = None
            written.append(r)
    except OSError:
        if part and os.path.exists(part):
            os.remove(part)
        for r in written:
            with open(r.file_path, "w", encoding="utf-8", newline="") as f:
                f.write(r.old_text)
        raise
    return [r.file_path for r in written]


def diffs(planned: DataFrame) -> DataFrame:
    """(file_path, diff) of the files that change, as unified diffs."""

    @F.pandas_udf("string")
    def unified(path: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series(["".join(difflib.unified_diff(a.splitlines(True), b.splitlines(True), f"a/{p.lstrip('/')}", f"b/{p.lstrip('/')}")) for p, a, b in zip(path, old, new)], dtype=object)

    return planned.where("new_text <> old_text").select("file_path", unified("file_path", "old_text", "new_text").alias("diff"))


def anchored(chosen: DataFrame, anchors: DataFrame) -> DataFrame:
    """Chosen nodes with the lines of the first anchor below each, counted from the node's first; those without one are left out."""
    found = nav.first_below(chosen, anchors, "start_line", "end_line")
    lines = {"anchor_start": F.col("_first.start_line") - F.col("start_line") + 1, "anchor_end": F.col("_first.end_line") - F.col("start_line") + 1}
    return found.withColumns(lines).drop("_first")
