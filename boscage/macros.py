"""Named functions that give DataFrames, reached as attributes: ``fn.name(...)``.

A macro is registered once with ``macro`` and gets the Spark session first. An entry
object has its own accessor, ``Grove.fn``; the one of the module uses the active session.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MACROS: dict[str, Callable[..., DataFrame]] = {}


def macro(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Register a function under its name."""
    MACROS[function.__name__] = function
    return function


class Macros:
    def __init__(self, spark: SparkSession | None = None):
        self._spark = spark

    def _session(self) -> SparkSession:
        found = self._spark or SparkSession.getActiveSession()
        if found is None:
            raise RuntimeError("macros need a Spark session")
        return found

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in MACROS:
            raise AttributeError(f"no macro {name!r}; there are {', '.join(sorted(MACROS))}")
        return lambda *args, **kwargs: MACROS[name](self._session(), *args, **kwargs)

    def __dir__(self):
        return sorted(MACROS)

    def __repr__(self) -> str:
        return f"fn({', '.join(sorted(MACROS))})"


fn = Macros()


def _trees(spark: SparkSession, pattern: str) -> DataFrame:
    from .selection import Grove

    return Grove(spark, pattern).trees.nodes


@macro
def trees(spark: SparkSession, pattern: str) -> DataFrame:
    """All nodes of the files of a pattern."""
    return _trees(spark, pattern)


@macro
def definitions(spark: SparkSession, pattern: str) -> DataFrame:
    """Functions and classes: file, lines, kind, name and head."""
    from .operators.view import signature

    found = _trees(spark, pattern).where(F.col("semantic_name").isin("DEFINITION_FUNCTION", "DEFINITION_CLASS"))
    return found.select("file_path", "start_line", "end_line", "type", "name", signature().alias("signature"))


@macro
def calls(spark: SparkSession, pattern: str) -> DataFrame:
    """Calls: file, line and the name called."""
    return _trees(spark, pattern).where("semantic_name = 'COMPUTATION_CALL'").select("file_path", "start_line", "name")


@macro
def sections(spark: SparkSession, pattern: str = "**/*.md") -> DataFrame:
    """Sections of markdown files."""
    from .sources import files, markdown

    return markdown.sections(files.read(spark, files.listed(pattern)))
