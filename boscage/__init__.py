"""Boscage: query and rewrite tree-shaped data with Spark DataFrames."""

from __future__ import annotations

__version__ = "0.2.0"

from .functions.paths import display_path
from .functions.predicates import SelectorArgumentError, SelectorError, UnknownClassError
from .macros import fn, macro
from .operators.rewrite import RewriteError
from .operators.view import Block, View
from .plans.selector import Selector
from .plans.vocabulary import resolve_alias, resolve_aliases
from .plugins import Plugin, PluginError
from .selection import DocSelection, Grove, Selection, Source
from .sources.languages import UnknownLanguageError

__all__ = [
    "Block", "DocSelection", "Grove", "Plugin", "PluginError", "RewriteError", "Selection", "Selector", "SelectorArgumentError", "SelectorError", "Source", "UnknownClassError", "UnknownLanguageError", "View",
    "display_path", "find", "fn", "macro", "resolve_alias", "resolve_aliases", "search", "select", "view",
]


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession() or SparkSession.builder.appName("boscage").getOrCreate()


def _places(chosen: Selection, order: bool) -> list[tuple[str, int, str]]:
    from pyspark.sql import functions as F

    df = chosen.df.orderBy("file_path", "node_id") if order else chosen.df
    rows = df.select("file_path", "start_line", F.coalesce(F.nullif("name", F.lit("")), "type").alias("what")).collect()
    return [tuple(r) for r in rows]


def find(selector: str, code: str | list[str] = "**/*", repo: str | None = None, spark=None) -> list[tuple[str, int, str]]:
    """(file, line, name or type) of all matches; of a pattern of all files, those that a parser reads."""
    return _places(Grove(spark or _session(), code, repo=repo).find(selector), True)


def search(query: str, code: str | list[str] = "**/*", kind: str | None = None, limit: int = 10, repo: str | None = None, spark=None) -> list[tuple[str, int, str]]:
    """(file, line, name) of the definitions that fit the words best, best first."""
    return _places(Grove(spark or _session(), code, repo=repo).search(query, limit, kind), False)


def view(query: str, code: str | list[str] = "**/*", repo: str | None = None, spark=None) -> View:
    """The blocks that the rules of a query show."""
    return Grove(spark or _session(), code, repo=repo).view(query)


def select(selector: str, repo: str | None = None, spark=None) -> Selection:
    """Matches in all Python files of a repository."""
    return Grove(spark or _session(), "**/*.py", repo=repo).find(selector)
