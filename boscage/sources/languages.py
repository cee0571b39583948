"""Which parser reads a file: by the ending of its name. More can be registered."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

from pyspark.sql import DataFrame

from . import brace_code, html_dom, markdown, python_code
from .trees import Node, parsed_by

Parser = Callable[[str, str], Node]


class UnknownLanguageError(ValueError):
    """A file whose language no parser here reads."""


class Languages:
    """Parsers by ending."""

    def __init__(self):
        self.known: dict[str, tuple[Parser, str]] = {}

    def register(self, language: str, parse: Parser, *endings: str) -> None:
        for e in endings:
            self.known[e.lower()] = (parse, language)

    def copy(self) -> Languages:
        new = Languages()
        new.known.update(self.known)
        return new

    def of(self, path: str) -> tuple[Parser, str]:
        ending = os.path.splitext(path)[1].lower()
        if ending not in self.known:
            raise UnknownLanguageError(f"{path}: no parser for {ending or 'a name without an ending'!r}; there are parsers for {' '.join(sorted(self.known))}")
        return self.known[ending]

    def reads(self, path: str) -> bool:
        return os.path.splitext(path)[1].lower() in self.known

    def nodes(self, files: DataFrame) -> DataFrame:
        """Trees of all files (file_path, text)."""
        return parsed_by(files, self.of)

    def errors(self, text: str, path: str) -> int:
        """How many ERROR nodes a text has."""
        todo, n = [self.of(path)[0](text, path)], 0
        while todo:
            node = todo.pop()
            n += node.type == "ERROR"
            todo += node.children
        return n


BUILT_IN = Languages()
BUILT_IN.register("python", python_code.parse, ".py", ".pyi")
BUILT_IN.register("html", html_dom.parse, ".html", ".htm")
BUILT_IN.register("markdown", markdown.parse, ".md", ".markdown")
for _language, *_endings in [
    ("javascript", ".js", ".jsx", ".mjs", ".cjs"), ("typescript", ".ts", ".tsx"), ("java", ".java"), ("c", ".c", ".h"), ("cpp", ".cc", ".cpp", ".cxx", ".hpp", ".hh"), ("csharp", ".cs"),
    ("go", ".go"), ("rust", ".rs"), ("kotlin", ".kt", ".kts"), ("swift", ".swift"), ("php", ".php"), ("scala", ".scala"), ("dart", ".dart"),
]:
    BUILT_IN.register(_language, functools.partial(brace_code.parse, language=_language), *_endings)
