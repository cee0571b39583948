"""Chains: a query or edit as data, with its JSON and command-line forms and its evaluation."""

from __future__ import annotations

import datetime
import decimal
import json
import os
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..operators import rewrite
from ..plugins import resolve
from ..selection import Grove, Selection

QUERIES = {"find", "filter", "filter_sql", "not_", "unique", "containing", "at_line", "at_lines", "search"}
NAVIGATION = {"parent", "children", "siblings", "ancestor", "next", "prev", "callers", "callees", "references", "scope", "defs", "refs"}
PAGING = {"limit", "offset", "page"}
TERMINALS = {"count", "names", "text", "attr", "complexity", "materialize", "files", "listing"}
EDITS = {"replaceWith", "addParam", "removeParam", "addArg", "removeArg", "insertBefore", "insertAfter", "rename", "prepend", "append", "wrap", "unwrap", "remove", "clearBody", "patch"}
STACK = {"pop", "reset"}
KNOWN = QUERIES | NAVIGATION | PAGING | TERMINALS | EDITS | STACK


class ChainError(ValueError):
    """A chain that can't be read or evaluated."""


@dataclass(frozen=True)
class ChainStep:
    op: str
    args: tuple[str, ...] = ()
    kwargs: dict[str, Any] = field(default_factory=dict)

    def to_dict(self) -> dict:
        return {"op": self.op} | ({"args": list(self.args)} if self.args else {}) | ({"kwargs": dict(self.kwargs)} if self.kwargs else {})


def _number(text: Any) -> Any:
    """Numbers and truth values that came as text."""
    if not isinstance(text, str):
        return text
    if text in ("true", "false"):
        return text == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def _brought(plugins) -> set[str]:
    """Steps that plugins bring."""
    return {name for cls in resolve(list(plugins)) for name in cls.methods}


_NUMBERS = {"limit", "offset", "page", "at_line", "at_lines"}


@dataclass(frozen=True)
class Chain:
    source: tuple[str, ...]
    steps: tuple[ChainStep, ...] = ()
    plugins: tuple[str, ...] = ()
    repo: str | None = None
    dry_run: bool = False
    diff: bool = False

    # --- forms

    def to_dict(self) -> dict:
        out: dict = {"source": list(self.source), "steps": [s.to_dict() for s in self.steps]}
        for name in ("plugins", "repo", "dry_run", "diff"):
            if value := getattr(self, name):
                out[name] = list(value) if name == "plugins" else value
        return out

    @classmethod
    def from_dict(cls, said: dict) -> Chain:
        if not isinstance(said, dict) or "source" not in said:
            raise ChainError("a chain needs a source")
        source, more = said["source"], _brought(said.get("plugins", ()))
        steps = []
        for s in said.get("steps", ()):
            if s.get("op") not in KNOWN | more:
                raise ChainError(f"unknown step {s.get('op')!r}")
            steps.append(ChainStep(s["op"], tuple(s.get("args", ())), dict(s.get("kwargs", {}))))
        return cls((source,) if isinstance(source, str) else tuple(source), tuple(steps), tuple(said.get("plugins", ())), said.get("repo"), bool(said.get("dry_run")), bool(said.get("diff")))

    def to_json(self, **how) -> str:
        return json.dumps(self.to_dict(), **how)

    @classmethod
    def from_json(cls, text: str) -> Chain:
        try:
            return cls.from_dict(json.loads(text))
        except json.JSONDecodeError as e:
            raise ChainError(f"not JSON: {e}") from None

    @classmethod
    def from_argv(cls, argv: list[str]) -> Chain:
        """``[--repo R] [--dry-run] [--diff] SOURCE... step args --key=value ... [--] step ...``"""
        flags, words = {}, list(argv)
        while words and words[0].startswith("--") and words[0] != "--":
            name, eq, value = words.pop(0)[2:].partition("=")
            if name in ("dry-run", "diff"):
                flags[name.replace("-", "_")] = True
            elif name in ("repo", "plugin"):
                value = value if eq else words.pop(0) if words else ""
                flags[name] = flags.get(name, ()) + (value,)
            else:
                raise ChainError(f"unknown option --{name}")
        source, steps = [], []
        known = KNOWN | _brought(flags.get("plugin", ()))
        while words and words[0] not in known and words[0] != "--":
            source.append(words.pop(0))
        if not source:
            raise ChainError("a source is missing")
        while words:
            op = words.pop(0)
            if op == "--":
                steps.append(ChainStep("reset"))
                continue
            if op not in known:
                raise ChainError(f"unknown step {op!r}")
            args, kwargs = [], {}
            while words and words[0] not in known and words[0] != "--":
                word = words.pop(0)
                if word.startswith("--"):
                    name, _, value = word[2:].partition("=")
                    kwargs[name] = value
                else:
                    args.append(word[1:] if word.startswith("\\") else word)
            steps.append(ChainStep(op, tuple(args), kwargs))
        return cls(tuple(source), tuple(steps), flags.get("plugin", ()), (flags.get("repo") or (None,))[-1], flags.get("dry_run", False), flags.get("diff", False))

    def to_argv(self) -> list[str]:
        out = [f"--plugin={p}" for p in self.plugins] + ([f"--repo={self.repo}"] if self.repo else []) + ["--dry-run"] * self.dry_run + ["--diff"] * self.diff
        out += self.source
        for s in self.steps:
            if s.op == "reset":
                out.append("--")
                continue
            out.append(s.op)
            out += ["\\" + str(a) if str(a) in KNOWN or str(a).startswith(("--", "\\")) else str(a) for a in s.args]
            out += [f"--{k}={v}" for k, v in s.kwargs.items()]
        return out

    # --- pages

    def _paged(self, offset: int, limit: int) -> Chain:
        steps = [s for s in self.steps if s.op not in PAGING]
        at = len(steps) - 1 if steps and steps[-1].op in TERMINALS else len(steps)
        return replace(self, steps=(*steps[:at], ChainStep("offset", (str(offset),)), ChainStep("limit", (str(limit),)), *steps[at:]))

    def page_of(self) -> tuple[int, int] | None:
        offset, limit = 0, None
        for s in self.steps:
            if s.op == "offset":
                offset += int(s.args[0])
            elif s.op == "limit":
                limit = int(s.args[0])
            elif s.op == "page":
                limit = int(s.args[1])
                offset += int(s.args[0]) * limit
        return None if limit is None else (offset, limit)

    def goto_page(self, n: int, size: int | None = None) -> Chain:
        found = self.page_of()
        size = size or (found and found[1])
        if not size:
            raise ChainError("the chain has no page size")
        return self._paged(n * size, size)

    def next_page(self) -> Chain:
        found = self.page_of()
        if not found:
            raise ChainError("the chain has no page")
        return self._paged(found[0] + found[1], found[1])

    def prev_page(self) -> Chain:
        found = self.page_of()
        if not found:
            raise ChainError("the chain has no page")
        return self._paged(max(0, found[0] - found[1]), found[1])

    # --- evaluation

    def _open(self, spark: SparkSession, grove: Grove | None) -> Grove:
        return grove or Grove(spark, list(self.source), repo=self.repo, plugins=self.plugins)

    def selection(self, spark: SparkSession, grove: Grove | None = None) -> Selection:
        """What the chain selects before its terminal and edits; lazy."""
        return self._fold(self._open(spark, grove), edits=None)[0]

    def _fold(self, grove: Grove, edits: _Edits | None):
        """What is selected at the end, and the terminal. Edits are only made to ``edits``, in memory."""
        stack: list[Selection] = []
        terminal = None
        for s in self.steps:
            args, kwargs = tuple(self._argument(a) for a in s.args), {k: _number(self._argument(v)) for k, v in s.kwargs.items()}
            if s.op in _NUMBERS:
                args = tuple(_number(a) for a in args)
            if s.op == "reset":
                stack = []
            elif s.op == "pop":
                if len(stack) < 2:
                    raise ChainError("nothing to pop to")
                stack.pop()
            elif s.op == "find":
                stack.append((stack[-1] if stack else grove).find(*args))
            elif not stack:
                raise ChainError(f"{s.op} needs a find before it")
            elif s.op in TERMINALS:
                terminal = (s.op, args)
            elif s.op in EDITS:
                if edits is not None:
                    grove = edits.make(grove, s.op, args, stack[-1])
                    stack = [_again(grove, x) for x in stack]
            elif s.op in KNOWN:
                stack[-1] = getattr(stack[-1], s.op)(*args, **kwargs)
            else:  # of a plugin
                found = getattr(stack[-1], s.op)(*args, **kwargs)
                if isinstance(found, Selection):
                    stack[-1] = found
                else:
                    terminal = (s.op, found)
        if not stack:
            raise ChainError("the chain selects nothing")
        return stack[-1], terminal

    def _argument(self, text: Any) -> Any:
        """``@path`` is a file's content, ``@@`` a plain at sign."""
        if isinstance(text, str) and text.startswith("@@"):
            return text[1:]
        if isinstance(text, str) and len(text) > 1 and text.startswith("@"):
            path = os.path.join(self.repo or ".", text[1:])
            try:
                with open(path, encoding="utf-8") as f:
                    return f.read()
            except OSError as e:
                raise ChainError(f"{text}: {e.strerror}") from None
        return text

    def evaluate(self, spark: SparkSession, grove: Grove | None = None, with_total: bool = False) -> dict:
        """The result as plain data: ``chain``, ``type``, ``data``, and ``page`` if the chain is paged."""
        grove = self._open(spark, grove)
        if any(s.op in EDITS for s in self.steps):
            return self._edited(grove)
        chosen, terminal = self._fold(grove, None)
        op, args = terminal or ("materialize", ())
        data = getattr(chosen, op)(*args) if op in KNOWN else [r.asDict(True) for r in args.collect()] if isinstance(args, DataFrame) else args
        out = {"chain": self.to_dict(), "type": op, "data": json_safe(data)}
        if page := self.page_of():
            offset, limit = page
            found = len(data) if isinstance(data, list) else data if op == "count" else None
            out["source_chain"] = self.to_dict()
            out["page"] = {"offset": offset, "limit": limit, "total": None, "has_more": found is not None and found >= limit}
            if with_total:
                whole = replace(self, steps=tuple(s for s in self.steps if s.op not in PAGING | TERMINALS))
                total = whole.selection(spark, grove).count()
                out["page"] |= {"total": total, "has_more": offset + limit < total}
        return out

    def edits(self, grove: Grove) -> _Edits:
        """All edits of the chain, made in memory, each to what those before left."""
        edits = _Edits(grove.trees.sources.select("file_path", "text"))
        self._fold(grove, edits)
        return edits

    def _edited(self, grove: Grove) -> dict:
        """All edits are made in memory, each to what those before left, and then written together or, for a dry run or diff, shown."""
        edits = self.edits(grove)
        planned = edits.planned().persist()
        try:
            if self.dry_run or self.diff:
                data: Any = "".join(r["diff"] for r in rewrite.diffs(planned).orderBy("file_path").collect())
                return {"chain": self.to_dict(), "type": "diff", "data": data}
            rewrite.commit(planned)
            return {"chain": self.to_dict(), "type": "edit", "data": {"edits": edits.ops}}
        finally:
            planned.unpersist()


class _Edits:
    """Edits of some sources, made one after another."""

    def __init__(self, sources: DataFrame):
        self.before = self.now = sources
        self.ops: list[str] = []

    def make(self, grove: Grove, op: str, args: tuple, chosen: Selection) -> Grove:
        """The trees after an edit."""
        planned = chosen.planned(op, *args).persist()
        if bad := rewrite.faults(planned):
            raise rewrite.RewriteError("; ".join(bad))
        self.now = rewrite.applied(self.now, planned)
        self.ops.append(op)
        return grove.over(self.now)

    def planned(self) -> DataFrame:
        return rewrite.between(self.before, self.now)


def _again(grove: Grove, chosen: Selection) -> Selection:
    """A selection made anew over other trees, by its steps."""
    out = None
    for s in chosen.steps:
        out = getattr(out or grove, s.op)(*s.args, **s.kwargs)
    return out


def chain_of(chosen: Selection, source: tuple[str, ...] = ()) -> Chain:
    """The chain that led to a selection."""
    return Chain(tuple(source or chosen.trees.names), tuple(ChainStep(s.op, tuple(map(str, s.args)), {k: v for k, v in s.kwargs.items()}) for s in chosen.steps))


def json_safe(x: Any) -> Any:
    if isinstance(x, dict):
        return {str(k): json_safe(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [json_safe(v) for v in x]
    if isinstance(x, decimal.Decimal):
        return int(x) if x == x.to_integral_value() else float(x)
    if isinstance(x, (datetime.date, datetime.datetime)):
        return x.isoformat()
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).decode("utf-8", "replace")
    return x


__all__ = ["Chain", "ChainStep", "ChainError", "chain_of", "json_safe", "rewrite"]
