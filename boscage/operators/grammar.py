"""The specification of chains: types, operations and what may follow what; the checks that need it; a prompt made of it."""

from __future__ import annotations

import functools
import os
import re
import tomllib
from dataclasses import dataclass

from .corpus import parse_calls

DEFAULT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "grammar.toml")


@dataclass(frozen=True)
class Operation:
    name: str
    category: str
    output: str
    status: str
    #: Arguments as they are written.
    arguments: tuple[str, ...]


@dataclass(frozen=True)
class Spec:
    version: str
    types: dict[str, str]
    operations: dict[str, Operation]
    #: For each type, its categories and their operations; types without categories have one named ''.
    composition: dict[str, dict[str, tuple[str, ...]]]
    examples: tuple[tuple[str, str], ...]

    def after(self, type: str) -> set[str]:
        return {o for own in self.composition.get(type, {}).values() for o in own}


@functools.lru_cache(maxsize=8)
def load(path: str = DEFAULT) -> Spec:
    with open(path, "rb") as f:
        said = tomllib.load(f)
    operations = {n: Operation(n, row[0], row[1], row[2], tuple(row[3:])) for n, row in said["operations"].items()}
    composition = {t: {k: tuple(v) for k, v in own.items()} if isinstance(own, dict) else {"": tuple(own)} for t, own in said["composition"].items()}
    unknown = {o for own in composition.values() for ops in own.values() for o in ops} - set(operations)
    if unknown:
        raise ValueError(f"{path}: no operations for {', '.join(sorted(unknown))}")
    return Spec(said["version"], dict(said["types"]), operations, composition, tuple((e["intent"], e["chain"]) for e in said.get("examples", ())))


_FUNCTIONS = {"fn", "func", "function", "method", "def", "def-func"}
_CALLS = {"call", "invoke", "access-call"}
_CLASSES = {"cls", "class", "struct", "def-class"}
#: Nodes that have no name, and nodes that no edit makes sense on.
_NAMELESS = {"while", "for", "loop", "try", "except", "catch", "if", "cond", "block", "body", "ret", "return", "throw", "raise", "finally", "str", "string", "num", "number", "bool", "boolean", "comment"}
_LITERAL = {"comment", "metadata-comment", "str", "string", "literal-str", "num", "number", "literal-num"}
_SELECTING = {"select", "find", "not_", "ancestor"}
_OF_FUNCTIONS = {"addParam", "removeParam", "callers", "callees"}
_OF_CALLS = {"addArg", "removeArg"}


def _subject(selector: str) -> str | None:
    m = re.match(r"\.([\w-]+)", selector.strip())
    return m[1] if m else None


def odd_selector(selector: str) -> str | None:
    """What makes no sense in a selector."""
    kind = _subject(selector)
    if kind is None:
        return None
    if kind in _NAMELESS and re.match(r"\.[\w-]+#", selector.strip()):
        return f".{kind} has no name"
    if re.search(r"::(callers|callees)", selector) and kind not in _FUNCTIONS | _CALLS:
        return f"::callers and ::callees don't go with .{kind}"
    if ":calls(" in selector and kind not in _FUNCTIONS | _CLASSES:
        return f":calls() doesn't go with .{kind}"
    if ":called-by(" in selector and kind not in _CALLS:
        return f":called-by() doesn't go with .{kind}"
    if (":is-called" in selector or ":async" in selector) and kind not in _FUNCTIONS:
        return f":is-called and :async don't go with .{kind}"
    return None


def _plain(argument: str) -> str:
    return argument.strip("'\"")


def odd(steps: list[tuple[str, list[str]]], spec: Spec) -> str | None:
    """What makes no sense in a chain whose types fit."""
    kind = None
    for op, args in steps:
        if op in _SELECTING and args:
            if why := odd_selector(_plain(args[0])):
                return why
        if op in ("select", "find"):
            kind = _subject(_plain(args[0])) if args else None
        elif kind in _LITERAL and spec.operations[op].category == "edit":
            return f"{op}() makes no sense on .{kind}"
        elif op in _OF_FUNCTIONS and kind in _LITERAL | {"import"}:
            return f"{op}() is for functions, not .{kind}"
        elif op in _OF_CALLS and kind in _LITERAL | _CLASSES:
            return f"{op}() is for calls, not .{kind}"
    return None


def check(chain: str, spec: Spec, least: int = 1) -> tuple[str | None, list[str], str | None]:
    """Why a chain is no valid one (None if it is), warnings, and the type it ends in."""
    try:
        steps = parse_calls(chain.strip())
    except ValueError as e:
        return f"can't be parsed: {e}", [], None
    if not steps:
        return "an empty chain", [], None
    if steps[0][0] not in ("select", "source"):
        return f"begins with {steps[0][0]}, not with select or source", [], None
    if len(steps) < least:
        return "too few steps", [], None
    now = spec.operations[steps[0][0]].output
    warnings = []
    edited = False
    for k, (op, _) in enumerate(steps[1:], 2):
        if now == "terminal":
            return f"goes on after its end with {op}", [], None
        if op not in spec.operations:
            return f"unknown step {op}", [], None
        if op not in spec.after(now):
            return f"{op} can't follow a {now}", [], None
        found = spec.operations[op]
        if found.status != "built":
            warnings.append(f"{op} is planned")
        if edited and found.category == "terminal":
            warnings.append(f"{op} reads what was edited")
        edited |= found.category == "edit"
        now = found.output
    why = odd(steps, spec)
    return (f"makes no sense: {why}" if why else None), warnings, now


def prompt(spec: Spec) -> str:
    """Instructions for a model that is to write chains."""
    lines = ["You turn requests about code into one chain of steps and answer with the chain alone.", "", "Types:"]
    lines += [f"- {n}: {text}" for n, text in spec.types.items()]
    lines += ["", "A chain begins with select(selector) or source(files)."]
    for t, own in spec.composition.items():
        for category, ops in own.items():
            if ops:
                signs = ", ".join(f"{o}({spec.operations[o].arguments[0] if spec.operations[o].arguments else ''})" for o in ops if spec.operations[o].status == "built")
                lines.append(f"- after a {t}{f', {category}' if category else ''}: {signs}")
    lines += ["", "Selectors: .class, type, #name, [attribute=value], :pseudo, A B, A > B, A + B, A ~ B, :has(), :not(), :is().", "Use no other steps, no lambdas, no assignments."]
    lines += ["", "Examples:"] + [f"{i}\n{c}" for i, c in spec.examples]
    return "\n".join(lines) + "\n"
