"""Edits of source text: each takes a node's row and text and gives the new text.

An edit is plain Python over strings, so it runs in workers, a file at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: (node's row, its text, the whole file) to the node's new text.
Edit = Callable[[dict, str, str], str]

_PAIRS = {"(": ")", "[": "]", "{": "}"}


class PatchError(ValueError):
    """A patch that doesn't fit the text."""


def indent_of(line: str) -> str:
    return line[: len(line) - len(line.lstrip())]


def reindent(code: str, indent: str) -> str:
    """``code`` with its own common indent replaced; blank lines stay empty."""
    lines = code.strip("\n").split("\n")
    common = min((len(indent_of(x)) for x in lines if x.strip()), default=0)
    return "\n".join(indent + x[common:] if x.strip() else "" for x in lines)


def _quotes(text: str) -> list[bool]:
    """For each character, whether it stands in a string or comment."""
    out, at, quote = [], 0, ""
    while at < len(text):
        c = text[at]
        if quote:
            step = 2 if c == "\\" and at + 1 < len(text) and quote != "\n" else len(quote) if text.startswith(quote, at) else 1
            ends = c != "\\" and text.startswith(quote, at)
            out += [quote != "\n" or not ends] * step
            at += step
            if ends:
                quote = ""
        elif c in "'\"":
            quote = c * 3 if text.startswith(c * 3, at) else c
            out += [True] * len(quote)
            at += len(quote)
        else:
            if c == "#":
                quote = "\n"
            out.append(c == "#")
            at += 1
    return out


def brackets(text: str, opening: str = "(") -> tuple[int, int] | None:
    """Where the first pair of brackets begins and ends."""
    quoted, depth, start = _quotes(text), 0, None
    for at, c in enumerate(text):
        if quoted[at]:
            continue
        if c in _PAIRS and (start is not None or c == opening):
            if start is None:
                start = at
            depth += 1
        elif start is not None and c in _PAIRS.values():
            depth -= 1
            if not depth:
                return start, at
    return None


def split_list(inner: str) -> list[str]:
    """Parts between commas that stand in no bracket or string."""
    quoted, depth, parts, last = _quotes(inner), 0, [], 0
    for at, c in enumerate(inner):
        if quoted[at]:
            continue
        depth += (c in _PAIRS) - (c in _PAIRS.values())
        if c == "," and not depth:
            parts.append(inner[last:at])
            last = at + 1
    parts.append(inner[last:])
    return [p.strip() for p in parts if p.strip()]


def name_of(part: str) -> str:
    return re.split(r"[:=\s]", part.lstrip("*&").strip(), maxsplit=1)[0]


def _in_brackets(change: Callable[[list[str]], list[str]]) -> Edit:
    def edit(node, text, source):
        found = brackets(text)
        if not found:
            return text
        a, b = found
        parts = split_list(text[a + 1 : b])
        new = change(parts)
        return text if new == parts else text[: a + 1] + ", ".join(new) + text[b:]

    return edit


def add_item(spec: str) -> Edit:
    return _in_brackets(lambda parts: [*parts, spec.strip()])


def remove_item(name: str) -> Edit:
    return _in_brackets(lambda parts: [p for p in parts if name_of(p) != name])


def replace(code: str) -> Edit:
    return lambda node, text, source: reindent(code, indent_of(text.split("\n")[0]))


def substitute(old: str, new: str) -> Edit:
    return lambda node, text, source: text.replace(old, new)


def remove() -> Edit:
    return lambda node, text, source: ""


def rename(new: str) -> Edit:
    def edit(node, text, source):
        old = node.get("name")
        return re.sub(rf"(?<!\w){re.escape(old)}(?!\w)", lambda m: new, text, count=1) if old else text

    return edit


def body_start(lines: list[str]) -> int:
    """The first line of a definition's body: after the colon or brace that ends its head."""
    text = "\n".join(lines)
    quoted, depth = _quotes(text), 0
    for at, c in enumerate(text):
        if quoted[at]:
            continue
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif not depth and (c == "{" or c == ":" and text[at + 1 :].split("\n", 1)[0].split("#")[0].strip() == ""):
            return text.count("\n", 0, at) + 1
    return min(1, len(lines))


def _frame(lines: list[str]) -> tuple[int, int, str]:
    """First and last line of the body (the last exclusive), and its indent."""
    start, end = body_start(lines), len(lines)
    while end > start and not lines[end - 1].strip():
        end -= 1
    outer = indent_of(lines[0])
    if end > start and lines[end - 1].strip() in ("}", "};") and indent_of(lines[end - 1]) == outer:
        end -= 1
    inner = next((indent_of(x) for x in lines[start:end] if x.strip()), outer + "    ")
    return start, end, inner


def prepend(code: str) -> Edit:
    def edit(node, text, source):
        lines = text.split("\n")
        start, _, indent = _frame(lines)
        return "\n".join([*lines[:start], reindent(code, indent), *lines[start:]])

    return edit


def append(code: str) -> Edit:
    def edit(node, text, source):
        lines = text.split("\n")
        _, end, indent = _frame(lines)
        return "\n".join([*lines[:end], reindent(code, indent), *lines[end:]])

    return edit


def clear_body(with_: str = "pass") -> Edit:
    def edit(node, text, source):
        lines = text.split("\n")
        start, end, indent = _frame(lines)
        return "\n".join([*lines[:start], *([indent + with_] if node.get("language") == "python" else []), *lines[end:]])

    return edit


def wrap(before: str, after: str = "") -> Edit:
    def edit(node, text, source):
        lines = text.split("\n")
        indent = indent_of(lines[0])
        inside = ["    " + x if x.strip() else x for x in lines]
        return "\n".join([indent + before.strip(), *inside, *([indent + after.strip()] if after.strip() else [])])

    return edit


def unwrap() -> Edit:
    def edit(node, text, source):
        lines = text.split("\n")
        return text if len(lines) < 3 else reindent("\n".join(lines[1:-1]), indent_of(lines[0]))

    return edit


def beside(code: str, start: int, end: int, after: bool) -> Edit:
    """Code before or after the lines of an anchor, which are counted in the node's text."""

    def edit(node, text, source):
        lines = text.split("\n")
        at = end if after else start - 1
        return "\n".join([*lines[:at], reindent(code, indent_of(lines[start - 1])), *lines[at:]])

    return edit


_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@")


def patch(content: str) -> Edit:
    """A unified diff of the node's text, whose context must fit; other content replaces the text."""

    def edit(node, text, source):
        if not any(_HUNK.match(x) for x in content.splitlines()):
            return replace(content)(node, text, source)
        lines, out, at = text.split("\n"), [], 0
        rows = iter(content.split("\n"))
        row = next(rows, None)
        while row is not None:
            m = _HUNK.match(row)
            if not m:
                row = next(rows, None)
                continue
            start = max(int(m[1]) - 1, 0)
            if start < at:
                raise PatchError("hunks overlap")
            out += lines[at:start]
            at = start
            left = int(m[2]) if m[2] is not None else 1
            row = next(rows, None)
            while row is not None and not _HUNK.match(row) and (row[:1] in " +-\\" and row or left > 0):
                kind, line = (row[0], row[1:]) if row else (" ", "")
                if kind == "+":
                    out.append(line)
                elif kind in " -":
                    if at >= len(lines) or lines[at] != line:
                        raise PatchError(f"line {at + 1} isn't {line!r}")
                    out += [line] if kind == " " else []
                    at += 1
                    left -= 1
                row = next(rows, None)
        return "\n".join(out + lines[at:])

    return edit


def splice(source: str, edits: list[tuple[dict, Edit]]) -> str:
    """A file with all edits done, from the last to the first; of nodes that overlap, the one that begins later is edited."""
    lines = source.split("\n")
    taken = len(lines) + 1
    for node, edit in sorted(edits, key=lambda e: (e[0]["start_line"], e[0]["end_line"]), reverse=True):
        start, end = node["start_line"], node["end_line"]
        if end >= taken:
            continue
        taken = start
        old = "\n".join(lines[start - 1 : end])
        new = edit(node, old, source)
        if new != old:
            lines[start - 1 : end] = new.split("\n") if new else []
    return "\n".join(lines)
