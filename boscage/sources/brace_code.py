"""Trees of languages whose blocks stand in braces, by their tokens.

No grammar of any one language is followed. A block is named by the head before
its brace: a class-like word, a function's name and parameters, a control word, or nothing.
Within heads and statements, calls, names, strings, numbers and comments are nodes.
Brackets that don't match make an ERROR node.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

from ..schema import DEFINITION, REFERENCE, SCOPED
from .trees import Node


@dataclass(frozen=True)
class Manner:
    """How a language writes what is told apart here."""

    language: str
    #: Where a parameter's type stands: after a colon, after the name, or before it.
    types: str = "colon"
    #: Whether a line's end may end a statement.
    lines: bool = True
    quotes: str = "\"'"
    #: Beginning of a comment to the end of its line.
    comment: str = r"//"


MANNERS = {
    m.language: m
    for m in (
        Manner("javascript", quotes="\"'`"), Manner("typescript", quotes="\"'`"), Manner("java", "before", False), Manner("c", "before", False), Manner("cpp", "before", False), Manner("csharp", "before", False),
        Manner("go", "after", quotes="\"'`"), Manner("rust", "colon", False, '"'), Manner("kotlin", "colon"), Manner("swift", "colon", quotes='"'), Manner("php", "before", False, comment=r"//|\#(?!\[)"), Manner("scala", "colon"), Manner("dart", "before", False),
    )
}
_CLASS = {"class", "struct", "interface", "trait", "enum", "impl", "object", "record", "protocol", "union"}
_SPACE = {"namespace", "module", "mod", "package"}
_FUNCTION = {"function", "func", "fn", "fun", "def"}
_CONTROL = {
    "if": ("if_statement", "FLOW_CONDITIONAL"), "else": ("else_clause", "FLOW_CONDITIONAL"), "switch": ("switch_statement", "FLOW_CONDITIONAL"), "match": ("match_expression", "FLOW_CONDITIONAL"), "when": ("when_expression", "FLOW_CONDITIONAL"), "select": ("select_statement", "FLOW_CONDITIONAL"),
    "for": ("for_statement", "FLOW_LOOP"), "foreach": ("foreach_statement", "FLOW_LOOP"), "while": ("while_statement", "FLOW_LOOP"), "do": ("do_statement", "FLOW_LOOP"), "loop": ("loop_expression", "FLOW_LOOP"),
    "try": ("try_statement", "ERROR_TRY"), "catch": ("catch_clause", "ERROR_CATCH"), "finally": ("finally_clause", "ERROR_FINALLY"), "synchronized": ("synchronized_statement", "FLOW_SYNC"), "unsafe": ("unsafe_block", "ORGANIZATION_BLOCK"),
}
_STATEMENT = {"return": ("return_statement", "FLOW_JUMP"), "break": ("break_statement", "FLOW_JUMP"), "continue": ("continue_statement", "FLOW_JUMP"), "yield": ("yield_statement", "FLOW_JUMP"), "throw": ("throw_statement", "ERROR_THROW"), "import": ("import_statement", "EXTERNAL_IMPORT"), "use": ("use_declaration", "EXTERNAL_IMPORT"), "using": ("using_directive", "EXTERNAL_IMPORT"), "export": ("export_statement", "EXTERNAL_EXPORT")}
_VARIABLE = {"let", "var", "const", "val", "final"}
_NOT_CALLED = set(_CONTROL) | _CLASS | _FUNCTION | {"return", "throw", "new", "sizeof", "await", "yield", "typeof", "in", "of", "and", "or", "not", "super", "assert", "import"}
_PAIR = {"(": ")", "[": "]", "{": "}"}


@dataclass(slots=True)
class _Token:
    kind: str  # name, string, number, comment, directive, mark
    text: str
    line: int
    end: int
    #: Whether a line ended since the token before.
    fresh: bool = False


@functools.cache
def _token(manner: Manner) -> re.Pattern:
    strings = "|".join(rf"{q}(?:\\.|[^{q}\\{'' if q == '`' else chr(92) + 'n'}])*{q}?" for q in manner.quotes)
    return re.compile(rf"(?P<blank>\s+)|(?P<comment>(?:{manner.comment})[^\n]*|/\*.*?(?:\*/|\Z))|(?P<directive>^[ \t]*\#[ \t]*\w+[^\n]*)|(?P<string>{strings})|(?P<number>\d[\w.]*)|(?P<name>[^\W\d][\w$]*|\$[\w$]*)|(?P<mark>=>|->|::|\S)", re.S | re.M)


def _tokens(text: str, manner: Manner) -> list[_Token]:
    out, line, fresh = [], 1, True
    for m in _token(manner).finditer(text):
        kind, said = m.lastgroup, m[0]
        if kind == "blank":
            n = said.count("\n")
            fresh |= n > 0
        else:
            n = said.count("\n") if kind in ("comment", "string", "directive") else 0
            out.append(_Token(kind, said, line, line + n, fresh))
            fresh = False
        line += n
    return out


def _type(texts: list[str]) -> str | None:
    """A type as it is usually written."""
    said = re.sub(r"\s*(::|[<>\[\](),.?&*])\s*", r"\1", " ".join(texts)).replace(",", ", ")
    return said or None


class _Reader:
    def __init__(self, text: str, manner: Manner):
        self.manner, self.lines = manner, text.split("\n")
        every = _tokens(text, manner)
        self.comments = [t for t in every if t.kind == "comment"]
        self.tokens = [t for t in every if t.kind != "comment"]
        self.close = self._matched()

    def _matched(self) -> dict[int, int]:
        """Where each opening bracket is closed; one that isn't is left out."""
        close, stack = {}, []
        self.stray: list[int] = []
        for k, t in enumerate(self.tokens):
            if t.kind != "mark":
                continue
            if t.text in _PAIR:
                stack.append(k)
            elif t.text in ")]}":
                if stack and _PAIR[self.tokens[stack[-1]].text] == t.text:
                    close[stack.pop()] = k
                else:
                    self.stray.append(k)
        self.stray += stack
        return close

    def peek(self, line: int) -> str:
        return self.lines[line - 1].strip()

    def leaf(self, t: _Token) -> Node | None:
        if t.kind == "name":
            return Node("identifier", "NAME_IDENTIFIER", t.line, t.end, t.text, REFERENCE, t.text)
        if t.kind == "string":
            return Node("string", "LITERAL_STRING", t.line, t.end, None, 0, t.text)
        if t.kind == "number":
            return Node("number", "LITERAL_NUMBER", t.line, t.end, None, 0, t.text)
        return None

    def inside(self, a: int, b: int, into: Node) -> None:
        """Statements of the tokens from a up to b, as children; nested ones are put on a list, so depth has no limit."""
        todo = [(a, b, into)]
        while todo:
            a, b, into = todo.pop()
            start, k = a, a
            while k < b:
                t = self.tokens[k]
                if t.text == "{" and k in self.close and self.tokens[start].text in ("import", "use") and k > start:
                    k = self.close[k] + 1
                elif t.kind == "mark" and t.text == "{" and k in self.close:
                    head = self.head(start, k)
                    head.end = self.tokens[self.close[k]].line
                    into.add(head)
                    body = Node("block", "ORGANIZATION_BLOCK", t.line, head.end, peek=self.peek(t.line))
                    head.add(body)
                    todo.append((k + 1, self.close[k], body))
                    k = start = self.close[k] + 1
                elif t.kind == "mark" and t.text in "([" and k in self.close and self.close[k] < b:
                    k = self.close[k] + 1 if not self._braces(k) else k + 1
                elif t.kind == "directive":
                    self.statement(start, k, into)
                    included = re.search(r"""[<"]([^>"]+)[>"]""", t.text)
                    into.add(Node("preproc_include" if included else "preproc", "EXTERNAL_IMPORT" if included else "METADATA_DIRECTIVE", t.line, t.end, included and included[1], DEFINITION if included else 0, t.text.strip()))
                    k = start = k + 1
                elif t.text == ";" and self.tokens[start].text == "for" and self.manner.language == "go":
                    k += 1
                elif t.kind == "mark" and t.text in ";,":
                    self.statement(start, k, into)
                    k = start = k + 1
                elif self.manner.lines and t.fresh and k > start and not self._goes_on(k):
                    self.statement(start, k, into)
                    start = k
                    k += 1
                else:
                    k += 1
            self.statement(start, b, into)

    def _braces(self, k: int) -> bool:
        """Whether a bracket holds a block."""
        return any(self.tokens[j].text == "{" and j in self.close for j in range(k + 1, self.close[k]))

    def _goes_on(self, k: int) -> bool:
        before, now = self.tokens[k - 1], self.tokens[k]
        return (before.kind == "mark" and before.text not in ")]};") or (now.kind == "mark" and now.text not in "([{@")

    def parameters(self, a: int, b: int) -> list[dict]:
        """Names and types of what stands between commas."""
        out, part, k = [], [], a
        while k <= b:
            t = self.tokens[k] if k < b else None
            if t is None or (t.text == "," and t.kind == "mark"):
                if part:
                    out.append(self._parameter(part))
                part = []
            elif t.kind == "mark" and t.text in _PAIR and k in self.close:
                part += self.tokens[k : self.close[k] + 1]
                k = self.close[k]
            else:
                part.append(t)
            k += 1
        return out

    def _parameter(self, part: list[_Token]) -> dict:
        texts = [t.text for t in part]
        if "=" in texts:
            part = part[: texts.index("=")] or part
            texts = [t.text for t in part]
        names = [k for k, t in enumerate(part) if t.kind == "name"]
        if not names:
            return {"name": "".join(texts), "type": None}
        if ":" in texts:
            at = texts.index(":")
            before = [part[k].text for k in names if k < at]
            return {"name": before[-1] if before else texts[0], "type": _type(texts[at + 1 :])}
        if self.manner.types == "after":
            return {"name": part[names[0]].text, "type": _type(texts[names[0] + 1 :])}
        last = names[-1]
        return {"name": part[last].text, "type": _type(texts[:last]) if self.manner.types == "before" else None}

    def head(self, a: int, brace: int) -> Node:
        """What the block at a brace is."""
        tokens, line = self.tokens[a:brace], self.tokens[a].line if a < brace else self.tokens[brace].line
        names = [(k, t.text) for k, t in enumerate(tokens) if t.kind == "name"]
        words = [w for _, w in names]
        peek = self.peek(line)

        def after(word: str) -> str | None:
            k = words.index(word)
            return words[k + 1] if k + 1 < len(words) else None

        round_at = next((k for k, t in enumerate(tokens) if t.text == "(" and a + k in self.close), None)
        known = next((w for w in words if w in _CLASS | _SPACE | _FUNCTION or w in _CONTROL), None)
        if known in _CLASS and not (round_at is not None and names and known != words[0] and words.index(known) > 0 and names[words.index(known)][0] > round_at):
            name = after(known) or (words[words.index(known) - 1] if words.index(known) else None)
            return self._defined(Node(f"{known}_declaration", "DEFINITION_CLASS", line, line, name, DEFINITION | SCOPED, peek), a, brace)
        if known in _SPACE:
            return self._defined(Node(f"{known}_declaration", "DEFINITION_MODULE", line, line, after(known), DEFINITION | SCOPED, peek), a, brace)
        if known in _CONTROL and (known not in ("match", "when", "select", "do", "loop") or words[0] == known or round_at is None):
            kind, semantic = _CONTROL[known]
            out = Node(kind, semantic, line, line, None, 0, peek)
            self.expressions(a, brace, out)
            return out
        name = None
        arrow = next((k for k, t in enumerate(tokens) if t.text == "=>" and k == len(tokens) - 1), None)
        if known in _FUNCTION:
            at = names[words.index(known)][0] + 1
            if self.manner.language == "go" and at < len(tokens) and tokens[at].text == "(" and a + at in self.close:  # a receiver
                at = self.close[a + at] - a + 1
            while at < len(tokens) and tokens[at].text in "*&<":
                at += 1
            name = tokens[at].text if at < len(tokens) and tokens[at].kind == "name" else None
            round_at = next((k for k in range(at, len(tokens)) if tokens[k].text == "(" and a + k in self.close), None)
            if name is None and "=" in [t.text for t in tokens]:
                name = self._before_equals(tokens)
        elif arrow is not None:
            name = self._before_equals(tokens)
        elif round_at and tokens[round_at - 1].kind == "name" and tokens[round_at - 1].text not in _NOT_CALLED and "=" not in [t.text for t in tokens[:round_at]] and "." not in [t.text for t in tokens[:round_at]] and "new" not in words:
            name = tokens[round_at - 1].text
        else:
            out = Node("block_statement", "ORGANIZATION_BLOCK", line, line, None, 0, peek)
            self.expressions(a, brace, out)
            return out
        out = Node("function_declaration", "DEFINITION_FUNCTION", line, line, name, DEFINITION | SCOPED, peek)
        if round_at is not None:
            end = self.close[a + round_at]
            out.parameters = self.parameters(a + round_at + 1, end)
            tail = [t.text for t in self.tokens[end + 1 : brace] if t.text not in (":", "->", "=>")]
            before = [t.text for k, t in enumerate(tokens[: max(0, round_at - 1)]) if t.text not in ("@", ";") and (not k or tokens[k - 1].text != "@") and t.text not in ("public", "private", "protected", "static", "final", "async", "abstract", "override", "virtual", "inline", "const", "export", "default", "pub")]
            out.signature = _type(tail if self.manner.types != "before" else before)
        return self._defined(out, a, brace)

    def _before_equals(self, tokens: list[_Token]) -> str | None:
        at = next((k for k, t in enumerate(tokens) if t.text in ("=", ":")), None)
        return tokens[at - 1].text if at and tokens[at - 1].kind == "name" else None

    def _defined(self, out: Node, a: int, brace: int) -> Node:
        out.modifiers = [t.text for t in self.tokens[a:brace] if t.text in ("async", "static", "public", "private", "protected", "abstract", "pub", "export")]
        out.modifiers += ["@" + self.tokens[k + 1].text for k in range(a, brace - 1) if self.tokens[k].text == "@"]
        if out.name:
            line = next((t.line for t in self.tokens[a:brace] if t.text == out.name), out.start)
            out.add(Node("identifier", "NAME_IDENTIFIER", line, line, out.name, 0, out.name))
        if out.parameters:
            listing = Node("parameters", "ORGANIZATION_LIST", out.start, out.start, peek="parameters")
            out.add(listing.add(*[Node("parameter", "DEFINITION_VARIABLE", out.start, out.start, p["name"], DEFINITION, p["name"]) for p in out.parameters]))
        return out

    def statement(self, a: int, b: int, into: Node) -> None:
        if a >= b:
            return
        first, line, end = self.tokens[a], self.tokens[a].line, self.tokens[b - 1].end
        word = first.text if first.kind == "name" else ""
        texts = [t.text for t in self.tokens[a:b]]
        if word in _STATEMENT:
            kind, semantic = _STATEMENT[word]
            out = Node(kind, semantic, line, end, None, 0, self.peek(line))
            if semantic == "EXTERNAL_IMPORT":
                said = next((t.text.strip("\"'`") for t in reversed(self.tokens[a:b]) if t.kind == "string"), None)
                out.name, out.flags = said or "".join(x for x in texts[1:] if x not in "{}*"), DEFINITION
        elif word in _VARIABLE or ("=" in texts and texts.index("=") > 0):
            out = Node("variable_declaration" if word in _VARIABLE else "assignment_expression", "DEFINITION_VARIABLE" if word in _VARIABLE else "OPERATOR_ASSIGNMENT", line, end, None, 0, self.peek(line))
            at = texts.index("=") if "=" in texts else len(texts)
            named = [t.text for t in self.tokens[a : a + at] if t.kind == "name" and t.text not in _VARIABLE | {"mut"}]
            if named:
                out.name, out.flags = named[0] if self.manner.types != "before" or word in _VARIABLE and len(named) == 1 else named[-1], DEFINITION
        else:
            out = Node("expression_statement", "EXECUTION_STATEMENT", line, end, None, 0, self.peek(line))
        self.expressions(a, b, out)
        into.add(out)

    def expressions(self, a: int, b: int, into: Node) -> None:
        """Calls and leaves of the tokens from a up to b; a call holds what stands in its brackets."""
        ends: list[tuple[int, Node]] = []
        for k in range(a, b):
            while ends and k >= ends[-1][0]:
                ends.pop()
            here = ends[-1][1] if ends else into
            t = self.tokens[k]
            if t.kind == "name" and t.text not in _NOT_CALLED and k + 1 < b and self.tokens[k + 1].text == "(" and k + 1 in self.close:
                to = self.close[k + 1]
                call = Node("call_expression", "COMPUTATION_CALL", t.line, self.tokens[to].line, t.text, REFERENCE, self.peek(t.line))
                here.add(call.add(self.leaf(t)))
                ends.append((to, call))
            else:
                here.add(self.leaf(t))


def parse(text: str, path: str, language: str) -> Node:
    reader = _Reader(text, MANNERS[language])
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    root = Node("program", "DEFINITION_MODULE", 1, max(1, len(text.splitlines())), stem, DEFINITION | SCOPED, text.lstrip().split("\n", 1)[0])
    reader.inside(0, len(reader.tokens), root)
    root.add(*[Node("ERROR", "PARSER_CONSTRUCT", reader.tokens[k].line, reader.tokens[k].line, peek=f"no partner for {reader.tokens[k].text}") for k in reader.stray])
    root.add(*[Node("comment", "METADATA_COMMENT", t.line, t.end, None, 0, t.text) for t in reader.comments])
    root.children.sort(key=lambda n: n.start)
    return root
