"""Selectors: text to a small tree, and that to windows and filters over a table of nodes.

    selector   := complex (',' complex)*
    complex    := compound (combinator compound)* ('::' name)?
    combinator := blank | '>' | '+' | '~'
    compound   := ('*' | type)? ('.' class | '#' name | '[' attribute op value ']' | ':' pseudo ('(' args ')')?)*

A selector is evaluated over whole trees at once. Each compound is a Column; each
combinator and ``:has`` marks nodes by one running extreme or lag over the tree,
so ``A B C`` is one pass by file and not a chain of self-joins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import nav
from ..functions.predicates import BUILT_IN, Registry, SelectorArgumentError, SelectorError
from .vocabulary import semantic_name

_IDENT = re.compile(r"[^\W\d][\w-]*|_[\w-]*")
_OPS = ("^=", "$=", "*=", ">=", "<=", "=", ">", "<")


@dataclass
class Compound:
    type: str | None = None
    classes: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    attributes: list[tuple[str, str, str]] = field(default_factory=list)
    #: Name and what stands in the parentheses: arguments or selectors.
    pseudos: list[tuple[str, object]] = field(default_factory=list)


@dataclass
class Complex:
    parts: list[Compound]
    combinators: list[str]
    element: str | None = None


NESTED = {"has", "not", "is", "where"}
GRAPH = {"calls", "called-by", "is-called", "is-referenced", "unreferenced"}
ELEMENTS = {"callers", "callees", "references", "scope", "parent", "parent-definition", "next-sibling", "prev-sibling"}


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self, why: str):
        raise SelectorError(f"{why} at {self.at} of {self.text!r}")

    def more(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self, token: str) -> bool:
        if self.text.startswith(token, self.at):
            self.at += len(token)
            return True
        return False

    def blanks(self) -> bool:
        start = self.at
        while self.more().isspace():
            self.at += 1
        return self.at > start

    def ident(self) -> str:
        m = _IDENT.match(self.text, self.at)
        if not m:
            self.fail("a name is missing")
        self.at = m.end()
        return m[0]

    def quoted(self) -> str:
        quote = self.more()
        self.at += 1
        out = []
        while self.more() != quote:
            if not self.more():
                self.fail("a quote is open")
            if self.take("\\") and not self.more():
                self.fail("a quote is open")
            out.append(self.more())
            self.at += 1
        self.at += 1
        return "".join(out)

    def value(self, end: str) -> str:
        self.blanks()
        if self.more() in "'\"" and self.more():
            out = self.quoted()
            self.blanks()
            return out
        start = self.at
        while self.more() and self.more() not in end:
            self.at += 1
        return self.text[start : self.at].strip()

    def selectors(self, end: str = "") -> list[Complex]:
        out = []
        while True:
            out.append(self.complex(end))
            if not self.take(","):
                return out

    def complex(self, end: str) -> Complex:
        self.blanks()
        found = Complex([self.compound()], [])
        while True:
            if self.text.startswith("::", self.at):
                self.at += 2
                found.element = self.ident()
                if found.element not in ELEMENTS:
                    raise SelectorError(f"::{found.element} is unknown")
                self.blanks()
                return found
            blank = self.blanks()
            c = self.more()
            if not c or c in end or c == ",":
                return found
            if c in ">+~":
                self.at += 1
                self.blanks()
            elif blank:
                c = " "
            else:
                self.fail(f"unexpected {c!r}")
            found.combinators.append(c)
            found.parts.append(self.compound())

    def compound(self) -> Compound:
        out, start = Compound(), self.at
        if self.take("*"):
            out.type = "*"
        elif _IDENT.match(self.text, self.at):
            out.type = self.ident()
        while True:
            if self.take("."):
                out.classes.append(self.ident())
            elif self.take("#"):
                out.names.append(self.ident())
            elif self.take("["):
                self.blanks()
                name = self.ident()
                self.blanks()
                op = next((o for o in _OPS if self.take(o)), None) or self.fail("a comparison is missing")
                out.attributes.append((name, op, self.value("]")))
                if not self.take("]"):
                    self.fail("']' is missing")
            elif self.more() == ":" and not self.text.startswith("::", self.at):
                self.at += 1
                out.pseudos.append(self.pseudo())
            else:
                break
        if self.at == start:
            self.fail("a selector is missing")
        return out

    def pseudo(self) -> tuple[str, object]:
        name = self.ident()
        if not self.take("("):
            if name in NESTED:
                raise SelectorArgumentError(f":{name} needs a selector")
            return name, []
        if name in NESTED:
            inside = self.selectors(")")
        else:
            inside = []
            self.blanks()
            while self.more() != ")":
                inside.append(self.value(",)"))
                if not self.take(",") and self.more() != ")":
                    self.fail("')' is missing")
        if not self.take(")"):
            self.fail("')' is missing")
        return name, inside


def parse(text: str) -> list[Complex]:
    if not isinstance(text, str) or not text.strip():
        raise SelectorError("an empty selector")
    reader = _Reader(text)
    found = reader.selectors()
    reader.blanks()
    if reader.more():
        reader.fail(f"unexpected {reader.more()!r}")
    return found


class Selector(str):
    """Text that was read as a selector once."""

    def __new__(cls, text: str):
        parse(text)
        return super().__new__(cls, text)

    @property
    def tree(self) -> list[Complex]:
        return parse(self)


_NUMERIC = {"params": lambda: F.size("parameters"), "lines": lambda: F.col("end_line") - F.col("start_line") + 1}


def _attribute(name: str, op: str, value: str) -> Column:
    if op in (">=", "<=", ">", "<") or name in _NUMERIC:
        column = _NUMERIC[name]() if name in _NUMERIC else F.col(name)
        try:
            number = int(value)
        except ValueError:
            raise SelectorArgumentError(f"[{name}{op}{value}] needs a number") from None
        return {">=": column >= number, "<=": column <= number, ">": column > number, "<": column < number, "=": column == number}[op]
    if name not in ("name", "type", "language", "semantic_name", "qualified_name", "file_path", "peek", "signature_type"):
        raise SelectorArgumentError(f"[{name}] is no attribute")
    column = F.col(name)
    return {"=": column == value, "^=": column.startswith(value), "$=": column.endswith(value), "*=": column.contains(value)}[op]


class _Marks:
    """A table of nodes that gains columns of marks as a selector is evaluated."""

    def __init__(self, nodes: DataFrame, registry: Registry):
        self.df, self.registry, self.n = nodes, registry, 0

    def add(self, mark: Column) -> Column:
        name = f"_mark{self.n}"
        self.n += 1
        self.df = self.df.withColumn(name, mark)
        return F.col(name)

    def any(self, selectors: list[Complex]) -> Column:
        out = None
        for s in selectors:
            if s.element:
                raise SelectorError(f"::{s.element} can't stand inside parentheses or a list")
            found = self.complex(s)
            out = found if out is None else out | found
        return out

    def complex(self, s: Complex) -> Column:
        mark = self.compound(s.parts[0])
        for combinator, part in zip(s.combinators, s.parts[1:]):
            mark = self.add(mark)
            if combinator == ">":
                parent = self.df.where(mark).select("file_path", F.col("node_id").alias("parent_id"), F.lit(True).alias(f"_child{self.n}"))
                self.df = self.df.join(parent, ["file_path", "parent_id"], "left")
                related = self.add(nav.truth(F.col(f"_child{self.n}")))
            else:
                related = self.add({" ": nav.below, "+": nav.next_to_sibling, "~": nav.after_sibling}[combinator](mark))
            mark = related & self.compound(part)
        return mark

    def compound(self, c: Compound) -> Column:
        out = F.lit(True)
        if c.type and c.type != "*":
            out &= F.col("type") == c.type
        for cls in c.classes:
            name = semantic_name(cls)
            out &= F.col("semantic_name").startswith(name) if name.endswith("_") else F.col("semantic_name") == name
        for name in c.names:
            out &= F.col("name") == name
        for a in c.attributes:
            out &= _attribute(*a)
        for name, inside in c.pseudos:
            out &= self.pseudo(name, inside)
        return nav.truth(out)

    def pseudo(self, name: str, inside) -> Column:
        if name == "has":
            return self.add(nav.above(self.add(self.any(inside))))
        if name == "not":
            return ~self.any(inside)
        if name in ("is", "where"):
            return self.any(inside)
        if name == "calls":
            return self.add(nav.above(self.add((F.col("semantic_name") == "COMPUTATION_CALL") & (F.col("name") == self.one(name, inside)))))
        if name == "called-by":
            return (F.col("semantic_name") == "COMPUTATION_CALL") & self.add(nav.below(self.add((F.col("semantic_name") == "DEFINITION_FUNCTION") & (F.col("name") == self.one(name, inside)))))
        if name in ("is-called", "is-referenced", "unreferenced"):
            used = self.df.where((F.col("semantic_name") == "COMPUTATION_CALL") if name == "is-called" else F.col("flags").bitwiseAND(6) == 2)
            mark = f"_used{self.n}"
            self.n += 1
            self.df = self.df.join(used.where("name IS NOT NULL").select("name").distinct().withColumn(mark, F.lit(True)), "name", "left")
            hit = nav.truth(F.col(mark))
            return ~hit & (F.col("flags").bitwiseAND(6) == 6) if name == "unreferenced" else hit & (F.col("flags").bitwiseAND(6) == 6)
        if name == "scope" and inside:
            return self.add(nav.below(self.add(self.any(parse(inside[0])))))
        known = self.registry.get(name)
        if known is None:
            raise SelectorError(f":{name} is unknown")
        return known.column(inside)

    def one(self, name: str, inside: list[str]) -> str:
        if len(inside) != 1:
            raise SelectorArgumentError(f":{name} takes 1 argument(s), not {len(inside)}")
        return inside[0]


def select(nodes: DataFrame, selector: str, registry: Registry = BUILT_IN) -> DataFrame:
    """The rows of ``nodes`` (whole trees) that the selector matches, each once."""
    columns = nodes.columns
    found = parse(selector)
    plain = [s for s in found if not s.element]
    out = None
    if plain:
        marks = _Marks(nodes, registry)
        hit = marks.any(plain)
        out = marks.df.where(hit).select(columns)
    for s in found:
        if s.element:
            part = element(nodes, _chosen(nodes, s, registry), s.element).select(columns)
            out = part if out is None else out.unionByName(part)
    return out if len(found) == 1 or not any(s.element for s in found) else out.dropDuplicates(["file_path", "node_id"])


def _chosen(nodes: DataFrame, s: Complex, registry: Registry) -> DataFrame:
    marks = _Marks(nodes, registry)
    hit = marks.complex(s)
    return marks.df.where(hit).select(nodes.columns)


def element(nodes: DataFrame, chosen: DataFrame, name: str) -> DataFrame:
    """The nodes that a pseudo-element leads to from the chosen ones."""
    from ..operators import graph

    if name == "parent":
        return nav.parents_of(nodes, chosen)
    if name == "next-sibling":
        return nav.beside(nodes, chosen, 1)
    if name == "prev-sibling":
        return nav.beside(nodes, chosen, -1)
    if name == "parent-definition":
        return nav.nearest_ancestors_of(nodes.where(F.col("semantic_name").startswith("DEFINITION_") & (F.col("flags").bitwiseAND(6) == 6)), chosen)
    return {"callers": graph.callers, "callees": graph.callees, "references": graph.references, "scope": graph.scopes}[name](nodes, chosen)
