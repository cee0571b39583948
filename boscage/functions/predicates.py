"""Pseudo-classes that look at one node only, as Columns; more can be registered."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DECLARATION, DEFINITION, REFERENCE, ROLE, SCOPED, SYNTAX_ONLY


class SelectorError(ValueError):
    """A selector that can't be read."""


class SelectorArgumentError(SelectorError):
    """A pseudo-class with arguments that don't fit."""


class UnknownClassError(SelectorError):
    """A class that no node can have."""


def _bits(mask: int, value: int | None = None) -> Column:
    found = F.col("flags").bitwiseAND(F.lit(mask))
    return found != 0 if value is None else found == value


@dataclass(frozen=True)
class PseudoClass:
    name: str
    build: Callable[..., Column]
    #: Types of its arguments: int or str.
    takes: tuple[type, ...] = ()

    def column(self, args: list[str]) -> Column:
        if len(args) != len(self.takes):
            raise SelectorArgumentError(f":{self.name} takes {len(self.takes)} argument(s), not {len(args)}")
        try:
            return self.build(*[kind(a) for kind, a in zip(self.takes, args)])
        except ValueError as e:
            raise SelectorArgumentError(f":{self.name}({', '.join(args)}): {e}") from None


class Registry:
    """Pseudo-classes by name."""

    def __init__(self):
        self.known: dict[str, PseudoClass] = {}

    def register(self, name: str, build: Callable[..., Column], *takes: type) -> None:
        self.known[name.lstrip(":")] = PseudoClass(name.lstrip(":"), build, takes)

    def get(self, name: str) -> PseudoClass | None:
        return self.known.get(name.lstrip(":"))

    def copy(self) -> Registry:
        new = Registry()
        new.known.update(self.known)
        return new


def _line(n: int) -> Column:
    return (F.col("start_line") <= n) & (F.col("end_line") >= n)


BUILT_IN = Registry()
for _name, _build, *_takes in [
    ("exported", lambda: ~F.col("name").startswith("_")),
    ("private", lambda: F.col("name").startswith("_")),
    ("defines", lambda: _bits(ROLE, DEFINITION)),
    ("references", lambda: _bits(ROLE, REFERENCE)),
    ("declaration", lambda: _bits(ROLE, DECLARATION)),
    ("binds", lambda: _bits(DECLARATION)),
    ("scope", lambda: _bits(SCOPED)),
    ("syntax-only", lambda: _bits(SYNTAX_ONLY)),
    ("first", lambda: F.col("sibling_index") == 0),
    ("first-child", lambda: F.col("sibling_index") == 0),
    ("nth-child", lambda n: F.col("sibling_index") == n - 1, int),
    ("empty", lambda: F.col("children_count") == 0),
    ("contains", lambda s: F.col("peek").contains(s), str),
    ("matches", lambda pattern: F.col("peek").rlike(pattern), str),
    ("line", _line, int),
    ("lines", lambda a, b: (F.col("start_line") >= a) & (F.col("end_line") <= b), int, int),
    ("long", lambda n: F.col("end_line") - F.col("start_line") > n, int),
    ("complex", lambda n: F.col("descendant_count") > n, int),
    ("async", lambda: F.col("peek").startswith("async ")),
    ("decorated", lambda: F.size("modifiers") > 0),
]:
    BUILT_IN.register(_name, _build, *_takes)

def flag_check(name: str) -> Column:
    """The predicate on ``flags`` that a name of the API stands for."""
    checks = {"is_definition": (ROLE, DEFINITION), "is_reference": (ROLE, REFERENCE), "is_declaration": (ROLE, DECLARATION), "binds_name": (DECLARATION,), "is_scope": (SCOPED,), "is_syntax_only": (SYNTAX_ONLY,)}
    if name not in checks:
        raise ValueError(f"unknown flag {name!r}")
    return _bits(*checks[name])


STRING_FIELDS = frozenset({"name", "qualified_name", "type", "semantic_name", "language", "file_path", "peek", "signature_type", "annotations"})
NUMBER_FIELDS = frozenset({"node_id", "parent_id", "depth", "sibling_index", "children_count", "descendant_count", "semantic_type", "flags", "start_line", "end_line"})
_COMPARE = {"gt": "__gt__", "lt": "__lt__", "gte": "__ge__", "lte": "__le__"}
_BOUNDS = {"min_lines": lambda v: F.col("end_line") - F.col("start_line") + 1 >= v, "max_lines": lambda v: F.col("end_line") - F.col("start_line") + 1 <= v, "min_children": lambda v: F.col("children_count") >= v, "min_depth": lambda v: F.col("depth") >= v}


def keyword(field: str, value) -> Column:
    """The predicate of a keyword argument such as ``name__startswith="x"`` or ``depth__gte=2``."""
    if field in _BOUNDS:
        return _BOUNDS[field](value)
    name, _, how = field.partition("__")
    if name not in STRING_FIELDS | NUMBER_FIELDS:
        raise ValueError(f"unknown field {name!r}")
    column = F.col(name)
    if not how:
        return column.isNull() if value is None else column == F.lit(value)
    if how in ("startswith", "endswith", "contains"):
        return getattr(column.cast("string"), how)(F.lit(str(value)))
    if how in _COMPARE:
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise ValueError(f"{field} needs a number, not {value!r}")
        return getattr(column.cast("double") if name in STRING_FIELDS else column, _COMPARE[how])(F.lit(value))
    raise ValueError(f"unknown comparison {how!r}")
