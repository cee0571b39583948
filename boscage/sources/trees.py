"""Building trees in workers: a small node class, and its numbering into rows."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.vocabulary import NUMBERS
from ..schema import NODE, SCOPED


class Node:
    __slots__ = ("type", "semantic", "flags", "name", "peek", "start", "end", "children", "parameters", "modifiers", "signature", "annotations")

    def __init__(self, type, semantic=None, start=1, end=1, name=None, flags=0, peek=None, parameters=None, modifiers=(), signature=None, annotations=None):
        self.type, self.semantic, self.start, self.end, self.name, self.flags, self.peek = type, semantic, start, end, name, flags, peek
        self.parameters, self.modifiers, self.signature, self.annotations = parameters, list(modifiers), signature, annotations
        self.children: list[Node] = []

    def add(self, *children: Node | None) -> Node:
        self.children += [c for c in children if c is not None]
        return self


def _numbered(root: Node, kinds: dict[tuple, int], scopes: list[tuple]) -> tuple[list[tuple], list[int]]:
    """All nodes of a tree in pre-order, and how many lie below each. No recursion, so depth has no limit.

    A node's kind and scope are places in ``kinds`` and ``scopes``, as many nodes share one.
    """
    out: list[tuple] = []
    above: list[int] = []
    none = (None, None, None, None, ())
    scopes.append(none)
    # (node, parent id, depth, place, scope: its place and current, function, class, module, stack, qualified name)
    todo = [(root, None, 0, 0, len(scopes) - 1, none, "")]
    while todo:
        node, parent, depth, place, at, scope, prefix = todo.pop()
        me, name, children, semantic = len(out), node.name, node.children, node.semantic
        qualified = f"{prefix}.{name}" if prefix and name else name
        kind = kinds.setdefault((node.type, semantic), len(kinds))
        out.append((me, parent, depth, place, len(children), kind, node.flags, name, qualified, node.peek, node.signature, node.annotations, node.start, node.end, node.parameters, node.modifiers, at))
        above.append(-1 if parent is None else parent)
        if not children:
            continue
        if node.flags & SCOPED:
            _, function, cls, module, stack = scope
            scope = (me, me if semantic == "DEFINITION_FUNCTION" else function, me if semantic == "DEFINITION_CLASS" else cls, me if semantic == "DEFINITION_MODULE" else module, (*stack, me))
            scopes.append(scope)
            at = len(scopes) - 1
            prefix = qualified if semantic != "DEFINITION_MODULE" else prefix
        depth += 1
        for k in range(len(children) - 1, -1, -1):
            todo.append((children[k], me, depth, k, at, scope, prefix))
    below = [0] * len(out)
    for k in range(len(out) - 1, 0, -1):
        below[above[k]] += below[k] + 1
    return out, below


class _Batch:
    """Nodes of several trees on their way to Arrow; what many nodes share is written once and taken by its place."""

    def __init__(self, schema: pa.Schema):
        self.schema = schema
        self.nodes: list[tuple] = []
        self.below: list[int] = []
        self.files: list[tuple[str, str, int]] = []
        self.kinds: dict[tuple, int] = {}
        self.scopes: list[tuple] = []

    def __len__(self) -> int:
        return len(self.nodes)

    def add(self, root: Node, file_path: str, language: str) -> None:
        nodes, below = _numbered(root, self.kinds, self.scopes)
        self.nodes += nodes
        self.below += below
        self.files.append((file_path, language, len(nodes)))

    def arrow(self) -> pa.RecordBatch:
        names = ("node_id", "parent_id", "depth", "sibling_index", "children_count", "kind", "flags", "name", "qualified_name", "peek", "signature_type", "annotations", "start_line", "end_line", "parameters", "modifiers", "scope")
        columns = dict(zip(names, zip(*self.nodes)))
        paths, languages, counts = zip(*self.files)
        file, kind, scope = (pa.array(x, pa.int32()) for x in (np.repeat(np.arange(len(counts), dtype=np.int32), counts), columns.pop("kind"), columns.pop("scope")))
        types, semantics = zip(*self.kinds)
        shared = {
            "file_path": (paths, file),
            "language": (languages, file),
            "type": (types, kind),
            "semantic_name": (semantics, kind),
            "semantic_type": ([NUMBERS.get(s) if s else None for s in semantics], kind),
            "scope": ([{"current": c, "function": f, "class": k, "module": m, "stack": list(s)} for c, f, k, m, s in self.scopes], scope),
        }
        columns["descendant_count"] = self.below
        arrays = [pa.array(shared[f.name][0], f.type).take(shared[f.name][1]) if f.name in shared else pa.array(columns[f.name], f.type) for f in self.schema]
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


#: Nodes that a worker hands on together.
BATCH = 20_000


def parsed(files: DataFrame, parse: Callable[[str, str], Node], language: str) -> DataFrame:
    """Nodes of all files (file_path, text), parsed in workers, a file at a time; null texts have none."""
    return parsed_by(files, lambda path: (parse, language))


def parsed_by(files: DataFrame, parser_of: Callable[[str], tuple[Callable[[str, str], Node], str]]) -> DataFrame:
    """The same with the parser and language that each path asks for."""
    arrow = to_arrow_schema(NODE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, collects = _Batch(arrow), gc.isenabled()
        gc.disable()  # trees have no cycles, and looking for some takes a third of the time
        try:
            for frame in batches:
                for path, text in zip(frame.column("file_path").to_pylist(), frame.column("text").to_pylist()):
                    if text is not None:
                        parse, language = parser_of(path)
                        found.add(parse(text, path), path, language)
                    if len(found) >= BATCH:
                        yield found.arrow()
                        found = _Batch(arrow)
                        gc.collect(1)
            if len(found):
                yield found.arrow()
        finally:
            if collects:
                gc.enable()

    return files.select("file_path", "text").mapInArrow(run, NODE)
