"""Blocks taken out of their file: which names they need from outside, in one pass over each file's names."""

from __future__ import annotations

import bisect
import builtins
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import nav
from . import view

_BUILT_IN = frozenset(dir(builtins))
_DECLARED = ["global_statement", "nonlocal_statement"]
_IMPORTS = ["import_statement", "import_from_statement"]
_FREE = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("node_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("params", T.ArrayType(T.StringType())),
        T.StructField("statements", T.ArrayType(T.StructType([T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType())]))),
        T.StructField("builtins", T.ArrayType(T.StringType())),
    ]
)


def _of_file(path: str, rows: list[tuple]) -> Iterator[tuple]:
    """Rows of ``_FREE`` for the chosen nodes (those with ``to``) of one file's rows (node_id, parent_id, name, type, flags, sibling_index, start_line, end_line, to)."""
    chosen = [r for r in rows if r[8] is not None]
    told = sorted((r for r in rows if r[8] is None), key=lambda r: r[0])
    types = {r[0]: r[3] for r in told}
    ids, uses, imported = [], [], {}
    for node, parent, name, kind, flags, place, *_ in told:
        above = types.get(parent)
        role, identifier = (flags or 0) & 6, kind == "identifier"
        if above in _IMPORTS:
            if identifier and role == 6:
                imported.setdefault(name, set()).add(parent)
        elif name:
            read = identifier and role == 2 and not (above == "attribute" and place > 0)
            write = role == 6 or (identifier and above in _DECLARED)
            if read or write:
                ids.append(node)
                uses.append((name, read, write))
    spans = {r[0]: (r[6], r[7]) for r in told if r[3] in _IMPORTS}
    first = {name: spans[min(of, key=lambda n: (spans[n][0], n))] for name, of in imported.items()}
    for node, _, name, _, _, _, start, end, to in chosen:
        inside = uses[bisect.bisect_left(ids, node) : bisect.bisect_right(ids, to)]
        free = {n for n, read, _ in inside if read} - {n for n, _, write in inside if write}
        own = free - _BUILT_IN
        statements = sorted({first[n] for n in own if n in first})
        yield path, node, name, start, end, sorted(own - first.keys()), [{"start_line": a, "end_line": b} for a, b in statements], sorted(free & _BUILT_IN)


def _free_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_FREE`` of rows that lie together by file; a task holds one file at a time."""
    schema = to_arrow_schema(_FREE)
    path, held, out = None, [], []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    for frame in batches:
        for file, *row in zip(*(frame.column(n).to_pylist() for n in ("file_path", "node_id", "parent_id", "name", "type", "flags", "sibling_index", "start_line", "end_line", "to"))):
            if file != path:
                out += _of_file(path, held)
                path, held = file, []
            held.append(tuple(row))
        if out:
            yield batch()
            out = []
    out += _of_file(path, held)
    if out:
        yield batch()


def isolate(nodes: DataFrame, chosen: DataFrame, sources: DataFrame) -> DataFrame:
    """One row for each chosen node: its text, and the free names that are parameters, imports (as statements) and built-ins."""
    fields = ["file_path", "node_id", "parent_id", "name", "type", "flags", "sibling_index", "start_line", "end_line"]
    told = nodes.where((F.col("name") != "") | F.col("type").isin(*_IMPORTS, *_DECLARED, "attribute"))
    both = told.select(*fields, F.lit(None).cast("long").alias("to")).unionByName(chosen.select(*fields, nav.end().alias("to")))
    found = both.repartition("file_path").sortWithinPartitions("file_path").mapInArrow(_free_names, _FREE)
    files = sources.select("file_path", view.lines_of(F.col("text")).alias("_lines")).hint("merge")
    said = F.transform("statements", lambda x: F.struct(x["start_line"].alias("start_line"), F.trim(view.between(F.col("_lines"), x["start_line"], x["end_line"])).alias("statement")))
    imports = F.array_distinct(F.transform(F.sort_array(said), lambda x: x["statement"]))
    return found.join(files, "file_path").select("file_path", "node_id", "name", "start_line", "end_line", view.between(F.col("_lines"), F.col("start_line"), F.col("end_line")).alias("body"), "params", imports.alias("imports"), "builtins")


def as_function(row, name: str = "extracted") -> str:
    """An isolated block as a function of its free names."""
    from ..functions.rewriting import reindent

    head = "\n".join([*row.imports, ""]) if row.imports else ""
    return f"{head}def {name}({', '.join(row.params)}):\n{reindent(row.body, '    ')}\n"


def as_cell(row) -> str:
    """An isolated block as a notebook cell: imports, then free names to fill in, then the block."""
    from ..functions.rewriting import reindent

    parts = ["\n".join(row.imports), "\n".join(f"{p} = ...  # to fill in" for p in row.params), reindent(row.body, "")]
    return "\n\n".join(p for p in parts if p) + "\n"
