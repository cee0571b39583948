"""Relations between nodes of one tree, as windows and equi-joins.

"Below" and "above" are interval conditions on pre-order ids. They are answered by one
running extreme over each tree in id order, which is linear in the tree, and not by
an interval join, which is quadratic in large trees.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def end() -> Column:
    return F.col("node_id") + F.col("descendant_count")


def _before(*order: str | Column) -> WindowSpec:
    """All nodes of the tree before this one in an order."""
    return Window.partitionBy("file_path").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _family() -> WindowSpec:
    return Window.partitionBy("file_path", "parent_id").orderBy("sibling_index", "node_id")


def truth(x: Column) -> Column:
    """A condition with null as false."""
    return F.coalesce(x, F.lit(False))


def below(flag: Column, *then: str) -> Column:
    """Whether a node lies below one with ``flag``; over all nodes of whole trees. ``then`` orders rows of one node."""
    return truth(F.max(F.when(flag, end())).over(_before("node_id", *then)) >= F.col("node_id"))


def above(flag: Column, *then: str) -> Column:
    """Whether a node with ``flag`` lies below this one."""
    return truth(F.min(F.when(flag, F.col("node_id"))).over(_before(F.desc("node_id"), *then)) <= end())


def after_sibling(flag: Column) -> Column:
    return F.col("parent_id").isNotNull() & truth(F.max(flag).over(_family().rowsBetween(Window.unboundedPreceding, -1)))


def next_to_sibling(flag: Column) -> Column:
    return F.col("parent_id").isNotNull() & truth(F.lag(flag).over(_family()))


def _side(df: DataFrame, **columns: str | Column) -> DataFrame:
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()]).distinct()


def semi(df: DataFrame, other: DataFrame, how: str = "left_semi", **on: str | Column) -> DataFrame:
    """Rows of ``df`` whose columns (keyword names) equal those of a row of ``other`` (values)."""
    return df.join(_side(other, **on), list(on), how)


def children_of(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    return semi(nodes, chosen, file_path="file_path", parent_id="node_id")


def parents_of(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    return semi(nodes, chosen, file_path="file_path", node_id="parent_id")


def _marked(nodes: DataFrame, chosen: DataFrame) -> tuple[DataFrame, Column]:
    """All nodes, with whether they are chosen."""
    marks = _side(chosen, file_path="file_path", node_id="node_id").withColumn("_chosen", F.lit(True))
    return nodes.join(marks, ["file_path", "node_id"], "left"), truth(F.col("_chosen"))


def descendants_of(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """Nodes below a chosen one; ``nodes`` may be a part of the trees."""
    return _kept(nodes, chosen, below)


def ancestors_of(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """Nodes above a chosen one."""
    return _kept(nodes, chosen, above)


def _kept(nodes: DataFrame, chosen: DataFrame, relation) -> DataFrame:
    columns = nodes.columns
    asked = chosen.select("file_path", "node_id", "descendant_count", F.lit(True).alias("_mark"))
    both = nodes.withColumn("_mark", F.lit(False)).unionByName(asked, allowMissingColumns=True)
    # a chosen node's mark comes after the node itself, which lies neither below nor above itself
    return both.withColumn("_hit", relation(F.col("_mark"), "_mark")).where("_hit AND NOT _mark").select(columns)


def innermost(both: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the rows with ``_outer`` that have one with ``_inner`` below them and no other ``_outer`` between.

    One pass over all rows in pre-order with the open nodes on a stack, which is linear in
    the rows; a task holds no more of a tree than the batches with open nodes.
    """
    rows = both.select(*columns, end().alias("_to"), "_outer", "_inner").repartition("file_path").sortWithinPartitions("file_path", "node_id", F.desc("_inner"))

    def run(batches):
        path, opened = None, []  # of each open node: its end, batch and row, and whether it was found
        for batch in batches:
            found = {}
            for k, (file, node, to, outer, inner) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("file_path", "node_id", "_to", "_outer", "_inner")))):
                if file != path:
                    path, opened = file, []
                while opened and opened[-1][0] < node:
                    opened.pop()
                if inner and opened and not opened[-1][3]:
                    opened[-1][3] = True
                    found.setdefault(id(opened[-1][1]), (opened[-1][1], []))[1].append(opened[-1][2])
                if outer:
                    opened.append([to, batch, k, False])
            for held, at in found.values():
                yield held.select(columns).take(pa.array(at, pa.int64()))

    return rows.mapInArrow(run, both.select(*columns).schema)


def nearest_ancestors_of(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """Of the nodes above each chosen one, the innermost."""
    asked = chosen.select("file_path", "node_id").distinct().withColumns({"_outer": F.lit(False), "_inner": F.lit(True)})
    both = nodes.withColumns({"_outer": F.lit(True), "_inner": F.lit(False)}).unionByName(asked, allowMissingColumns=True)
    return innermost(both, nodes.columns)


def first_below(chosen: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    """``chosen`` with a struct ``_first`` of ``columns`` of the first of ``found`` below each; rows without one are left out."""
    key = F.struct(F.col("node_id").alias("at"), *columns)
    a = found.select("file_path", "node_id", key.alias("_found"))
    both = chosen.withColumn("_to", end()).unionByName(a, allowMissingColumns=True)
    after = F.min("_found").over(Window.partitionBy("file_path").orderBy(F.desc("node_id")).rangeBetween(Window.unboundedPreceding, -1))
    return both.withColumn("_first", after).where("_to IS NOT NULL AND _first.at <= _to").select(*chosen.columns, "_first")


def siblings_of(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """Nodes with the parent of another, chosen node."""
    per = chosen.where("parent_id IS NOT NULL").groupBy("file_path", "parent_id").agg(F.min("node_id").alias("_least"), F.max("node_id").alias("_most"))
    return nodes.join(per, ["file_path", "parent_id"]).where("NOT (_least = node_id AND _most = node_id)").select(nodes.columns)


def beside(nodes: DataFrame, chosen: DataFrame, step: int) -> DataFrame:
    """Siblings ``step`` places after (before, if negative) a chosen node."""
    return semi(nodes, chosen.where("parent_id IS NOT NULL"), file_path="file_path", parent_id="parent_id", sibling_index=F.col("sibling_index") + step)
