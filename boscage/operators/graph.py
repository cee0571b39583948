"""Call graph and scopes, as joins on names and on the enclosing scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import nav
from ..schema import DECLARATION, REFERENCE, ROLE

CALL, FUNCTION = "COMPUTATION_CALL", "DEFINITION_FUNCTION"


def _names(chosen: DataFrame) -> DataFrame:
    return chosen.where("name IS NOT NULL AND name <> ''").select("name").distinct()


def callers(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """Functions around calls of a chosen name, in any file; calls outside functions have none."""
    calls = nodes.where(F.col("semantic_name") == CALL).join(_names(chosen), "name", "left_semi")
    return nav.nearest_ancestors_of(nodes.where(F.col("semantic_name") == FUNCTION), calls)


def callees(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """Calls within the chosen nodes."""
    return nav.descendants_of(nodes.where(F.col("semantic_name") == CALL), chosen)


def references(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """Nodes that refer to a chosen name."""
    return nodes.where(F.col("flags").bitwiseAND(ROLE) == REFERENCE).join(_names(chosen), "name", "left_semi")


def scopes(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """The scopes that the chosen nodes lie in: module, and the classes and functions around."""
    around = chosen.select("file_path", F.explode("scope.stack").alias("node_id"))
    return nav.semi(nodes, around, file_path="file_path", node_id="node_id")


def _directly_in(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    where = chosen.select("file_path", F.col("node_id").alias("_in")).distinct()
    return nodes.withColumn("_in", F.col("scope.current")).join(where, ["file_path", "_in"], "left_semi").select(nodes.columns)


def definitions_in(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """What is bound directly in the scopes that the chosen nodes are."""
    return _directly_in(nodes.where(F.col("flags").bitwiseAND(DECLARATION) != 0), chosen)


def references_in(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """Identifiers that refer to something, directly in those scopes."""
    return _directly_in(nodes.where((F.col("flags").bitwiseAND(ROLE) == REFERENCE) & (F.col("semantic_name").isin("NAME_IDENTIFIER", CALL))), chosen)


def reachable(nodes: DataFrame, chosen: DataFrame, steps: int | None = None) -> DataFrame:
    """(name, distance): functions reached from the chosen ones by calls, all or within a number of steps.

    Works on distinct names of callers and callees, which are far fewer than nodes, and ends as no new name is reached.
    The steps stay with the executors, until nothing refers to them.
    """
    function = F.col("semantic_name") == FUNCTION
    parts = nodes.where(function | (F.col("semantic_name") == CALL)).select("file_path", F.when(function, F.col("node_id")).otherwise(F.col("scope.function")).alias("of"), F.when(function, F.col("name")).alias("from"), F.when(~function, F.col("name")).alias("to"))
    calling = parts.where("of IS NOT NULL").groupBy("file_path", "of").agg(F.max("from").alias("from"), F.collect_set("to").alias("to")).where("`from` IS NOT NULL").select("from", "to").localCheckpoint()
    edges = calling.select("from", F.explode("to").alias("to")).distinct()
    edges = edges.join(calling.select(F.col("from").alias("to")).distinct(), "to", "left_semi").localCheckpoint()
    seen = front = _names(chosen).withColumn("distance", F.lit(0)).localCheckpoint()
    k = 0
    while steps is None or k < steps:
        k += 1
        front = front.join(edges, front["name"] == edges["from"]).select(F.col("to").alias("name")).distinct().join(seen, "name", "left_anti").withColumn("distance", F.lit(k)).localCheckpoint()
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen
