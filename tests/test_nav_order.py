"""What must hold whatever order a sort leaves rows of one node in."""

import pytest
from pyspark.sql import functions as F

from boscage import nav


@pytest.fixture
def spilling(spark):
    """Sorts that spill every few rows, as in a task with much to sort: their merge keeps no order of equal rows."""
    conf = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().conf()
    conf.set("spark.shuffle.spill.numElementsForceSpillThreshold", "3")
    spark.conf.set("spark.sql.windowExec.buffer.spill.threshold", "3")
    yield spark
    conf.remove("spark.shuffle.spill.numElementsForceSpillThreshold")
    spark.conf.unset("spark.sql.windowExec.buffer.spill.threshold")


def test_a_node_is_neither_above_nor_below_itself(spilling):
    tree = spilling.createDataFrame([("f", 0, 40), *(("f", k, 0) for k in range(1, 41))], "file_path string, node_id long, descendant_count int").coalesce(1)
    leaves = tree.where("node_id > 0")
    assert [r.node_id for r in nav.ancestors_of(tree, leaves).collect()] == [0]
    assert sorted(r.node_id for r in nav.descendants_of(tree, tree).collect()) == list(range(1, 41))


def test_the_innermost_of_nested_nodes_is_found_once(spilling):
    rows = [("f", 0, 9, "o"), ("f", 1, 4, "o"), ("f", 2, 0, "i"), ("f", 3, 1, "i"), ("f", 4, 0, "i"), ("f", 5, 0, "x"), ("f", 6, 3, "o"), ("f", 7, 0, "x"), ("g", 0, 3, "o"), ("g", 1, 2, "oi"), ("g", 2, 0, "i")]
    df = spilling.createDataFrame(rows, "file_path string, node_id long, descendant_count int, kind string")
    said = nav.nearest_ancestors_of(df.where(F.col("kind").contains("o")), df.where(F.col("kind").contains("i")))
    assert sorted((r.file_path, r.node_id) for r in said.collect()) == [("f", 1), ("g", 0), ("g", 1)] and said.columns == df.columns
