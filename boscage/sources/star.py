"""Trees of customers, their orders and the orders' lines, from a star schema.

One tree ("file") for each customer. The whole numbering is windows partitioned by
file, so it is one shuffle of orders and lines on their way to the tree and
never a global order. The windows of selectors over files need no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import like_schema
from .files import parts_of, sorted_apart

_LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def nodes_from_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node rows: a customer is a module, an order a class, a line a function named by its return flag."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    customers = read("customer").select(F.col("c_custkey").alias("cust"), F.col("c_mktsegment").alias("name"), F.lit("customer").alias("type"), F.lit(0).alias("depth"))
    orders = read("orders").select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("name"), F.lit("order").alias("type"), F.lit(1).alias("depth"))
    owner = read("orders").select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("l_orderkey"))
    parts = parts_of(read("customer").unionByName(read("orders"), allowMissingColumns=True).unionByName(read("lineitem"), allowMissingColumns=True))
    lines = sorted_apart(read("lineitem"), "l_orderkey", parts=parts).join(sorted_apart(owner, "l_orderkey", parts=parts), "l_orderkey")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINE))
    lines = lines.select("cust", F.col("l_orderkey").alias("ord"), place.alias("line"), F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("status"), F.lit("line").alias("type"), F.lit(2).alias("depth"))
    rows = customers.unionByName(orders, allowMissingColumns=True).unionByName(lines, allowMissingColumns=True)
    rows = rows.withColumns({"ord": F.coalesce("ord", F.lit(-1)), "line": F.coalesce("line", F.lit(0)), "file_path": F.concat(F.lit("customer/"), F.col("cust"))})
    rows = sorted_apart(rows, "file_path", parts=parts)
    tree, order = Window.partitionBy("file_path"), Window.partitionBy("file_path", "ord")
    rows = rows.withColumns(
        {
            "node_id": F.row_number().over(tree.orderBy("ord", "line")) - 1,
            "in_tree": F.count("*").over(tree),
            "in_order": F.count("*").over(order),
            "orders": F.count(F.when(F.col("depth") == 1, 1)).over(tree),
            "nth_order": F.count(F.when(F.col("depth") == 1, 1)).over(tree.orderBy("ord", "line")) - 1,
        }
    )
    below = F.when(F.col("depth") == 0, F.col("in_tree") - 1).when(F.col("depth") == 1, F.col("in_order") - 1).otherwise(0)
    root = F.col("depth") == 0
    is_order = F.col("depth") == 1
    mine = F.col("node_id") - F.col("line")  # the order's own node
    return like_schema(
        rows.select(
            "file_path",
            "node_id",
            F.when(is_order, 0).when(~root, mine).alias("parent_id"),
            "depth",
            F.when(root, 0).when(is_order, F.col("nth_order")).otherwise(F.col("line") - 1).alias("sibling_index"),
            F.when(root, F.col("orders")).otherwise(below).alias("children_count"),
            below.alias("descendant_count"),
            "type",
            F.when(root, "DEFINITION_MODULE").when(is_order, "DEFINITION_CLASS").otherwise("COMPUTATION_CALL").alias("semantic_name"),
            F.when(root, 6 + 8).when(is_order, 6 + 8).otherwise(2).alias("flags"),
            "name",
            F.concat_ws(".", F.when(~root, F.col("ord")), F.when(F.col("depth") == 2, F.col("line"))).alias("qualified_name"),
            F.lit("star").alias("language"),
            F.concat_ws(" ", "type", "name", "status").alias("peek"),
            (F.col("node_id") + 1).alias("start_line"),
            (F.col("node_id") + 1 + below).alias("end_line"),
            F.when(root, F.array(F.lit("frame"))).otherwise(F.array().cast("array<string>")).alias("modifiers"),
            F.struct(
                F.when(root, F.lit(None)).when(is_order, 0).otherwise(mine).cast("long").alias("current"),
                F.lit(None).cast("long").alias("function"),
                F.when(F.col("depth") == 2, mine).cast("long").alias("class"),
                F.when(~root, 0).cast("long").alias("module"),
                F.when(root, F.array().cast("array<long>")).when(is_order, F.array(F.lit(0).cast("long"))).otherwise(F.array(F.lit(0).cast("long"), mine.cast("long"))).alias("stack"),
            ).alias("scope"),
        )
    )


#: The same table in SQL.
STAR_SQL = """
ordered AS (SELECT o_custkey AS cust, o_orderkey AS ord, o_orderpriority AS name FROM orders),
lined AS (SELECT o_custkey AS cust, l_orderkey AS ord, l_returnflag AS name, l_linestatus AS status,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS line
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
stacked AS (
  SELECT c_custkey AS cust, -1 AS ord, 0 AS line, c_mktsegment AS name, NULL AS status, 'customer' AS type, 0 AS depth FROM customer
  UNION ALL SELECT cust, ord, 0, name, NULL, 'order', 1 FROM ordered
  UNION ALL SELECT cust, ord, line, name, status, 'line', 2 FROM lined),
numbered AS (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY ord, line) - 1 AS node_id,
  count(*) OVER (PARTITION BY cust) AS in_tree, count(*) OVER (PARTITION BY cust, ord) AS in_order,
  count(CASE WHEN depth = 1 THEN 1 END) OVER (PARTITION BY cust) AS n_orders,
  count(CASE WHEN depth = 1 THEN 1 END) OVER (PARTITION BY cust ORDER BY ord, line ROWS UNBOUNDED PRECEDING) - 1 AS nth_order FROM stacked),
nodes AS (SELECT 'customer/' || cust AS file_path, node_id,
  CASE depth WHEN 1 THEN 0 WHEN 2 THEN node_id - line END AS parent_id, depth,
  CAST(CASE depth WHEN 0 THEN 0 WHEN 1 THEN nth_order ELSE line - 1 END AS INTEGER) AS sibling_index,
  CAST(CASE depth WHEN 0 THEN n_orders WHEN 1 THEN in_order - 1 ELSE 0 END AS INTEGER) AS children_count,
  CAST(CASE depth WHEN 0 THEN in_tree - 1 WHEN 1 THEN in_order - 1 ELSE 0 END AS INTEGER) AS descendant_count,
  type, CASE depth WHEN 0 THEN 'DEFINITION_MODULE' WHEN 1 THEN 'DEFINITION_CLASS' ELSE 'COMPUTATION_CALL' END AS semantic_name,
  CASE depth WHEN 2 THEN 2 ELSE 14 END AS flags, name, concat_ws(' ', type, name, status) AS peek,
  CAST(node_id + 1 AS INTEGER) AS start_line,
  CAST(node_id + 1 + CASE depth WHEN 0 THEN in_tree - 1 WHEN 1 THEN in_order - 1 ELSE 0 END AS INTEGER) AS end_line
  FROM numbered)
"""
