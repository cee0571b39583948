"""Schemas of the tables that everything here works on, and the bits of ``flags``."""

from pyspark.sql import types as T

PARAMETER = T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType())])
SCOPE = T.StructType([*(T.StructField(n, T.LongType()) for n in ("current", "function", "class", "module")), T.StructField("stack", T.ArrayType(T.LongType()))])

#: One row for each node of a tree. ``node_id`` counts in pre-order within ``file_path``: the nodes
#: below a node are those with ids in (node_id, node_id + descendant_count].
NODE = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("node_id", T.LongType()),
        T.StructField("parent_id", T.LongType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("sibling_index", T.IntegerType()),
        T.StructField("children_count", T.IntegerType()),
        T.StructField("descendant_count", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("semantic_name", T.StringType()),
        T.StructField("semantic_type", T.ShortType()),
        T.StructField("flags", T.ShortType()),
        T.StructField("name", T.StringType()),
        T.StructField("qualified_name", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("peek", T.StringType()),
        T.StructField("signature_type", T.StringType()),
        T.StructField("annotations", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("parameters", T.ArrayType(PARAMETER)),
        T.StructField("modifiers", T.ArrayType(T.StringType())),
        T.StructField("scope", SCOPE),
    ]
)

#: One row for each heading of a document, with the text up to the next.
SECTION = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in ("file_path", "section_id", "section_path")),
        T.StructField("level", T.IntegerType()),
        *(T.StructField(n, T.StringType()) for n in ("title", "content", "parent_id")),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
    ]
)

#: What a name in the text is for: bits 1 and 2 of ``flags``.
SYNTAX_ONLY, ROLE, REFERENCE, DECLARATION, DEFINITION, SCOPED = 1, 6, 2, 4, 6, 8

TREE_KEY = ["file_path", "node_id"]


def like_schema(df, schema=NODE):
    """``df`` with exactly the columns of ``schema``; missing ones are null."""
    from pyspark.sql import functions as F

    there = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in there else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
