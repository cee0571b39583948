"""Sections of markdown text, in built-in functions: one row for each heading, with the text up to the next."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DEFINITION, SCOPED, SECTION, like_schema
from .trees import Node

_HEADING = r"^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$"


def sections(files: DataFrame) -> DataFrame:
    """Sections of files (file_path, text). Headings in fenced code don't count; text before the first heading belongs to none."""
    lines = files.where("text IS NOT NULL").select("file_path", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("at", "line"))
    file = Window.partitionBy("file_path")
    so_far = file.orderBy("at")
    lines = lines.withColumn("fences", F.count(F.when(F.col("line").rlike(r"^\s*(```|~~~)"), 1)).over(so_far))
    lines = lines.withColumn("heading", (F.col("fences") % 2 == 0) & F.col("line").rlike(_HEADING)).withColumn("n", F.count(F.when(F.col("heading"), 1)).over(so_far)).where("n > 0")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    found = lines.groupBy("file_path", "n").agg(F.min("at").alias("first"), F.max("at").alias("last"), text.alias("content"))
    head = F.substring_index("content", "\n", 1)
    found = found.withColumns({"level": F.length(F.regexp_extract(head, _HEADING, 1)), "title": F.regexp_extract(head, _HEADING, 2)})
    # the parent of a section is the last before it of a smaller level: the last at each level, and of these the latest
    order = file.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == k, F.struct("n", "title"))).over(order) for k in range(1, 6)]
    found = found.withColumns({f"last{k}": c for k, c in enumerate(last, 1)})
    # the last of a level is an ancestor if no section of a smaller level came after it
    none = F.lit(-1)
    at = [F.when(F.col("level") > k, F.coalesce(F.col(f"last{k}.n"), none)).otherwise(none) for k in range(1, 6)]
    ancestors = [F.when((at[k] > none) & (at[k] > (F.greatest(none, none, *at[:k]))), F.col(f"last{k + 1}.title")) for k in range(5)]
    found = found.withColumn("parent", F.nullif(F.greatest(none, *at), none))
    titles = F.concat(F.filter(F.array(*ancestors), lambda t: t.isNotNull()), F.array("title"))
    ident = lambda n: F.concat_ws("#", "file_path", n.cast("string"))
    return like_schema(
        found.select(
            "file_path",
            ident(F.col("n")).alias("section_id"),
            F.array_join(titles, " > ").alias("section_path"),
            "level",
            "title",
            "content",
            F.when(F.col("parent").isNotNull(), ident(F.col("parent"))).alias("parent_id"),
            (F.col("first") + 1).alias("start_line"),
            (F.col("last") + 1).alias("end_line"),
        ),
        SECTION,
    )


def parse(text: str, path: str) -> Node:
    """A file as a tree: sections nest by their level, paragraphs, lists and code are their leaves."""
    lines = re.split(r"\r\n|\n|\r", text)
    root = Node("document", "DEFINITION_MODULE", 1, max(1, len(lines) - (lines[-1] == "" and len(lines) > 1)), path.rsplit("/", 1)[-1].rsplit(".", 1)[0], DEFINITION | SCOPED, lines[0])
    open_sections, levels = [root], [0]
    block: Node | None = None
    fence = False
    for n, line in enumerate(lines, 1):
        mark = bool(re.match(r"\s*(```|~~~)", line))
        head = None if fence or mark else re.match(_HEADING, line)
        if head:
            level = len(head[1])
            while levels[-1] >= level:
                open_sections.pop().end = n - 1
                levels.pop()
            section = Node("section", "ORGANIZATION_SECTION", n, root.end, head[2], DEFINITION | SCOPED, line)
            open_sections[-1].add(section)
            open_sections.append(section)
            levels.append(level)
            block = None
        elif mark:
            if not fence:
                block = Node("code_block", "LITERAL_STRING", n, n, line.strip("`~ ") or None, 0, line)
                open_sections[-1].add(block)
            block.end = n
            fence = not fence
            block = block if fence else None
        elif line.strip() or fence:
            if block is None:
                kind = "list" if re.match(r"\s*([-*+]|\d+[.)])\s", line) else "paragraph"
                block = Node(kind, "ORGANIZATION_LIST" if kind == "list" else "LITERAL_STRING", n, n, None, 0, line.strip())
                open_sections[-1].add(block)
            block.end = n
        else:
            block = None
    return root
