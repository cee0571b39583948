"""Trees of HTML pages."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DEFINITION, SCOPED
from .trees import Node, parsed

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MEANING = {"a": "EXTERNAL_IMPORT", "script": "EXTERNAL_EMBED", "style": "EXTERNAL_EMBED", "img": "EXTERNAL_EMBED", "ul": "ORGANIZATION_LIST", "ol": "ORGANIZATION_LIST", "table": "ORGANIZATION_LIST", "section": "ORGANIZATION_SECTION", "article": "ORGANIZATION_SECTION"}


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("document", "DEFINITION_MODULE", name="document", flags=DEFINITION | SCOPED)
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        said = dict(attrs)
        line = self.getpos()[0]
        node = Node(tag, _MEANING.get(tag, "ORGANIZATION_CONTAINER"), line, line, said.get("id") or said.get("class") or tag, 0, self.get_starttag_text())
        self.open[-1].add(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].type == tag:
                for n in self.open[k:]:
                    n.end = self.getpos()[0]
                del self.open[k:]
                return

    def handle_data(self, data):
        if data.strip():
            line = self.getpos()[0]
            self.open[-1].add(Node("text", "LITERAL_STRING", line, line + data.count("\n"), None, 0, " ".join(data.split())))

    def handle_comment(self, data):
        line = self.getpos()[0]
        self.open[-1].add(Node("comment", "METADATA_COMMENT", line, line, None, 0, data.strip()))


def parse(text: str, path: str) -> Node:
    tree = _Tree()
    tree.feed(text)
    tree.close()
    tree.root.end = max(1, text.count("\n") + 1)
    for n in tree.open[1:]:
        n.end = tree.root.end
    return tree.root


def nodes_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table pages; a page's tree is named ``page/<page_id>``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return parsed(pages.select(F.concat(F.lit("page/"), F.col("page_id")).alias("file_path"), F.col("html").alias("text")), parse, "html")
