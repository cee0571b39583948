"""The library's queries by name, and the same in SQL where SQL can say it.

Each query applies an operator to whole tables: trees of the star schema (a
tree for each customer), sections and search over documents, conversations,
pages, events, and plain SQL over the star tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import catalog_code
from .functions import text as tx
from .functions.predicates import flag_check
from .operators import corpus, graph, search
from .plans.chain import Chain
from .plans.selector import select
from .selection import Grove, Selection
from .sources import html_dom, markdown
from .sources.star import STAR_SQL, nodes_from_star
from .streaming.refresh import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_KEY = ["file_path", "node_id", "type", "name", "start_line", "end_line"]
_COLUMNS = ", ".join(f"n.{c}" for c in _KEY)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _grove(spark: SparkSession, sf_dir: str) -> Grove:
    return Grove(spark, nodes=nodes_from_star(spark, sf_dir))


def _add(name: str, run: Query, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def _changed(name: str, columns: dict[str, str], build: Callable[[Grove], Selection], where: str) -> None:
    """A query of nodes of which some columns are other expressions (of Spark and of SQL alike), as the star schema's own say little."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes = nodes_from_star(spark, sf_dir)
        nodes = nodes.withColumns({c: F.expr(e).cast(nodes.schema[c].dataType) for c, e in columns.items()})
        return build(Grove(spark, nodes=nodes)).df.select(_KEY)

    replaced = ", ".join(f"{e} AS {c}" for c, e in columns.items())
    _add(name, run, f"WITH {STAR_SQL} SELECT {_COLUMNS} FROM (SELECT * REPLACE ({replaced}) FROM nodes) n {where}")


def _tree(name: str, build: Callable[[Grove], Selection], where: str) -> None:
    """A query of nodes; ``where`` is the SQL after FROM nodes n."""
    _add(name, lambda spark, sf_dir: build(_grove(spark, sf_dir)).df.select(_KEY), f"WITH {STAR_SQL} SELECT {_COLUMNS} FROM nodes n {where}")


_add(
    "tree_nodes",
    lambda spark, sf_dir: nodes_from_star(spark, sf_dir).select("file_path", "node_id", "parent_id", "depth", "sibling_index", "children_count", "descendant_count", "type", "semantic_name", "name", "peek", "start_line", "end_line"),
    f"WITH {STAR_SQL} SELECT file_path, node_id, parent_id, depth, sibling_index, children_count, descendant_count, type, semantic_name, name, peek, start_line, end_line FROM nodes",
)

_BELOW = "a.file_path = n.file_path AND n.node_id > a.node_id AND n.node_id <= a.node_id + a.descendant_count"
_ABOVE = "d.file_path = n.file_path AND d.node_id > n.node_id AND d.node_id <= n.node_id + n.descendant_count"
_SIBLING = "s.file_path = n.file_path AND s.parent_id = n.parent_id"
_R = "type = 'line' AND {0}.name = 'R'"

# selectors
for _name, _selector, _where in [
    ("find_class", ".cls", "WHERE semantic_name = 'DEFINITION_CLASS'"),
    ("find_category", ".definition", "WHERE starts_with(semantic_name, 'DEFINITION_')"),
    ("find_type", "line", "WHERE type = 'line'"),
    ("find_name", ".call#R", "WHERE semantic_name = 'COMPUTATION_CALL' AND name = 'R'"),
    ("find_attr_equal", "[name=BUILDING]", "WHERE name = 'BUILDING'"),
    ("find_attr_prefix", "order[name^='1-']", "WHERE type = 'order' AND starts_with(name, '1-')"),
    ("find_attr_suffix", "order[name$=T]", "WHERE type = 'order' AND ends_with(name, 'T')"),
    ("find_attr_contains", "[name*=-H]", "WHERE contains(name, '-H')"),
    ("find_attr_lines", "order[lines>=5]", "WHERE type = 'order' AND end_line - start_line + 1 >= 5"),
    ("find_list", "customer, line#R", "WHERE type = 'customer' OR (type = 'line' AND name = 'R')"),
    ("find_descendant", "customer[name=BUILDING] line#R", f"WHERE {_R.format('n')} AND EXISTS (SELECT 1 FROM nodes a WHERE {_BELOW} AND a.type = 'customer' AND a.name = 'BUILDING')"),
    ("find_child", "order[name^='2-'] > line#A", "SEMI JOIN (SELECT file_path, node_id AS parent_id FROM nodes WHERE type = 'order' AND starts_with(name, '2-')) p USING (file_path, parent_id) WHERE n.type = 'line' AND n.name = 'A'"),
    ("find_adjacent", "line#R + line#A", f"WHERE type = 'line' AND n.name = 'A' AND EXISTS (SELECT 1 FROM nodes s WHERE {_SIBLING} AND s.sibling_index = n.sibling_index - 1 AND s.type = 'line' AND s.name = 'R')"),
    ("find_later_sibling", "line#R ~ line#A", f"WHERE type = 'line' AND n.name = 'A' AND EXISTS (SELECT 1 FROM nodes s WHERE {_SIBLING} AND s.sibling_index < n.sibling_index AND s.type = 'line' AND s.name = 'R')"),
    ("find_has", "order:has(line#R)", f"WHERE type = 'order' AND EXISTS (SELECT 1 FROM nodes d WHERE {_ABOVE} AND d.type = 'line' AND d.name = 'R')"),
    ("find_not_has", "order:not(:has(line#R))", f"WHERE type = 'order' AND NOT EXISTS (SELECT 1 FROM nodes d WHERE {_ABOVE} AND d.type = 'line' AND d.name = 'R')"),
    ("find_is", "line:is(#R, #A)", "WHERE type = 'line' AND name IN ('R', 'A')"),
    ("find_chain", "customer:has(line#R) > order:not([name$=T]) line:first", f"WHERE type = 'line' AND sibling_index = 0 AND EXISTS (SELECT 1 FROM nodes a WHERE {_BELOW} AND a.type = 'order' AND NOT ends_with(a.name, 'T') AND EXISTS (SELECT 1 FROM nodes c, nodes d WHERE c.file_path = a.file_path AND c.node_id = a.parent_id AND c.type = 'customer' AND d.file_path = c.file_path AND d.type = 'line' AND d.name = 'R'))"),
    ("find_calls", "order:calls(N)", f"WHERE type = 'order' AND EXISTS (SELECT 1 FROM nodes d WHERE {_ABOVE} AND d.semantic_name = 'COMPUTATION_CALL' AND d.name = 'N')"),
    ("pseudo_first", "line:first", "WHERE type = 'line' AND sibling_index = 0"),
    ("pseudo_nth_child", "line:nth-child(3)", "WHERE type = 'line' AND sibling_index = 2"),
    ("pseudo_empty", "order:empty", "WHERE type = 'order' AND children_count = 0"),
    ("pseudo_line", ":line(4)", "WHERE start_line <= 4 AND end_line >= 4"),
    ("pseudo_lines", ":lines(4, 9)", "WHERE start_line >= 4 AND end_line <= 9"),
    ("pseudo_long", "order:long(4)", "WHERE type = 'order' AND end_line - start_line > 4"),
    ("pseudo_complex", ":complex(20)", "WHERE descendant_count > 20"),
    ("pseudo_contains", "line:contains('R F')", "WHERE type = 'line' AND contains(peek, 'R F')"),
    ("pseudo_decorated", ":decorated", "WHERE type = 'customer'"),
    ("element_parent", "line#R::parent", f"WHERE EXISTS (SELECT 1 FROM nodes d WHERE d.file_path = n.file_path AND d.parent_id = n.node_id AND d.type = 'line' AND d.name = 'R')"),
    ("element_next_sibling", "line#R::next-sibling", f"WHERE EXISTS (SELECT 1 FROM nodes s WHERE {_SIBLING} AND s.sibling_index = n.sibling_index - 1 AND s.type = 'line' AND s.name = 'R')"),
    ("element_parent_definition", "line#R::parent-definition", "WHERE type = 'order' AND EXISTS (SELECT 1 FROM nodes d WHERE d.file_path = n.file_path AND d.parent_id = n.node_id AND d.name = 'R')"),
]:
    _tree(_name, lambda g, s=_selector: g.find(s), _where)

_NAMES = {"name": "CASE WHEN name = 'A' THEN '_A' WHEN name = 'N' THEN '__N__' ELSE name END"}
_FLAGS = {"flags": "(node_id % 16)"}
for _name, _columns, _selector, _where in [
    ("pseudo_exported", _NAMES, "line:exported", "WHERE type = 'line' AND name = 'R'"),
    ("pseudo_private", _NAMES, ":private", "WHERE name IN ('_A', '__N__')"),
    ("pseudo_defines", _FLAGS, ":defines", "WHERE flags & 6 = 6"),
    ("pseudo_references", _FLAGS, ":references", "WHERE flags & 6 = 2"),
    ("pseudo_declaration", _FLAGS, ":declaration", "WHERE flags & 6 = 4"),
    ("pseudo_binds", _FLAGS, ":binds", "WHERE flags & 4 <> 0"),
    ("pseudo_scope", _FLAGS, ":scope", "WHERE flags & 8 <> 0"),
    ("pseudo_syntax_only", _FLAGS, ":syntax-only", "WHERE flags & 1 <> 0"),
]:
    _changed(_name, _columns, lambda g, s=_selector: g.find(s), _where)
_changed("flag_definition", _FLAGS, lambda g: Selection(g.trees, g.trees.nodes.where(flag_check("is_definition"))), "WHERE flags & 6 = 6")
_changed("flag_binds_name", _FLAGS, lambda g: Selection(g.trees, g.trees.nodes.where(flag_check("binds_name"))), "WHERE flags & 4 <> 0")

# steps of a selection
for _name, _build, _where in [
    ("nav_find", lambda g: g.find("order[name^='1-']").find("line#R"), f"WHERE {_R.format('n')} AND EXISTS (SELECT 1 FROM nodes a WHERE {_BELOW} AND a.type = 'order' AND starts_with(a.name, '1-'))"),
    ("nav_parent", lambda g: g.find("line#R").parent(), "WHERE EXISTS (SELECT 1 FROM nodes d WHERE d.file_path = n.file_path AND d.parent_id = n.node_id AND d.type = 'line' AND d.name = 'R')"),
    ("nav_children", lambda g: g.find("customer[name=BUILDING]").children(), "WHERE EXISTS (SELECT 1 FROM nodes p WHERE p.file_path = n.file_path AND p.node_id = n.parent_id AND p.type = 'customer' AND p.name = 'BUILDING')"),
    ("nav_siblings", lambda g: g.find("line#R").siblings(), f"WHERE EXISTS (SELECT 1 FROM nodes s WHERE {_SIBLING} AND s.node_id <> n.node_id AND s.type = 'line' AND s.name = 'R')"),
    ("nav_next", lambda g: g.find("line#R").next(), f"WHERE EXISTS (SELECT 1 FROM nodes s WHERE {_SIBLING} AND s.sibling_index = n.sibling_index - 1 AND s.type = 'line' AND s.name = 'R')"),
    ("nav_prev", lambda g: g.find("line#R").prev(), f"WHERE EXISTS (SELECT 1 FROM nodes s WHERE {_SIBLING} AND s.sibling_index = n.sibling_index + 1 AND s.type = 'line' AND s.name = 'R')"),
    ("nav_ancestor", lambda g: g.find("line#R").ancestor("*"), f"WHERE EXISTS (SELECT 1 FROM nodes d WHERE {_ABOVE} AND d.type = 'line' AND d.name = 'R')"),
    ("nav_nearest_ancestor", lambda g: g.find("line#R").ancestor(":scope", nearest=True), "WHERE type = 'order' AND EXISTS (SELECT 1 FROM nodes d WHERE d.file_path = n.file_path AND d.parent_id = n.node_id AND d.name = 'R')"),
    ("at_line", lambda g: g.find("*").at_line(4), "WHERE start_line <= 4 AND end_line >= 4"),
    ("at_lines", lambda g: g.find("order").at_lines(4, 9), "WHERE type = 'order' AND start_line <= 9 AND end_line >= 4"),
    ("not_selector", lambda g: g.find("line").not_("#R"), "WHERE type = 'line' AND name <> 'R'"),
    ("unique", lambda g: Selection(g.trees, g.find("line#R").df.unionByName(g.find("line").df)).unique(), "WHERE type = 'line'"),
    ("filter_keywords", lambda g: g.find("*").filter(name__startswith="1-", descendant_count__gte=3, type="order"), "WHERE type = 'order' AND starts_with(name, '1-') AND descendant_count >= 3"),
    ("filter_pseudo", lambda g: g.find("order").filter(":first", ":complex(2)"), "WHERE type = 'order' AND sibling_index = 0 AND descendant_count > 2"),
    ("filter_selector", lambda g: g.find("order").filter(":has(line#A)"), f"WHERE type = 'order' AND EXISTS (SELECT 1 FROM nodes d WHERE {_ABOVE} AND d.type = 'line' AND d.name = 'A')"),
    ("filter_bounds", lambda g: g.find("*").filter(min_lines=3, max_lines=6, min_depth=1), "WHERE end_line - start_line + 1 BETWEEN 3 AND 6 AND depth >= 1"),
    ("filter_sql", lambda g: g.find("order").filter_sql("descendant_count > 3 AND name LIKE '%L%'"), "WHERE type = 'order' AND descendant_count > 3 AND name LIKE '%L%'"),
    ("callers", lambda g: Selection(g.trees, graph.callers(g.trees.nodes.withColumn("semantic_name", F.when(F.col("type") == "order", "DEFINITION_FUNCTION").otherwise(F.col("semantic_name"))), g.find("line#R").df)), "WHERE type = 'order' AND EXISTS (SELECT 1 FROM nodes d WHERE d.file_path = n.file_path AND d.parent_id = n.node_id AND d.name = 'R')"),
    ("callees", lambda g: g.find("order[name^='1-']").callees(), f"WHERE type = 'line' AND EXISTS (SELECT 1 FROM nodes a WHERE {_BELOW} AND a.type = 'order' AND starts_with(a.name, '1-'))"),
    ("references", lambda g: g.find("line:first").references(), "WHERE flags & 6 = 2 AND name IN (SELECT name FROM nodes WHERE type = 'line' AND sibling_index = 0)"),
    ("scope", lambda g: g.find("line#R").scope(), f"WHERE flags & 8 <> 0 AND EXISTS (SELECT 1 FROM nodes d WHERE {_ABOVE} AND d.type = 'line' AND d.name = 'R')"),
    ("scope_defs", lambda g: g.find("customer[name=BUILDING]").defs(), "WHERE type = 'order' AND EXISTS (SELECT 1 FROM nodes p WHERE p.file_path = n.file_path AND p.node_id = n.parent_id AND p.type = 'customer' AND p.name = 'BUILDING')"),
    ("scope_refs", lambda g: g.find("order[name^='1-']").refs(), "WHERE type = 'line' AND EXISTS (SELECT 1 FROM nodes p WHERE p.file_path = n.file_path AND p.node_id = n.parent_id AND p.type = 'order' AND starts_with(p.name, '1-'))"),
    ("page", lambda g: g.find("order").page(3, 25), "WHERE type = 'order' ORDER BY file_path, node_id LIMIT 25 OFFSET 75"),
    ("offset_limit", lambda g: g.find("line").offset(100).limit(10), "WHERE type = 'line' ORDER BY file_path, node_id LIMIT 10 OFFSET 100"),
    ("chain_evaluated", lambda g: Chain.from_argv(["star", "find", "order:has(line#R)", "filter", "--descendant_count__gt=4", "children"]).selection(g.spark, g), f"WHERE type = 'line' AND EXISTS (SELECT 1 FROM nodes a WHERE {_BELOW} AND a.type = 'order' AND a.descendant_count > 4 AND EXISTS (SELECT 1 FROM nodes d WHERE d.file_path = a.file_path AND d.parent_id = a.node_id AND d.name = 'R'))"),
]:
    _tree(_name, _build, _where)

# terminals
_add("names", lambda spark, sf_dir: _grove(spark, sf_dir).find("order").names_df(), f"WITH {STAR_SQL} SELECT DISTINCT name FROM nodes WHERE type = 'order' AND name <> ''")
_add("count_nodes", lambda spark, sf_dir: _grove(spark, sf_dir).find("line").df.agg(F.count("*").alias("n")), f"WITH {STAR_SQL} SELECT count(*) AS n FROM nodes WHERE type = 'line'")
_add("complexity_by_type", lambda spark, sf_dir: nodes_from_star(spark, sf_dir).groupBy("type").agg(F.sum("descendant_count").alias("total"), F.max("descendant_count").alias("most")), f"WITH {STAR_SQL} SELECT type, CAST(sum(descendant_count) AS BIGINT) AS total, max(descendant_count) AS most FROM nodes GROUP BY type")
_add(
    "set_operations",
    lambda spark, sf_dir: (lambda n: n.where("type = 'line'").select("file_path").intersect(n.where("name = 'BUILDING'").select("file_path")).unionByName(n.where("type = 'customer'").select("file_path").subtract(n.where("type = 'order' AND name LIKE '1-%'").select("file_path"))))(nodes_from_star(spark, sf_dir)),
    f"WITH {STAR_SQL} (SELECT file_path FROM nodes WHERE type = 'line' INTERSECT SELECT file_path FROM nodes WHERE name = 'BUILDING') UNION ALL (SELECT file_path FROM nodes WHERE type = 'customer' EXCEPT SELECT file_path FROM nodes WHERE type = 'order' AND starts_with(name, '1-'))",
)


_add(
    "union_distinct",
    lambda spark, sf_dir: (lambda n: n.where("type = 'line'").select("name").union(n.where("type = 'order'").select("name")).distinct())(nodes_from_star(spark, sf_dir)),
    f"WITH {STAR_SQL} SELECT name FROM nodes WHERE type = 'line' UNION SELECT name FROM nodes WHERE type = 'order'",
)


# sections and search
def _as_markdown(docs: DataFrame) -> DataFrame:
    """Documents with their id as a heading and every further line as one below it."""
    return docs.select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("file_path"), F.concat(F.lit("# document "), "doc_id", F.lit("\n"), F.replace("text", F.lit("\n"), F.lit("\n## "))).alias("text"))


_SECTION_SQL = r"""
lines AS (SELECT 'doc/' || doc_id AS file_path, unnest(string_split_regex('# document ' || doc_id || chr(10) || replace(text, chr(10), chr(10) || '## '), '\r\n|\n|\r')) AS line,
  generate_subscripts(string_split_regex('# document ' || doc_id || chr(10) || replace(text, chr(10), chr(10) || '## '), '\r\n|\n|\r'), 1) AS pos FROM documents),
fenced AS (SELECT *, count(CASE WHEN regexp_matches(line, '^\s*(```|~~~)') THEN 1 END) OVER (PARTITION BY file_path ORDER BY pos) AS fences FROM lines),
headed AS (SELECT *, fences % 2 = 0 AND regexp_matches(line, '^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$') AS heading FROM fenced),
numbered AS (SELECT *, count(CASE WHEN heading THEN 1 END) OVER (PARTITION BY file_path ORDER BY pos) AS n FROM headed),
grouped AS (SELECT file_path, n, min(pos) AS start_line, max(pos) AS end_line, string_agg(line, chr(10) ORDER BY pos) AS content, arg_min(line, pos) AS head FROM numbered WHERE n > 0 GROUP BY file_path, n),
sections AS (SELECT file_path, file_path || '#' || n AS section_id, length(regexp_extract(head, '^(#{1,6})[ \t]+', 1)) AS level,
  regexp_extract(head, '^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$', 2) AS title, content, start_line, end_line FROM grouped)
"""
_SECTION_COLUMNS = ["file_path", "section_id", "level", "title", "content", "start_line", "end_line"]


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.sections(_as_markdown(_table(spark, sf_dir, "documents")))


_selected = ", ".join(f"CAST({c} AS INTEGER) AS {c}" if c in ("level", "start_line", "end_line") else c for c in _SECTION_COLUMNS)
_add("doc_sections", lambda spark, sf_dir: _sections(spark, sf_dir).select(_SECTION_COLUMNS), f"WITH {_SECTION_SQL} SELECT {_selected} FROM sections")
_add("doc_filter", lambda spark, sf_dir: _sections(spark, sf_dir).where("level >= 2").where(F.col("content").ilike("%the%")).select(_SECTION_COLUMNS), f"WITH {_SECTION_SQL} SELECT {_selected} FROM sections WHERE level >= 2 AND content ILIKE '%the%'")
_add("doc_outline", lambda spark, sf_dir: _sections(spark, sf_dir).where("level <= 1").select("file_path", "title"), f"WITH {_SECTION_SQL} SELECT file_path, title FROM sections WHERE level <= 1")
_add("doc_parents", lambda spark, sf_dir: _sections(spark, sf_dir).groupBy("parent_id").agg(F.count("*").alias("n"), F.max("section_path").alias("last_path")).select("parent_id", "n"), f"WITH {_SECTION_SQL} SELECT CASE WHEN level = 1 THEN NULL ELSE file_path || '#1' END AS parent_id, count(*) AS n FROM sections GROUP BY 1")


def _bm25_sql(source: str, asked: list[str], limit: int) -> str:
    listed = ", ".join(f"'{t}'" for t in asked)
    words = "[w for w in string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+') if w <> '']"
    return f"""
WITH t AS (SELECT id, {words} AS ws FROM ({source})),
s AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM t),
p AS (SELECT id, len(ws) AS length, unnest(ws) AS term FROM t),
c AS (SELECT id, term, length, count(*) AS tf FROM p WHERE term IN ({listed}) GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM c GROUP BY term)
SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {search.K1 + 1} / (tf + {search.K1} * ({1 - search.B} + {search.B} * length / mean))), 6) AS score
FROM c JOIN d USING (term), s GROUP BY id ORDER BY score DESC, id LIMIT {limit}"""


_add("bm25_documents", lambda spark, sf_dir: search.search(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "thereof Inonth the boga", 50), _bm25_sql("SELECT doc_id AS id, text FROM documents", ["boga", "inonth", "the", "thereof"], 50))
_add("bm25_benchmark", lambda spark, sf_dir: search.search(_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"), "with other ends", 20), _bm25_sql("SELECT item_id AS id, text FROM benchmark", ["ends", "other", "with"], 20))
_add("bm25_german", lambda spark, sf_dir: search.search(_table(spark, sf_dir, "documents").where("lang = 'de'").select(F.col("doc_id").alias("id"), "text"), "mit und die", 25), _bm25_sql("SELECT doc_id AS id, text FROM documents WHERE lang = 'de'", ["die", "mit", "und"], 25))


# conversations and corpora
_add(
    "conversation_next",
    lambda spark, sf_dir: _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).alias("next_role"), F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).alias("prev_role")),
    "SELECT conv_id, turn, role, lead(role) OVER w AS next_role, lag(role) OVER w AS prev_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)",
)
_add(
    "corpus_garbled",
    lambda spark, sf_dir: _table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.garbled(F.col("text")).alias("garbled")),
    """SELECT conv_id, turn, coalesce((length(text) - length(replace(text, '"', ''))) % 2 <> 0 OR length(replace(text, '(', '')) <> length(replace(text, ')', ''))
OR length(replace(text, '[', '')) <> length(replace(text, ']', '')) OR length(replace(text, '{', '')) <> length(replace(text, '}', ''))
OR contains(text, '{{') OR contains(text, '}}') OR contains(text, 'TODO') OR contains(text, '...(') OR trim(text) = '', true) AS garbled FROM conversations""",
)
_add(
    "corpus_keep_first",
    lambda spark, sf_dir: tx.keep_first(_table(spark, sf_dir, "conversations"), ["text"], ["conv_id", "turn", "role"]).select("conv_id", "turn", "role", "text"),
    "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY conv_id, turn, role) AS nth FROM conversations) WHERE nth = 1",
)
_add(
    "corpus_split",
    lambda spark, sf_dir: tx.split_exactly(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.9, 42),
    "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(doc_id || ':42'), doc_id) <= floor(count(*) OVER () * 0.9) THEN 'train' ELSE 'val' END AS part FROM documents",
)
_add(
    "chat_format",
    lambda spark, sf_dir: _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m")).select("conv_id", F.size("m").alias("n"), F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("chat")),
    "SELECT conv_id, CAST(count(*) AS INTEGER) AS n, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS chat FROM conversations GROUP BY conv_id",
)
_add("chat_messages", lambda spark, sf_dir: tx.chat_messages(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text"))
_add("corpus_generated", lambda spark, sf_dir: corpus.cleaned(corpus.generate(spark, 50_000, 42)).select("position", "intent", "chain", "shape", "category", "strategy", "language", "valid", "error"))
_add(
    "labelled_filter",
    lambda spark, sf_dir: _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0"), "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")),
    "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) GROUP BY lang",
)

# pages as trees
_DOM = ["file_path", "node_id", "parent_id", "depth", "type", "name", "descendant_count", "start_line"]
_add("dom_nodes", lambda spark, sf_dir: html_dom.nodes_from_pages(spark, sf_dir).select(_DOM))
_add("dom_find", lambda spark, sf_dir: select(html_dom.nodes_from_pages(spark, sf_dir), "article p text, nav a").select(_DOM))
_add("dom_has", lambda spark, sf_dir: select(html_dom.nodes_from_pages(spark, sf_dir), "body:has(ul a)").select(_DOM))

# events
_add(
    "events_windowed",
    lambda spark, sf_dir: windowed_counts(_table(spark, sf_dir, "events")).select(F.unix_timestamp("start").alias("start"), "event_type", "n", "users"),
    "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL",
)

# plain SQL over the star tables
_RAW = {
    "sql_pricing_summary": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "sql_shipping_priority": """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderpriority
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey, o_orderpriority ORDER BY revenue DESC, l_orderkey LIMIT 20""",
    "sql_nation_volume": """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""",
    "sql_rollup": """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, CAST(grouping(l_returnflag) + grouping(l_linestatus) AS INT) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "sql_cube": """SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
    "sql_window_top": """SELECT o_custkey, o_orderkey, nth FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS nth FROM orders) t WHERE nth <= 3""",
    "sql_having": """SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12""",
    "sql_outer_join": """SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""",
    "sql_anti_join": """SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48)""",
}
_USED = {n: [t for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem") if re.search(rf"\b(FROM|JOIN) {t}\b", q)] for n, q in _RAW.items()}


def _with_tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The SQL with tables as arguments, so that nothing is registered in the session."""
    text = _RAW[name]
    for t in _USED[name]:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}} AS {t}", text)
    return spark.sql(text, **{t: _table(spark, sf_dir, t) for t in _USED[name]})


for _name in _RAW:
    _add(_name, lambda spark, sf_dir, n=_name: _with_tables(spark, sf_dir, n), _RAW[_name])

# source code
catalog_code.register(_add)
