"""Queries over source code: a small file of code for each row of the table part.

The files are made by the same expression in Spark and SQL, are parsed in workers, and what an
operator says about them is written out by hand in SQL.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph, isolate, rewrite, search
from .plans.chain import Chain
from .selection import Grove, Selection
from .sources import files
from .sources.languages import BUILT_IN

_PYTHON = """import os
import json

def make_{k}(size, kind={s}):
    total = load_{s}(size)
    return os.path.join(str(total), kind)

class Part{k}:
    @cached
    def name(self):
        # part {k}
        return make_{k}(1)

async def close_{k}():
    pass"""
_SCRIPT = """import {{ load }} from "./load.js";
export class Part{k} {{
  make(size, kind) {{
    if (size > {s}) {{ return load_{s}(size); }}
    return null;
  }}
}}
function close_{k}(now) {{ make_{k}(now); }}"""
_NOTES = "# part {k}\n\nsize {s}\n\n## use\n\n- one\n- two\n\n# end"


def _sql_text(template: str) -> str:
    """A template as an SQL expression over k and s."""
    quoted = template.format(k="\0k\0", s="\0s\0").replace("'", "''").split("\0")
    return " || ".join(part if part in ("k", "s") else "'" + part.replace("\n", "' || chr(10) || '") + "'" for part in quoted)


def _sources(spark: SparkSession, sf_dir: str, template: str = _PYTHON, ending: str = ".py") -> DataFrame:
    part = files.spread(files.measuring(spark).read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s")), "k")
    pieces = template.format(k="\0k\0", s="\0s\0").split("\0")
    text = F.concat(*[F.col(x).cast("string") if x in ("k", "s") else F.lit(x) for x in pieces])
    return part.select(F.concat(F.lit("part/"), "k", F.lit(ending)).alias("file_path"), text.alias("text"))


def _src(template: str = _PYTHON, ending: str = ".py") -> str:
    return f"src AS (SELECT 'part/' || k || '{ending}' AS file_path, k, s, {_sql_text(template)} AS text FROM (SELECT p_partkey AS k, p_size AS s FROM part))"


def _grove(spark: SparkSession, sf_dir: str, template: str = _PYTHON, ending: str = ".py") -> Grove:
    sources = _sources(spark, sf_dir, template, ending)
    return Grove(sources.sparkSession, nodes=BUILT_IN.nodes(sources), sources=sources)


def register(add: Callable[[str, Callable, str | None], None]) -> None:
    def code(name: str, build: Callable[[Grove], DataFrame], sql: str, template: str = _PYTHON, ending: str = ".py") -> None:
        add(name, lambda spark, sf_dir: build(_grove(spark, sf_dir, template, ending)), f"WITH {_src(template, ending)} {sql}")

    def nodes(name: str, build: Callable[[Grove], Selection], *rows: tuple[str, int, int], template: str = _PYTHON, ending: str = ".py", where: str = "true") -> None:
        """A query of nodes, whose names (SQL) and lines are given for each file."""
        union = " UNION ALL ".join(f"SELECT file_path, {n} AS name, {a} AS start_line, {b} AS end_line FROM src WHERE {where}" for n, a, b in rows)
        code(name, lambda g: build(g).df.select("file_path", "name", "start_line", "end_line"), union, template, ending)

    make, part, close = ("'make_' || k", 4, 6), ("'Part' || k", 8, 12), ("'close_' || k", 14, 15)
    name = ("'name'", 10, 12)
    # selectors that need real code
    nodes("code_functions", lambda g: g.find(".fn"), make, name, close)
    nodes("code_imports", lambda g: g.find(".import"), ("'os'", 1, 1), ("'json'", 2, 2))
    nodes("code_async", lambda g: g.find(".fn:async"), close)
    nodes("code_decorated", lambda g: g.find(":decorated"), name)
    nodes("code_params", lambda g: g.find(".fn[params>=2]"), make)
    nodes("code_lines", lambda g: g.find(".cls[lines>3]"), part)
    nodes("code_called_by", lambda g: g.find(".call:called-by(name)"), ("'make_' || k", 12, 12))
    nodes("code_is_called", lambda g: g.find(".fn:is-called"), make)
    nodes("code_unreferenced", lambda g: g.find(".fn:unreferenced"), name, close)
    nodes("code_is_referenced", lambda g: g.find(".fn:is-referenced"), make)
    nodes("code_matches", lambda g: g.find(".call:matches('^make_[0-9]+[(]1')"), ("'make_' || k", 12, 12))
    nodes("code_scope_type", lambda g: g.find(".ret:scope(.cls)"), ("NULL::VARCHAR", 12, 12))
    nodes("code_comment", lambda g: g.find(".comment:contains('part 7')"), ("NULL::VARCHAR", 11, 11), where="starts_with(CAST(k AS VARCHAR), '7')")
    nodes("element_callers", lambda g: g.find(".fn[name^='make_']::callers"), name)
    nodes("element_callees", lambda g: g.find(".fn[name^='make_']::callees"), ("'load_' || s", 5, 5), ("'join'", 6, 6), ("'str'", 6, 6))
    nodes("element_references", lambda g: g.find(".fn[name^='make_']::references"), ("'make_' || k", 12, 12), ("'make_' || k", 12, 12))
    nodes("element_scope", lambda g: g.find(".call#str::scope"), ("CAST(k AS VARCHAR)", 1, 15), make)
    nodes("element_prev_sibling", lambda g: g.find(".cls::prev-sibling"), make)
    # steps
    nodes("code_callers", lambda g: g.find(".fn[name^='make_']").callers(), name)
    nodes("code_last_line", lambda g: g.find(".fn").filter(end_line__gt=12, start_line__lt=15, name__endswith=""), close)
    nodes("filter_contains", lambda g: g.find("*").filter(name__contains="ake_", type="function_definition"), make)
    nodes("filter_endswith", lambda g: g.find(".fn").filter(name__endswith="ame"), name)
    nodes("filter_lte", lambda g: g.find(".fn").filter(end_line__lte=12, start_line__gte=10), name)
    nodes("filter_quoted", lambda g: Selection(g.trees, g.find(".fn").df.withColumn("name", F.concat(F.lit("100%_'"), "name"))).filter(name__startswith="100%_'ma"), ("'100%_''make_' || k", 4, 6))
    code("code_containing", lambda g: g.find(".fn").containing("load_7(").df.select("file_path", "name"), "SELECT file_path, 'make_' || k AS name FROM src WHERE s = 7")
    code("code_text", lambda g: g.find(".fn[name^='close_']").text_df().select("file_path", "text"), "SELECT file_path, 'async def close_' || k || '():' || chr(10) || '    pass' AS text FROM src")
    code("code_attr", lambda g: g.find(".fn#name").df.select("file_path", "qualified_name", "depth", "descendant_count"), "SELECT file_path, 'Part' || k || '.name' AS qualified_name, 3 AS depth, 11 AS descendant_count FROM src")
    code("code_reachable", lambda g: graph.reachable(g.trees.nodes, g.find(".fn#name").df).groupBy("distance").agg(F.count("*").alias("n")), "SELECT 0 AS distance, 1::BIGINT AS n UNION ALL SELECT 1, count(DISTINCT k) FROM src")
    code(
        "code_isolate",
        lambda g: isolate.isolate(g.trees.nodes, g.find(".fn[name^='make_']").df, g.trees.sources).select("file_path", "name", F.array_join("params", ",").alias("params"), F.array_join("imports", ";").alias("imports"), F.array_join("builtins", ",").alias("builtins"), "body"),
        "SELECT file_path, 'make_' || k AS name, 'load_' || s AS params, 'import os' AS imports, 'str' AS builtins, 'def make_' || k || '(size, kind=' || s || '):' || chr(10) || '    total = load_' || s || '(size)' || chr(10) || '    return os.path.join(str(total), kind)' AS body FROM src",
    )
    # views
    block = lambda a, b, body: f"SELECT file_path, '# ' || file_path || ':{a}-{b}' || chr(10) || chr(10) || '```python' || chr(10) || {body} || chr(10) || '```' AS markdown FROM src"
    shown = lambda q: lambda g: g.view_df(q).select("file_path", "markdown")
    code("view_body", shown(".fn[name^='close_']"), block(14, 15, "'async def close_' || k || '():' || chr(10) || '    pass'"))
    code("view_lines", shown(".fn[name^='make_'] { show: 2; }"), block(4, 6, "'def make_' || k || '(size, kind=' || s || '):' || chr(10) || '    total = load_' || s || '(size)'"))
    code("view_signature", shown(".fn[name^='make_'] { show: signature; }"), block(4, 6, "'def make_' || k || '(size, kind):'"))
    code("view_outline", shown(".cls { show: outline; }"), block(8, 12, "'class Part' || k || ':' || chr(10) || '    def name(self):'"))
    code("view_enclosing", shown(".call#str { show: enclosing; }"), block(4, 6, "'def make_' || k || '(size, kind=' || s || '):' || chr(10) || '    total = load_' || s || '(size)' || chr(10) || '    return os.path.join(str(total), kind)'"))

    # edits, planned in workers
    def edited(name: str, selector: str, op: str, args: tuple, old: str, new: str) -> None:
        """``old`` and ``new`` are SQL expressions for the text that an edit takes out and puts in."""
        code(name, lambda g: g.find(selector).planned(op, *args).select("file_path", "new_text", "errors"), f"SELECT file_path, replace(text, {old}, {new}) AS new_text, 0 AS errors FROM src")

    nl, head = "chr(10)", "'def make_' || k || '(size, kind=' || s"
    total = "'    total = load_' || s || '(size)'"
    edited("edit_rename", ".fn[name^='make_']", "rename", ("built",), "'def make_' || k", "'def built'")
    edited("edit_add_param", ".fn[name^='make_']", "addParam", ("debug=False",), head, f"{head} || ', debug=False'")
    edited("edit_remove_param", ".fn[name^='make_']", "removeParam", ("kind",), "'(size, kind=' || s || ')'", "'(size)'")
    edited("edit_add_arg", ".call[name^='load_']", "addArg", ("strict=True",), "'load_' || s || '(size)'", "'load_' || s || '(size, strict=True)'")
    edited("edit_remove_arg", ".call[name^='load_']", "removeArg", ("size",), "'load_' || s || '(size)'", "'load_' || s || '()'")
    edited("edit_prepend", ".fn[name^='make_']", "prepend", ("check(size)",), total, f"'    check(size)' || {nl} || {total}")
    edited("edit_append", ".fn[name^='close_']", "append", ("done()",), "'    pass'", f"'    pass' || {nl} || '    done()'")
    edited("edit_clear_body", ".fn#name", "clearBody", (), f"'        # part ' || k || {nl} || '        return make_' || k || '(1)'", "'        pass'")
    edited("edit_replace", ".fn[name^='close_']", "replaceWith", ("def gone():\n    return 1",), f"'async def close_' || k || '():' || {nl} || '    pass'", f"'def gone():' || {nl} || '    return 1'")
    edited("edit_substitute", ".fn[name^='make_']", "replaceWith", ("str(total)", "repr(total)"), "'str(total)'", "'repr(total)'")
    edited("edit_wrap", ".call[name^='load_']", "wrap", ("with lock:",), total, f"'    with lock:' || {nl} || '    ' || {total}")
    edited("edit_remove", ".cls", "remove", (), f"'class Part' || k || ':' || {nl} || '    @cached' || {nl} || '    def name(self):' || {nl} || '        # part ' || k || {nl} || '        return make_' || k || '(1)' || {nl}", "''")
    edited("edit_insert_before", ".fn[name^='make_']", "insertBefore", (".ret", "log(total)"), "'    return os.path'", f"'    log(total)' || {nl} || '    return os.path'")
    edited("edit_insert_after", ".fn[name^='make_']", "insertAfter", (".assign", "log(total)"), total, f"{total} || {nl} || '    log(total)'")
    edited("edit_patch", ".fn[name^='close_']", "patch", ("@@ -2,1 +2,2 @@\n-    pass\n+    stop()\n+    return",), "'    pass'", f"'    stop()' || {nl} || '    return'")
    code("edit_faults", lambda g: g.find(".fn[name^='close_']").planned("replaceWith", "def broken(:").select("file_path", "errors"), "SELECT file_path, 1 AS errors FROM src")
    code(
        "edit_diff",
        lambda g: rewrite.diffs(g.find(".fn[name^='close_']").planned("append", "done()")).select("file_path", "diff"),
        f"SELECT file_path, '--- a/' || file_path || {nl} || '+++ b/' || file_path || {nl} || '@@ -12,4 +12,5 @@' || {nl} || '         return make_' || k || '(1)' || {nl} || ' ' || {nl} || ' async def close_' || k || '():' || {nl} || '-    pass' || '+    pass' || {nl} || '+    done()' AS diff FROM src",
    )

    # chains and search
    def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
        said = Chain.from_argv(["x", "find", ".fn", "page", "1", "7", "count"]).evaluate(spark, _grove(spark, sf_dir), with_total=True)
        return spark.createDataFrame([(said["data"], said["page"]["total"], said["page"]["has_more"])], "here long, total long, more boolean")

    add("chain_paged_total", paged, f"WITH {_src()} SELECT 7::BIGINT AS here, 3 * count(*) AS total, 3 * count(*) > 14 AS more FROM src")

    def dry(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = _grove(spark, sf_dir)
        chain = Chain.from_argv(["--dry-run", "x", "find", ".fn[name^='make_']", "rename", "built", "--", "find", ".fn#built", "addParam", "debug=False"])
        edits = chain.edits(g)
        return edits.planned().select("file_path", "new_text")

    add("chain_dry_run", dry, f"WITH {_src()} SELECT file_path, replace(text, {head}, 'def built(size, kind=' || s || ', debug=False') AS new_text FROM src")

    def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="boscage-index-")
        rows = _sources(spark, sf_dir).select(F.col("file_path").alias("id"), "text", F.create_map(F.lit("kind"), F.lit("file")).alias("metadata"))
        made = search.Collection(rows.sparkSession, folder, f"parts-{os.urandom(6).hex()}")
        made.create(rows)
        return made.search("load 7 close 77", 40, F.col("metadata")["kind"] == "file").select("id", "score")

    words = "[w for w in string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+') if w <> '']"
    add(
        "search_index",
        indexed,
        f"""WITH {_src()}, t AS (SELECT file_path AS id, {words} AS ws FROM src), st AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM t), p AS (SELECT id, len(ws) AS length, unnest(ws) AS term FROM t),
c AS (SELECT id, term, length, count(*) AS tf FROM p WHERE term IN ('load', '7', 'close', '77') GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM c GROUP BY term)
SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {search.K1 + 1} / (tf + {search.K1} * ({1 - search.B} + {search.B} * length / mean))), 6) AS score FROM c JOIN d USING (term), st GROUP BY id ORDER BY score DESC, id LIMIT 40""",
    )
    # other languages
    script = {"template": _SCRIPT, "ending": ".js"}
    nodes("script_functions", lambda g: g.find(".fn"), ("'make'", 3, 6), ("'close_' || k", 8, 8), **script)
    nodes("script_classes", lambda g: g.find(".cls:has(.if)"), ("'Part' || k", 2, 7), **script)
    nodes("script_calls", lambda g: g.find(".fn .call"), ("'load_' || s", 4, 4), ("'make_' || k", 8, 8), **script)
    code("script_parameters", lambda g: g.find(".fn#make").df.select("file_path", F.array_join(F.transform("parameters", lambda p: p["name"]), ",").alias("names"), F.col("language")), "SELECT file_path, 'size,kind' AS names, 'javascript' AS language FROM src", **script)
    notes = {"template": _NOTES, "ending": ".md"}
    nodes("notes_sections", lambda g: g.find("section"), ("'part ' || k", 1, 9), ("'use'", 5, 9), ("'end'", 10, 10), **notes)
    nodes("notes_lists", lambda g: g.find("section > section list"), ("NULL::VARCHAR", 7, 8), **notes)
