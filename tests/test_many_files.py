"""What must hold for queries over a table that names more files than one core can parse."""

import io
import tokenize

import pytest

from boscage import catalog, catalog_code
from boscage.operators import view
from boscage.sources import python_code


def test_files_of_one_row_group_are_parsed_by_all_cores(spark, sf_dir):
    grove = catalog_code._grove(spark, sf_dir)
    sizes = [n for n in grove.trees.sources.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert sum(sizes) == 200 and len(sizes) == 4


@pytest.mark.parametrize("name", ["code_isolate", "code_callers", "code_unreferenced"])
def test_nodes_are_not_sent_to_the_driver_by_a_guess(spark, sf_dir, name):
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in plan and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"


@pytest.mark.parametrize("text", ["x = '# no' # yes\n", "s = '''\n# no\n''' # yes", "r'\\' # in' # out", 'f"{x["a"]:#x}" # y', "a = 1 \\\n  + 2 # k", "x='a\\\n#b' # c", "# a\r\n# b\r\n", "u = rb'''#''' ; v = \"\"\"\\\"\"\"#\"\"\" # d"])
def test_comments_are_those_of_the_tokenizer(text):
    want = [(t.start[0], t.string) for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type == tokenize.COMMENT]
    assert python_code._comments(text) == want


def test_texts_and_edits_start_no_group_for_each_file(spark, sf_dir):
    g = catalog_code._grove(spark, sf_dir)
    for df in (view.texts(g.find(".fn").df, g.trees.sources), g.find(".fn#name").planned("append", "done()")):
        assert "FlatMap" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_end_with_the_file(spark):
    sources = spark.createDataFrame([("a", "x\r\ny\n"), ("b", "z"), ("c", None)], "file_path string, text string")
    rows = spark.createDataFrame([("a", 1, 2), ("a", 2, 9), ("a", 3, 3), ("b", 5, 6), ("b", 1, 0), ("c", 1, 1)], "file_path string, start_line int, end_line int")
    said = {(r.file_path, r.start_line): r.text for r in view.texts(rows, sources).where("NOT (file_path = 'b' AND end_line = 0)").collect()}
    assert said == {("a", 1): "x\ny", ("a", 2): "y\n", ("a", 3): "", ("b", 5): "", ("c", 1): ""}
    assert [r.text for r in view.texts(rows, sources, 1).where("file_path = 'a'").orderBy("start_line").collect()] == ["x", "y", ""]


@pytest.mark.parametrize("name,most", [("code_callers", 4), ("code_isolate", 3), ("edit_insert_after", 3)])
def test_files_are_parsed_a_few_times_at_most(spark, sf_dir, name, most):
    """One of the passes in workers is no parse."""
    assert catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") <= most


def test_reached_names_stay_with_the_executors(spark, sf_dir, monkeypatch):
    def collect(self):
        raise AssertionError("names are collected")

    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.collect", collect)
    found = catalog.QUERIES["code_reachable"](spark, sf_dir)
    monkeypatch.undo()
    assert {r.distance: r.n for r in found.collect()} == {0: 1, 1: 200}


def test_free_names_of_nested_blocks(spark):
    from boscage.operators import isolate
    from boscage.sources.languages import BUILT_IN

    code = "import a.b, c as d; from e import (f,\n  g)\n\ndef outer(x):\n    global k\n    k = d.y(len(x), h)\n    def inner():\n        return f, g, x, a\n    return inner\n"
    sources = spark.createDataFrame([("m.py", code)], "file_path string, text string")
    nodes = BUILT_IN.nodes(sources)
    said = {r["name"]: r for r in isolate.isolate(nodes, nodes.where("type = 'function_definition'"), sources).collect()}
    first = code.split("\n")[0]
    assert (said["outer"].params, said["outer"].builtins, said["outer"].imports) == (["h"], ["len"], [first, first + "\n  g)"])
    assert (said["inner"].params, said["inner"].builtins) == (["x"], []) and said["inner"].body == "    def inner():\n        return f, g, x, a"
