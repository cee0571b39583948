import json
import os

import pytest

import boscage
from boscage import Block, UnknownLanguageError, View, display_path
from boscage.operators import isolate, view
from boscage.selection import Grove
from boscage.sources import languages, markdown

CODE = '''import os
import json

class Store:
    """Keeps | things."""

    size = 3

    def put(self, key, value: str = "a|b") -> bool:
        path = os.path.join(self.root, key)
        with open(path, "w") as f:
            f.write(json.dumps(value))
        return True

    def get(self, key):
        return self.find(key)

def main(argv):
    for a in argv:
        print(Store().get(a), helper(a))
'''
NOTES = "intro\n\n# Guide\n\ntext one\n\n## Install\n\n```sh\n# not a heading\n```\n\n### Linux\n\nuse it\n\n## Usage ##\n\nsay hello\n\n# Other\nend\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("proj")
    (at / "store.py").write_text(CODE)
    (at / "guide.md").write_text(NOTES)
    (at / "data.bin").write_bytes(b"\x00\x01")
    (at / "go.js").write_text("export function go(a, b) {\n  return run(a);\n}\n")
    return at


@pytest.fixture(scope="module")
def grove(spark, folder):
    return Grove(spark, f"{folder}/*.py")


def test_parse_rules():
    rules = view.parse_rules("/* c */ .fn#a\n.cls { show: outline; }\n.call{show: 'body'; x: y}")
    assert [(r.selector, r.show) for r in rules] == [(".fn#a", "body"), (".cls", "outline"), (".call", "body")] and rules[2].declarations["x"] == "y"
    assert view.parse_rules(".cls")[0].show == "signature" and view.parse_rules("  ") == []


@pytest.mark.parametrize("bad", [".fn { show: nothing; }", ".fn { show }", ".fn { show: ; }", ".fn { show: body;", ".fn }"])
def test_bad_rules(bad):
    with pytest.raises(ValueError):
        view.parse_rules(bad)


@pytest.mark.parametrize(
    "query,has,hasnt",
    [
        (".fn#get", "    def get(self, key):\n        return self.find(key)", "def put"),
        (".fn#put { show: signature; }", "def put(self, key, value: str) -> bool:", "os.path"),
        (".fn#put { show: 1; }", 'value: str = "a|b") -> bool:', "os.path"),
        (".cls { show: outline; }", "    def put(self, key, value: str) -> bool:\n    def get(self, key):", "json.dumps"),
        (".call#dumps { show: enclosing; }", "def put(self", "def get"),
        (".cls", "class Store:", "def put"),
    ],
)
def test_shows(grove, query, has, hasnt):
    text = str(grove.view(query))
    assert has in text and hasnt not in text and "```python" in text


def test_several_heads_are_a_table(grove):
    v = grove.view(".fn { show: signature; }")
    assert len(v) == 1 and v[0].aggregate and v.files == [] and v.tabular[1] == []
    assert v.markdown.count("\n") == 4 and "| 9-13 | `def put(self, key, value: str) -> bool:` |" in v.markdown
    assert v.relation.count() == 3


def test_cells_are_escaped(spark):
    df = spark.createDataFrame([("a |  b\n c",)], "t string")
    assert df.select(view.cell(df.t)).first()[0] == "a \\| b c"


def test_view_is_a_container(grove):
    v = grove.view(".fn#get\n.fn#main")
    assert [b.name for b in v] == ["get", "main"] and len(v) == 2 and v and v[0].name == "get" and [b.name for b in v[:1]] == ["get"]
    assert "def main" in v and 3 not in v and v == str(v) and v == View(v.blocks) and hash(v) == hash(str(v)) and v.query == ".fn#get\n.fn#main"
    assert repr(v) == "<View of 2 blocks in 1 files>" and not View([]) and v.files == [v[0].file_path]
    columns, rows = v.tabular
    assert dict(zip(columns, rows[0])) == {"file_path": v[0].file_path, "name": "get", "type": "function_definition", "start_line": 15, "end_line": 16, "language": "python"}
    assert sorted(r["name"] for r in v.relation.collect()) == ["get", "main"]
    again = View.from_json(v.to_json())
    assert again == v and json.loads(v.to_json())["blocks"][0]["aggregate"] is False
    with pytest.raises(ValueError):
        again.relation
    assert View.from_dict({"blocks": [{"markdown": "x", "other": 1}]})[0] == Block("x", "")


def test_isolate(grove):
    (row,) = grove.find(".for").isolate().collect()
    assert list(row.params) == ["Store", "argv", "helper"] and list(row.imports) == [] and list(row.builtins) == ["print"]
    (row,) = grove.find(".fn#put").isolate().collect()
    assert list(row.imports) == ["import os", "import json"] and list(row.builtins) == ["open", "str", "bool"] or sorted(row.builtins) == ["bool", "open", "str"]
    text = isolate.as_function(row, "kept")
    assert text.startswith("import os\nimport json\n") and "def kept(" in text
    compile(text, "x", "exec")
    assert isolate.as_cell(grove.find(".for").isolate().first()).startswith("Store = ...")


def test_terminals(grove):
    fns = grove.find(".fn")
    assert fns.count() == len(fns) == 3 and bool(fns) and not grove.find("#nothing") and fns.attr("name") == ["put", "get", "main"] and fns.complexity() == fns.attr("descendant_count")
    assert fns.text()[1] == "    def get(self, key):\n        return self.find(key)" and fns.read() == "\n".join(fns.text()) and {r["name"] for r in fns} == {"put", "get", "main"} == {r["name"] for r in fns.rows()}
    assert list(fns.to_df()["name"]) == ["put", "get", "main"] and fns.first().names() == ["put"] and fns.last().names() == ["main"] and fns.nth(1).names() == ["get"]
    assert "find('.fn')" in repr(fns) and "3 nodes" in repr(fns) and str(fns).endswith(":18 main") and len(fns.files()) == 1
    assert fns.relation is fns.df and grove.spark is fns.spark
    with pytest.raises(ValueError):
        fns.attr("nothing")
    with pytest.raises(AttributeError):
        fns.nothing
    assert grove.spark.sql(f"SELECT count(*) FROM {fns.as_view('all_nodes')}").first()[0] == grove.all().count()


@pytest.mark.parametrize("kw,names", [({"name": "put"}, ["put"]), ({"name__endswith": "t"}, ["get", "put"]), ({"start_line__gt": 15}, ["main"]), ({"start_line__lt": 15}, ["put"]), ({"end_line__gte": 16}, ["get", "main"]), ({"end_line__lte": 16}, ["get", "put"]), ({"min_lines": 5}, ["put"]), ({"max_lines": 2}, ["get"]), ({"min_depth": 3}, ["get", "put"]), ({"signature_type": "bool"}, ["put"]), ({"signature_type": None}, ["get", "main"])])
def test_filter_keywords(grove, kw, names):
    assert grove.find(".fn").filter(**kw).names() == names


@pytest.mark.parametrize("kw", [{"nothing": 1}, {"name__like": "x"}, {"start_line__gt": "x"}, {"start_line__gt": True}])
def test_bad_keywords(grove, kw):
    with pytest.raises(ValueError):
        grove.find(".fn").filter(**kw)


def test_steps(grove):
    fns = grove.find(".fn")
    assert fns.filter() is fns and fns.filter(":exported", ":has(with_statement)").names() == ["put"] and fns.filter_sql("name LIKE 'g%'").names() == ["get"] and fns.not_("#put").names() == ["get", "main"]
    assert fns.at_line(12).names() == ["put"] and fns.at_lines(13, 15).names() == ["get", "put"] and fns.containing("json.dumps").names() == ["put"]
    assert fns.parent().names() == ["store"] and fns.children().count() > 6 and grove.find(".fn#get").siblings().names() == ["put", "size"] and grove.find(".fn#put").next().names() == ["get"] and grove.find(".fn#get").prev().names() == ["put"]
    assert {"Store", "put", "size"} <= set(grove.find("#get").siblings().names())  # the call in main has this name too
    assert grove.find(".call#dumps").ancestor(".cls").names() == ["Store"] and grove.find(".cls").find(".fn").names() == ["get", "put"] and fns.page(1, 2).names() == ["main"]
    assert grove.find(".fn#get").callers().names() == ["main"] and "helper" in grove.find(".fn#main").callees().names() and grove.find(".cls").references().count() == 2
    assert "path" in grove.find(".fn#put").defs().names() and grove.find(".fn#put").defs("path").count() >= 1 and "key" in grove.find(".fn#put").refs().names()


def test_languages_through_one_door(spark, folder):
    everything = Grove(spark, f"{folder}/*")
    assert set(os.path.basename(f) for f in everything.find("*").files()) == {"store.py", "guide.md", "go.js"}
    assert everything.find(".fn#go").attr("language") == ["javascript"] and everything.find("section").names() == ["Guide", "Install", "Linux", "Other", "Usage"]
    assert [p["name"] for p in everything.find(".fn#go").rows()[0]["parameters"]] == ["a", "b"]
    for bad in (f"{folder}/*.bin", f"{folder}/data.bin"):
        with pytest.raises(UnknownLanguageError, match="bin"):
            Grove(spark, bad)
    own = languages.BUILT_IN.copy()
    own.register("bin", lambda text, path: markdown.parse("# bin", path), ".bin")
    assert Grove(spark, f"{folder}/*.bin", languages=own).find("section").names() == ["bin"]
    assert not languages.BUILT_IN.reads("x.bin") and languages.BUILT_IN.reads("A/B.PY")


@pytest.mark.parametrize(
    "name,text,want",
    [
        ("a.ts", "class A<T> {\n  async get(id: number, n?: string): Promise<T> {\n    return load(id);\n  }\n}\nconst add = (x: number) => {\n  return x;\n};\n", [("A", "class"), ("get", "fn"), ("add", "fn")]),
        ("a.go", "package p\n\nfunc (t *T) Run(n int, s string) error {\n\tfor i := 0; i < n; i++ {\n\t\tfmt.Println(s)\n\t}\n\treturn nil\n}\n\ntype T struct {\n\ta int\n}\n", [("Run", "fn"), ("T", "class")]),
        ("A.java", "package x;\npublic class A extends B {\n  @Override\n  public int sum(List<Integer> xs) { return f(xs); }\n}\n", [("A", "class"), ("sum", "fn")]),
        ("a.rs", "pub struct P { x: u32 }\nimpl P {\n  pub fn go(&self, y: &str) -> Option<u32> { None }\n}\n", [("P", "class"), ("P", "class"), ("go", "fn")]),
        ("a.c", "#include <stdio.h>\nstatic int add(int a, char *b) {\n  if (a) { return 1; }\n  return 0;\n}\n", [("add", "fn")]),
        ("a.kt", "class K(val a: Int) {\n  fun go(x: Int): Int { return x }\n}\n", [("K", "class"), ("go", "fn")]),
        ("a.php", "<?php\nclass P {\n  function go($a) { return $a; }\n}\n", [("P", "class"), ("go", "fn")]),
        ("a.cs", "namespace N {\n  class C {\n    public int Go(string s) { return s.Length; }\n  }\n}\n", [("C", "class"), ("Go", "fn")]),
        ("a.swift", "struct S {\n  func go(x: Int) -> Int { return x }\n}\n", [("S", "class"), ("go", "fn")]),
    ],
)
def test_brace_languages(name, text, want):
    root = languages.BUILT_IN.of(name)[0](text, name)
    found, todo = [], [root]
    while todo:
        n = todo.pop()
        todo += reversed(n.children)
        if n.semantic in ("DEFINITION_FUNCTION", "DEFINITION_CLASS"):
            found.append((n.name, "fn" if n.semantic == "DEFINITION_FUNCTION" else "class"))
            assert 1 <= n.start <= n.end <= text.count("\n")
    assert found == want and languages.BUILT_IN.errors(text, name) == 0 and languages.BUILT_IN.errors(text + "}", name) == 1


@pytest.mark.parametrize("text", ["", "\n", "x", "{", "}{", "((((", "'open", "/* open", "function", "class {", "a => {", "\x00", "{" * 3000 + "}" * 3000, "f(" * 2000 + ")" * 2000])
def test_odd_texts_are_parsed_all_the_same(text):
    for name in ("a.js", "a.go", "a.rs", "a.py", "a.md", "a.html"):
        assert languages.BUILT_IN.of(name)[0](text, name).end >= 1


def test_docs(spark, folder):
    docs = Grove(spark, repo=str(folder)).docs()
    assert docs.titles() == ["Guide", "Install", "Linux", "Usage", "Other"] and docs.count() == 5 and len(docs.files()) == 1
    rows = {r["title"]: r for r in docs.sections()}
    assert rows["Linux"]["section_path"] == "Guide > Install > Linux" and rows["Usage"]["section_path"] == "Guide > Usage" and rows["Other"]["section_path"] == "Other"
    assert rows["Usage"]["parent_id"] == rows["Guide"]["section_id"] and rows["Linux"]["parent_id"] == rows["Install"]["section_id"] and rows["Other"]["parent_id"] is None
    assert docs.filter(level=2).titles() == ["Install", "Usage"] and docs.filter(min_level=2, max_level=3).count() == 3 and docs.filter(search="HELLO").titles() == ["Usage"] and docs.filter(file_path="guide").count() == 5
    assert docs.outline(1).titles() == ["Guide", "Other"] and docs.search("hello").titles() == ["Usage"] and docs.content()[0].startswith("# Guide") and "# not a heading" in docs.content()[1]


def test_search(spark, grove, folder, tmp_path):
    assert grove.search("json dumps").names() == ["Store", "put"] and grove.search("json", kind="function").names() == ["put"] and grove.find(".fn").search("get", 1).count() == 1
    assert grove.search("nothing at all like it").count() == 0
    both = Grove(spark, f"{folder}/*.py", repo=str(folder))
    index = both.build_index(str(tmp_path / "index"))
    hits = both.search_index(index, "get hello", 10).collect()
    assert {(h.extractor, h.kind) for h in hits} >= {("code", "function"), ("docs", "section")} and hits == sorted(hits, key=lambda h: -h.score)
    assert all(h.extractor == "docs" for h in both.search_index(index, "hello", extractor="docs").collect()) and {h.kind for h in both.search_index(index, "get", kind="class").collect()} == {"class"}
    both.build_index(str(tmp_path / "index"))
    assert both.search_index(index, "hello", extractor="docs").count() == 1 and len([d for d in os.listdir(tmp_path / "index" / "content") if d != "current"]) == 1


def test_module_functions(spark, folder):
    code = f"{folder}/*.py"
    assert boscage.find(".fn", code, spark=spark) == [(f"{folder}/store.py", 9, "put"), (f"{folder}/store.py", 15, "get"), (f"{folder}/store.py", 18, "main")]
    assert boscage.find("block", code, spark=spark)[0][2] == "block" and [r[2] for r in boscage.search("dumps", code, kind="function", spark=spark)] == ["put"]
    assert "def get" in boscage.view(".fn#get", code, spark=spark) and boscage.select(".cls", str(folder), spark).names() == ["Store"]


def test_display_path(tmp_path, monkeypatch):
    monkeypatch.setenv("HOME", "/home/someone")
    assert display_path("/a/b/c.py", "/a") == "b/c.py" and display_path("/a", "/a") == "." and display_path("/home/someone/x/y.py", "/srv") == "~/x/y.py" and display_path("/opt/z.py", "/srv") == "/opt/z.py"
    monkeypatch.chdir(tmp_path)
    assert display_path("here.py") == "here.py"
