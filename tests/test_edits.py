import os

import pytest

from boscage.operators import rewrite
from boscage.operators.rewrite import RewriteError
from boscage.plans.chain import Chain
from boscage.selection import Grove

CODE = '''def greet(name, loud=False):
    text = hello(name, loud)
    return text

def farewell(name):
    return bye(name)

class Config:
    path = "x"

    def load(self):
        return open(self.path)
'''


@pytest.fixture
def file(tmp_path):
    path = tmp_path / "mod.py"
    path.write_text(CODE)
    return path


@pytest.fixture
def grove(spark, file):
    return Grove(spark, f"{file.parent}/*.py")


@pytest.mark.parametrize(
    "selector,op,args,old,new",
    [
        (".fn#greet", "rename", ("salute",), "def greet", "def salute"),
        (".fn#greet", "addParam", ("n: int = 1",), "loud=False)", "loud=False, n: int = 1)"),
        (".fn#greet", "removeParam", ("loud",), "(name, loud=False)", "(name)"),
        (".fn#load", "addParam", ("mode",), "(self)", "(self, mode)"),
        (".call#hello", "addArg", ("n=2",), "hello(name, loud)", "hello(name, loud, n=2)"),
        (".call#hello", "removeArg", ("loud",), "hello(name, loud)", "hello(name)"),
        (".fn#farewell", "prepend", ("check(name)",), "    return bye", "    check(name)\n    return bye"),
        (".fn#farewell", "append", ("done()",), "    return bye(name)", "    return bye(name)\n    done()"),
        (".fn#farewell", "clearBody", (), "    return bye(name)", "    pass"),
        (".fn#farewell", "replaceWith", ("bye(name)", "later(name)"), "bye(name)", "later(name)"),
        (".fn#load", "replaceWith", ("def load(self):\n    return 1",), "        return open(self.path)", "        return 1"),
        (".call#hello", "wrap", ("with lock:",), "    text = hello(name, loud)", "    with lock:\n        text = hello(name, loud)"),
        (".fn#farewell", "insertBefore", (".ret", "log()"), "    return bye", "    log()\n    return bye"),
        (".fn#greet", "insertAfter", (".assign", "log()"), "hello(name, loud)\n", "hello(name, loud)\n    log()\n"),
        (".fn#farewell", "remove", (), "def farewell(name):\n    return bye(name)\n", ""),
        (".fn#farewell", "patch", ("@@ -2,1 +2,1 @@\n-    return bye(name)\n+    return None",), "return bye(name)", "return None"),
    ],
)
def test_edit(grove, file, selector, op, args, old, new):
    want = CODE.replace(old, new)
    assert want != CODE
    planned = grove.find(selector).planned(op, *args).collect()
    assert [r.new_text for r in planned] == [want] and file.read_text() == CODE
    after = getattr(grove.find(selector), op)(*args)
    assert file.read_text() == want
    assert os.listdir(file.parent) == ["mod.py"]
    if op == "rename":  # what follows reads the files anew
        assert grove.find(".fn#salute").count() == 1 and after.count() == 0


def test_a_broken_file_is_not_written(grove, file):
    with pytest.raises(RewriteError, match="mod.py"):
        grove.find(".fn#greet").replaceWith("def greet(:")
    with pytest.raises(RewriteError):
        grove.find(".fn#greet").patch("@@ -1,1 +1,1 @@\n-nothing like it\n+x")
    assert file.read_text() == CODE


def test_all_files_or_none(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.py").write_text(f"def f_{name}():\n    return 1\n")
    g = Grove(spark, f"{tmp_path}/*.py")
    planned = g.find(".fn").planned("append", "x()")
    rows = planned.collect()
    real = os.replace

    def failing(a, b, done=[]):
        done.append(b)
        if len(done) == 2:
            raise OSError("disk full")
        return real(a, b)

    rewrite.os.replace, before = failing, {p: p.read_text() for p in tmp_path.iterdir()}
    try:
        with pytest.raises(OSError, match="disk full"):
            rewrite.commit(planned)
    finally:
        rewrite.os.replace = real
    assert {p: p.read_text() for p in tmp_path.iterdir()} == before and len(rows) == 2


def test_of_nodes_that_overlap_the_inner_is_edited(grove, file):
    grove.find(".cls, .fn#load").replaceWith("path", "place")
    assert file.read_text() == CODE.replace("self.path", "self.place")


def test_other_languages(spark, tmp_path):
    path = tmp_path / "a.js"
    path.write_text("function go(a) {\n  return run(a);\n}\n")
    g = Grove(spark, f"{tmp_path}/*.js")
    g.find(".fn#go").addParam("b")
    g.find(".fn#go").prepend("check();")
    assert path.read_text() == "function go(a, b) {\n  check();\n  return run(a);\n}\n"
    with pytest.raises(RewriteError):
        g.find(".fn#go").replaceWith("function go( {")


def chain(file, *words):
    return Chain.from_argv([*words[: words.index("@")], f"{file.parent}/*.py", *words[words.index("@") + 1 :]])


@pytest.mark.parametrize("flag", ["--dry-run", "--diff"])
def test_dry_run_touches_no_file(spark, file, flag):
    stamp = os.stat(file).st_mtime_ns
    out = chain(file, flag, "@", "find", ".fn#greet", "rename", "salute", "--", "find", ".fn#salute", "addParam", "n=1").evaluate(spark)
    assert out["type"] == "diff" and "+def salute(name, loud=False, n=1):" in out["data"] and "-def greet(name, loud=False):" in out["data"]
    assert file.read_text() == CODE and os.stat(file).st_mtime_ns == stamp and os.listdir(file.parent) == ["mod.py"]


def test_edits_of_a_chain_follow_one_another(spark, file):
    out = chain(file, "@", "find", ".cls", "find", ".fn", "prepend", "log()", "append", "done()", "--", "find", ".fn#farewell", "remove").evaluate(spark)
    assert out["data"] == {"edits": ["prepend", "append", "remove"]}
    text = file.read_text()
    assert "    def load(self):\n        log()\n        return open(self.path)\n        done()" in text and "farewell" not in text


def test_a_chain_that_breaks_writes_nothing(spark, file):
    with pytest.raises(RewriteError):
        chain(file, "@", "find", ".fn#greet", "rename", "salute", "--", "find", ".fn#farewell", "replaceWith", "def (").evaluate(spark)
    assert file.read_text() == CODE


def test_limit_before_an_edit_limits_it(spark, file):
    chain(file, "@", "find", ".fn", "limit", "1", "append", "x()").evaluate(spark)
    assert file.read_text().count("x()") == 1
