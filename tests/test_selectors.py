import pytest

from boscage import SelectorArgumentError, SelectorError, Selector, UnknownClassError, resolve_alias, resolve_aliases
from boscage.plans.selector import parse
from boscage.plans.vocabulary import EXACT, NUMBERS, SEMANTIC, SHORT, semantic_name
from boscage.selection import Grove

CODE = '''import os, json as j
LIMIT = 3

class Shop(Base):
    """A shop."""
    def open(self, key, timeout: int = 3):
        if key:
            return self._unlock(key)
        for k in range(LIMIT):
            log(k)
        raise ValueError("no key")

    def _unlock(self, key):
        return len(key) > 1

    @property
    def name(self):
        return "shop"

async def visit(shop):
    await shop.open("a b")

def test_open():
    try:
        assert Shop().open(1)
    except TypeError:
        pass
'''


@pytest.fixture(scope="module")
def grove(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("code")
    (folder / "shop.py").write_text(CODE)
    return Grove(spark, f"{folder}/*.py")


@pytest.mark.parametrize(
    "selector,names",
    [
        (".fn", ["_unlock", "name", "open", "test_open", "visit"]), (".cls", ["Shop"]), (".definition", None), (".function", ["_unlock", "name", "open", "test_open", "visit"]), ("function_definition#open", ["open"]),
        (".cls .fn", ["_unlock", "name", "open"]), (".cls > block > .fn", ["_unlock", "name", "open"]), (".fn:exported", ["name", "open", "test_open", "visit"]), (".fn:private", ["_unlock"]), (".fn:async", ["visit"]), (".fn:decorated", ["name"]),
        (".fn:has(.if)", ["open"]), (".fn:not(:has(.ret))", ["test_open"]), (".fn:has(.ret):not(:has(.call))", ["name"]), (".fn:is(#open, #visit)", ["open", "visit"]), (".fn:where(#open)", ["open"]), (".fn[name^=test_]", ["test_open"]), (".fn[name$='en']", ["open", "test_open"]), (".fn[name*=nlo]", ["_unlock"]),
        (".fn[params>=2]", ["_unlock", "open"]), (".fn[params=1]", ["name", "visit"]), (".fn[lines>4]", ["open", "test_open"]), (".fn:long(4)", ["open"]), (".fn + .fn", ["_unlock", "name", "test_open"]), (".fn#open ~ .fn", ["_unlock", "name"]), (".cls + .fn", ["visit"]),
        (".fn:calls(log)", ["open"]), (".call:called-by(visit)", ["open"]), (".fn:is-called", ["_unlock", "open"]), (".fn:unreferenced", ["name", "test_open", "visit"]), (".fn:line(14)", ["_unlock"]), (".fn:lines(13, 14)", ["_unlock"]), (".fn:contains('def name')", ["name"]), (".fn:matches('^def (open|name)')", ["name", "open"]),
        (".call#log::parent-definition", ["open"]), (".fn#_unlock::callers", ["open"]), (".fn#visit::callees", ["open"]), (".fn#open::next-sibling", ["_unlock"]), (".fn#_unlock::prev-sibling", ["open"]), (".fn#_unlock::scope", ["Shop", "shop"]), (".try .call", ["Shop", "open"]), (".if .ret .call", ["_unlock"]),
        (".fn#open, .cls", ["Shop", "open"]), (".call:has(.str)", ["ValueError", "open"]), (".fn:scope(.cls)", ["_unlock", "name", "open"]), (".import", ["os"]),
    ],
)
def test_matches(grove, selector, names):
    found = grove.find(selector)
    assert found.names() == names if names is not None else found.count() > 5


@pytest.mark.parametrize("bad", ["", "   ", ".fn:", ".fn >", "> .fn", ".fn[", ".fn[name]", ".fn[name=", ".fn:has", ".fn:has(", ".fn::nothing", ".fn:nth-child(x)", ".fn:long()", ".fn:lines(1)", ".fn[params=x]", ".fn[nothing=1]", ".fn)", ".fn 'x", ":unknown-one", ".fn:calls()"])
def test_bad_selectors(grove, bad):
    with pytest.raises(SelectorError):
        grove.find(bad)


@pytest.mark.parametrize("cls", ["guard", "self", "super", "docstring", "new", "bits", "gen", "nosuch"])
def test_classes_that_no_node_has(grove, cls):
    with pytest.raises(UnknownClassError):
        grove.find("." + cls)


def test_arguments_that_do_not_fit_are_selector_errors():
    assert issubclass(SelectorArgumentError, SelectorError) and issubclass(UnknownClassError, SelectorError)


def test_selector_text():
    s = Selector(".fn:has(.ret)")
    assert s == ".fn:has(.ret)" and len(s.tree) == 1
    with pytest.raises(SelectorError):
        Selector(".fn[")


def test_aliases():
    assert resolve_alias(".fn#main") == ".def-func#main" and resolve_alias("call") == "call" and resolve_alias(".nosuch") == ".nosuch"
    assert resolve_aliases(".cls > .fn:has(.str[name='.fn'])") == ".def-class > .def-func:has(.literal-str[name='.fn'])"
    assert all(semantic_name(s) for s in SHORT if SHORT[s] in SEMANTIC)
    assert all(semantic_name(n.lower()) == n for n in EXACT)
    assert len(set(NUMBERS.values())) == len(EXACT) and NUMBERS["NAME_IDENTIFIER"] == 80


def test_values_in_quotes_may_hold_anything():
    (s,) = parse(r""".fn[name="a]b\"c"]:contains('x) > y')""")
    assert s.parts[0].attributes == [("name", "=", 'a]b"c')] and s.parts[0].pseudos == [("contains", ["x) > y"])]


def test_literal_underscores_and_percents(spark, tmp_path):
    (tmp_path / "a.py").write_text("def ab():\n    pass\ndef a_b():\n    pass\ndef axb():\n    pass\n")
    g = Grove(spark, f"{tmp_path}/*.py")
    assert g.find(".fn[name^=a_]").names() == ["a_b"]
    assert g.find(".fn").filter(name__contains="_").names() == ["a_b"] and g.find(".fn").filter(name__startswith="%").count() == 0


def test_a_deep_tree(spark, tmp_path):
    depth = 80
    (tmp_path / "deep.py").write_text("".join("    " * k + f"def f{k}():\n" for k in range(depth)) + "    " * depth + "call()\n")
    g = Grove(spark, f"{tmp_path}/deep.py")
    assert g.find(".call").ancestor(".fn", nearest=True).names() == [f"f{depth - 1}"]
    assert g.find(".fn#f3 .fn").count() == depth - 4
