"""Made-up pairs of an intent and a chain, in six manners, each row from its own seed.

A row's random numbers come from the seed and its position alone, so any part of the rows can be
made anywhere and again, and comes out the same.
"""

from __future__ import annotations

import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .corpus import parse_calls
from .grammar import DEFAULT, Spec, load

SCHEMA = "position long, intent string, chain string, shape string, category string, strategy string, context string, language string"
#: Manners and the upper end of their share of the rows: 20, 5, 5, 10, 25 and 35 %.
MIX = (("parametric", 0.20), ("error", 0.25), ("context", 0.30), ("multilang", 0.40), ("scenario", 0.65), ("standard", 1.0))
LENGTHS, LENGTH_WEIGHTS = (2, 3, 4, 5), (35, 40, 18, 7)
WEIGHTS = {"query": 45, "edit": 25, "terminal": 22, "delegate": 8}
LAST_WEIGHTS = {"query": 10, "edit": 10, "terminal": 60, "delegate": 20}
BUILT, PLANNED = 0.8, 0.2
PARAPHRASE, REVERSE = 0.3, 0.1

_VERBS = "load save parse build fetch check render merge split encode decode validate update remove create send read write open close start stop retry flush apply".split()
_NOUNS = "user order token session report config invoice batch page cache queue record event message price account file index job schema".split()
_CLASS_ENDS = ["Service", "Store", "Handler", "Client", "Manager", "Parser"]
_FOLDERS = ["src", "lib", "app", "core", "services", "tools", "tests"]
_VARIABLES = "data result user token response config items payload record value conn cache request buffer".split()
_LANGUAGES = {"python": (".py", "snake"), "javascript": (".js", "camel"), "typescript": (".ts", "camel"), "go": (".go", "pascal"), "rust": (".rs", "snake"), "java": (".java", "camel"), "c": (".c", "snake")}
_SELECTORS = [".fn", ".cls", ".call", ".import", ".ret", ".if", ".for", ".while", ".try", ".except", ".assign", ".str", ".num", ".comment", ".dec"]
_SUBJECTS = {".fn": "functions", ".cls": "classes", ".call": "calls", ".import": "imports", ".ret": "return statements", ".if": "conditionals", ".for": "for loops", ".while": "while loops", ".try": "try blocks", ".except": "except handlers", ".assign": "assignments", ".str": "strings", ".num": "numbers", ".comment": "comments", ".dec": "decorators"}
_NAMED = {".fn", ".cls", ".call"}

#: A message, with what it speaks of in braces, and how it is put right.
_FAULTS = {
    "python": [
        ("TypeError: {fn}() got an unexpected keyword argument '{var}'", "addParam('{var}=None')", "let {fn} take {var}"),
        ("AttributeError: 'NoneType' object has no attribute '{attr}'", "prepend('if {var} is None:\\n    return None')", "guard {fn} against a missing {var}"),
        ("KeyError: '{var}'", "replaceWith('{var}', '{var}_or_none')", "make {fn} survive a missing {var}"),
        ("FileNotFoundError: [Errno 2] No such file or directory: '{path}'", "wrap('try:', 'except FileNotFoundError:\\n    return None')", "handle a missing {path} in {fn}"),
        ("ValueError: invalid literal for int() with base 10: '{val}'", "wrap('try:', 'except ValueError:\\n    raise')", "catch bad numbers such as {val} in {fn}"),
        ("NameError: name '{name}' is not defined", "insertBefore('.ret', 'import {name}')", "define {name} for {fn}"),
        ("TimeoutError: {service} did not answer", "addParam('timeout: int = {n}')", "give {fn} a timeout of {n} seconds for {service}"),
        ("RecursionError: maximum recursion depth exceeded in {fn}", "addParam('depth: int = {n}')", "bound the depth of {fn} by {n}"),
    ],
    "go": [
        ("panic: runtime error: invalid memory address or nil pointer dereference", "prepend('if {var} == nil {{ return nil }}')", "check {var} for nil in {fn}"),
        ("declared and not used: {var}", "replaceWith('{var} :=', '_ =')", "drop the unused {var} in {fn}"),
        ("context deadline exceeded ({service})", "addParam('ctx context.Context')", "pass a context to {fn} for {service}"),
    ],
    "typescript": [
        ("TS2345: Argument of type '{actual}' is not assignable to parameter of type '{expected}'", "replaceWith('{var}', 'String({var})')", "convert {var} to {expected} in {fn}"),
        ("TypeError: Cannot read properties of undefined (reading '{attr}')", "prepend('if (!{var}) return;')", "return early from {fn} without {var}"),
        ("TS7006: Parameter '{var}' implicitly has an 'any' type", "replaceWith('{var}', '{var}: unknown')", "type {var} in {fn}"),
    ],
}
_FIXED = [
    ("python", "ZeroDivisionError: division by zero", "src/stats.py", "mean_of", "prepend('if not items:\\n    return 0.0')"),
    ("python", "UnicodeDecodeError: 'utf-8' codec can't decode byte 0xff", "src/reader.py", "read_all", "replaceWith(\"open(path)\", \"open(path, errors='replace')\")"),
    ("python", "IndexError: list index out of range", "src/pages.py", "nth_page", "wrap('try:', 'except IndexError:\\n    return None')"),
    ("go", "fatal error: all goroutines are asleep - deadlock!", "pkg/pool.go", "Drain", "append('close(done)')"),
    ("typescript", "RangeError: Maximum call stack size exceeded", "src/tree.ts", "walkTree", "addParam('depth = 0')"),
]
_SNIPPETS = [
    ("python", "the file is never closed", "def read_conf(path):\n    f = open(path)\n    return f.read()", "select('.fn#read_conf').replaceWith('f = open(path)\\n    return f.read()', 'with open(path) as f:\\n        return f.read()')"),
    ("python", "the default list is shared by all calls", "def add(item, seen=[]):\n    seen.append(item)\n    return seen", "select('.fn#add').replaceWith('seen=[]', 'seen=None')"),
    ("python", "the bare except hides errors", "def go():\n    try:\n        run()\n    except:\n        pass", "select('.fn#go').find('.except').replaceWith('except:', 'except OSError:')"),
    ("javascript", "the promise is never awaited", "async function save(x) {\n  store.put(x);\n}", "select('.fn#save').find('.call#put').replaceWith('store.put(x)', 'await store.put(x)')"),
]
_TEMPLATES = {
    "query": ["find {what}", "get {what}", "show me {what}", "look up {what}"],
    "count": ["how many {what} are there", "count {what}"],
    "names": ["list the names of {what}", "what are {what} called"],
    "text": ["show the source of {what}", "print {what}"],
    "addParam": ["add the parameter {arg} to {what}", "let {what} take {arg}"],
    "rename": ["rename {what} to {arg}", "call {what} {arg} instead"],
    "remove": ["remove {what}", "delete {what}"],
    "callers": ["who calls {what}", "find the callers of {what}"],
    "isolate": ["take {what} out of the file"],
    "edit": ["{op} {arg} on {what}", "change {what} by {op} with {arg}"],
    "terminal": ["{op} of {what}", "give me the {op} of {what}"],
    "delegate": ["{op} {what}"],
}


def _styled(words: list[str], style: str) -> str:
    if style == "snake":
        return "_".join(words)
    head = words[0].capitalize() if style == "pascal" else words[0]
    return head + "".join(w.capitalize() for w in words[1:])


def _function(rng: random.Random, style: str = "snake") -> str:
    return _styled([rng.choice(_VERBS), rng.choice(_NOUNS), *([rng.choice(_NOUNS)] if rng.random() < 0.3 else [])], style)


def _file(rng: random.Random, ending: str = ".py") -> str:
    return f"{rng.choice(_FOLDERS)}/{rng.choice(_NOUNS)}{rng.choice(['', '_' + rng.choice(_NOUNS)])}{ending}"


def _selector(rng: random.Random, style: str = "snake") -> str:
    kind = rng.choice(_SELECTORS)
    roll = rng.random()
    if kind in _NAMED and roll < 0.35:
        return f"{kind}#{rng.choice(_NOUNS).capitalize() + rng.choice(_CLASS_ENDS) if kind == '.cls' else _function(rng, style)}"
    if kind in _NAMED and roll < 0.5:
        return f'{kind}[name^="{rng.choice(_VERBS)}_"]'
    if kind == ".fn" and roll < 0.8:
        return kind + rng.choice([":exported", ":private", ":async", ":has(.ret)", ":not(:has(.str))", f":calls({_function(rng, style)})", f":long({rng.randint(10, 80)})"])
    return kind


def _described(selector: str) -> str:
    """A selector in words."""
    m = re.match(r"(\.[\w-]+)(.*)", selector, re.S)
    what = _SUBJECTS.get(m[1], m[1]) if m else selector
    rest = m[2] if m else ""
    if rest.startswith("#"):
        return f"{what} {rest[1:]}" if not what.endswith("s") else f"the {what.removesuffix('es') if what == 'classes' else what[:-1]} {rest[1:]}"
    if found := re.match(r'\[name\^="([^"]*)"\]', rest):
        return f"{what} whose names begin with {found[1]}"
    words = {":exported": "public ", ":private": "private ", ":async": "async "}
    if rest in words:
        return words[rest] + what
    return f"{what} with {rest.strip(':')}" if rest else what


def _intent(steps: list[tuple[str, list[str]]], spec: Spec, rng: random.Random) -> str:
    """In words: the last step, or half the time, if there are several, all of them one after another."""
    what = _described(steps[0][1][0].strip("'\"")) if steps[0][0] == "select" else f"code in {steps[0][1][0]}"
    for op, args in steps[1:]:
        if op == "find" and args:
            what = f"{_described(args[0].strip(chr(39)))} in {what}"

    def said(op: str, args: list[str]) -> str:
        category = spec.operations[op].category
        texts = _TEMPLATES.get(op) or _TEMPLATES.get(category) or _TEMPLATES["query"]
        return rng.choice(texts).format(what=what, op=op, arg=", ".join(args) or "nothing")

    own = [s for s in steps[1:] if s[0] != "find"]
    if len(own) >= 2 and rng.random() < 0.5:
        return ", then ".join(said(*s) for s in own[:3])
    return said(*(own[-1] if own else ("find", [])))


def _call(name: str, spec: Spec, rng: random.Random) -> str:
    arguments = spec.operations[name].arguments
    return f"{name}({rng.choice(arguments) if arguments else ''})"


def next_step(now: str, left: int, spec: Spec, rng: random.Random) -> str | None:
    """A step that may follow; the last one tends to be an end, and planned steps are rare."""
    categories = {c: ops for c, ops in spec.composition.get(now, {}).items() if ops}
    if not categories:
        return None
    weights = LAST_WEIGHTS if left == 1 else WEIGHTS
    names = list(categories)
    category = rng.choices(names, [weights.get(c, 1) for c in names])[0]
    ops = categories[category]
    return rng.choices(ops, [BUILT if spec.operations[o].status == "built" else PLANNED for o in ops])[0]


def standard(spec: Spec, rng: random.Random, language: str = "python") -> dict:
    """A chain whose types fit, of a random length."""
    ending, style = _LANGUAGES[language]
    left = rng.choices(LENGTHS, LENGTH_WEIGHTS)[0] - 1
    if rng.random() < 0.5:
        calls, now = [f"select('{_selector(rng, style)}')"], "Selection"
    else:
        calls, now = [f"source('{_file(rng, ending) if rng.random() < 0.5 else rng.choice(_FOLDERS) + '/**/*' + ending}')", f"find('{_selector(rng, style)}')"], "Selection"
        left -= 1
    while left > 0 and now != "terminal":
        op = next_step(now, left, spec, rng)
        if op is None:
            break
        calls.append(_call(op, spec, rng))
        now = spec.operations[op].output
        left -= 1
    return {"chain": ".".join(calls)}


def parametric(spec: Spec, rng: random.Random) -> dict:
    """A fault filled with names, and the chain that puts it right."""
    language = rng.choice(["python", "python", "python", "go", "typescript"])
    ending, style = _LANGUAGES[language]
    message, fix, intent = rng.choice(_FAULTS[language])
    values = {
        "fn": _function(rng, style), "var": rng.choice(_VARIABLES), "attr": rng.choice(["name", "id", "strip", "decode", "length", "items"]), "path": f"/tmp/{rng.choice(_NOUNS)}.csv", "val": rng.choice(["abc", "N/A", "none", "1,5"]), "name": rng.choice(["logging", "typing", "json", "math"]),
        "service": rng.choice(["the database", "the API", "Redis", "S3"]), "actual": rng.choice(["string | undefined", "null", "any"]), "expected": rng.choice(["string", "number", "User", "boolean"]), "n": rng.choice([5, 10, 30, 60]),
    }
    file, line = _file(rng, ending), rng.randint(5, 150)
    say = lambda t: t.format(**values)
    return {"chain": f"source('{file}').find('.fn#{values['fn']}').{say(fix)}", "intent": rng.choice([say(intent), f"fix: {say(message)}", f"{say(intent)} in {file}"]), "context": f"{say(message)}\n  File \"{file}\", line {line}, in {values['fn']}", "language": language, "category": "error_fix"}


def error(spec: Spec, rng: random.Random) -> dict:
    language, message, file, fn, fix = rng.choice(_FIXED)
    line = rng.randint(3, 90)
    return {"chain": f"source('{file}').find('.fn#{fn}').at_line({line}).{fix}", "intent": f"fix: {message}", "context": f"{message}\n  File \"{file}\", line {line}, in {fn}", "language": language, "category": "error_fix"}


def context(spec: Spec, rng: random.Random) -> dict:
    language, problem, code, chain = rng.choice(_SNIPPETS)
    return {"chain": chain, "intent": problem, "context": code, "language": language, "category": "code_fix"}


def multilang(spec: Spec, rng: random.Random) -> dict:
    language = rng.choice(sorted(_LANGUAGES))
    return standard(spec, rng, language) | {"language": language}


def scenario(spec: Spec, rng: random.Random) -> dict:
    """What people often do, in several steps."""
    fn, other, cls, file, var = _function(rng), _function(rng), rng.choice(_NOUNS).capitalize() + rng.choice(_CLASS_ENDS), _file(rng), rng.choice(_VARIABLES)
    chain, intent = rng.choice(
        [
            (f"source('{file}').find('.fn#{fn}').rename('{other}')", f"rename {fn} to {other} in {file}"),
            (f"select('.fn#{fn}').callers().names()", f"which functions call {fn}"),
            (f"select('.fn#{fn}').addParam('{var}=None')", f"let {fn} take an optional {var}"),
            (f"select('.call#{fn}').addArg('{var}={var}')", f"pass {var} in every call of {fn}"),
            (f"select('.cls#{cls}').find('.fn:exported').names()", f"list the public methods of {cls}"),
            (f"source('{file}').find('.fn').filter(min_lines={rng.randint(20, 90)}).names()", f"which functions in {file} are long"),
            (f"select('.fn:has(.call#{fn})').filter(name__startswith='test_').count()", f"how many tests use {fn}"),
            (f"source('{file}').find('.fn#{fn}').wrap('try:', 'except Exception:\\n    log.exception(\"{fn}\")\\n    raise')", f"log exceptions of {fn} in {file}"),
            (f"select('.cls#{cls}').find('.fn#{fn}').prepend('self.check_{var}()')", f"check {var} first in {cls}.{fn}"),
            (f"source('{file}').find('.fn#{fn} .for').isolate().as_function('{other}')", f"take the loop of {fn} out as {other}"),
            (f"select('.fn#{fn}').find('.call#print').remove()", f"drop the prints from {fn}"),
        ]
    )
    return {"chain": chain, "intent": intent}


_MANNERS = {"parametric": parametric, "error": error, "context": context, "multilang": multilang, "scenario": scenario, "standard": standard}


def _shape(chain: str) -> tuple[str, list[tuple[str, list[str]]]]:
    try:
        steps = parse_calls(chain)
    except ValueError:
        return "unknown", []
    return ".".join(o for o, _ in steps), steps


def _category(steps: list[tuple[str, list[str]]], spec: Spec) -> str:
    seen = {spec.operations[o].category for o, _ in steps if o in spec.operations}
    return next((c for c in ("edit", "delegate", "terminal") if c in seen), "query")


def row(position: int, seed: int, spec: Spec) -> tuple:
    rng = random.Random(f"{seed}:{position}")
    if position < len(spec.examples):
        intent, chain = spec.examples[position]
        shape, steps = _shape(chain)
        return position, intent, chain, shape, _category(steps, spec), "seed", None, None
    roll = rng.random()
    found = _MANNERS[next(m for m, top in MIX if roll < top)](spec, rng)
    shape, steps = _shape(found["chain"])
    strategy, intent = "template", found.get("intent")
    if intent is None:
        mark = rng.random()
        strategy = "reverse" if mark < REVERSE else "paraphrase" if mark < REVERSE + PARAPHRASE else "template"
        intent = _intent(steps, spec, rng)
    return position, intent, found["chain"], shape, found.get("category") or _category(steps, spec), strategy, found.get("context"), found.get("language")


def generate(spark: SparkSession, n: int, seed: int, path: str = DEFAULT) -> DataFrame:
    """The specification's examples, and ``n`` made-up rows behind them."""
    spec = load(path)

    def run(batches):
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for batch in batches:
            rows = [row(p, seed, spec) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 0 else pa.string()) for k, c in enumerate(zip(*rows))], names=names)

    return spark.range(n + len(spec.examples)).mapInArrow(run, SCHEMA)
