"""The fluent API: a source, selections of its nodes, and what they end in.

Everything but a terminal (``count``, ``names``, ``text``, ...) and the edits is lazy: it adds to
a DataFrame plan. A selection knows the trees it was taken from (``nodes``), its
rows (``df``) and the steps that led to it.
"""

from __future__ import annotations

import difflib
import json
import os
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import nav
from .functions import rewriting as rw
from .functions.predicates import BUILT_IN, Registry, SelectorError, keyword
from .macros import Macros
from .operators import graph, isolate, rewrite, search, view
from .plans.selector import parse, select
from .plugins import PluginError, PluginRegistry, resolve
from .schema import NODE, SECTION, TREE_KEY
from .sources import files, git, markdown
from .sources.cache import TreeCache
from .sources.languages import BUILT_IN as LANGUAGES
from .sources.languages import Languages

_ORDER = ["file_path", "node_id"]


@dataclass(frozen=True)
class Step:
    op: str
    args: tuple = ()
    kwargs: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Trees:
    """Where selections come from: nodes, the texts they were parsed from, and what names mean."""

    nodes: DataFrame
    sources: DataFrame | None = None
    registry: Registry = BUILT_IN
    plugins: PluginRegistry = field(default_factory=PluginRegistry)
    repo: str | None = None
    names: tuple[str, ...] = ()
    languages: Languages = LANGUAGES


class Selection:
    def __init__(self, trees: Trees, df: DataFrame, steps: tuple[Step, ...] = ()):
        self.trees, self.df, self.steps = trees, df, steps

    # --- plumbing

    def _next(self, df: DataFrame, op: str, *args, **kwargs) -> Selection:
        return Selection(self.trees, df, (*self.steps, Step(op, args, kwargs)))

    @property
    def nodes(self) -> DataFrame:
        return self.trees.nodes

    @property
    def relation(self) -> DataFrame:
        return self.df

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        plugins = self.trees.plugins
        method = plugins.method(name)
        if method is None:
            if by := plugins.provider(name):
                raise PluginError(f"{name}() needs the plugin {by}: Grove(..., plugins=({by!r},))")
            raise AttributeError(f"a selection has no {name!r}; a plugin may bring it")
        return lambda *args, **kwargs: method(self, *args, **kwargs)

    def as_view(self, name: str) -> str:
        """The whole trees behind this selection as a temporary view for SQL."""
        self.nodes.createOrReplaceTempView(name)
        return name

    # --- queries

    def find(self, selector: str) -> Selection:
        """Matches below the selected nodes. The selector sees whole trees."""
        return self._next(nav.descendants_of(select(self.nodes, selector, self.trees.registry), self.df), "find", selector)

    def filter(self, *pseudo: str, **fields) -> Selection:
        """Rows that fit all pseudo-classes, selectors and fields."""
        if not pseudo and not fields:
            return self
        df = self.df
        for p in pseudo:
            known = self.trees.registry.get(p) if p.startswith(":") and "(" not in p and p.count(":") == 1 else None
            if known is not None:
                df = df.where(nav.truth(known.column([])))
            else:
                parts = parse(p)
                alone = len(parts) == 1 and len(parts[0].parts) == 1 and all(self.trees.registry.get(n) for n, _ in parts[0].parts[0].pseudos)
                if alone:  # looks at one node only
                    df = select(df, p, self.trees.registry)
                else:
                    df = nav.semi(df, select(self.nodes, p, self.trees.registry), file_path="file_path", node_id="node_id")
        for name, value in fields.items():
            df = df.where(nav.truth(keyword(name, value)))
        return self._next(df, "filter", *pseudo, **fields)

    def filter_sql(self, condition: str) -> Selection:
        return self._next(self.df.where(F.expr(condition)), "filter_sql", condition)

    def not_(self, selector: str) -> Selection:
        """Rows that the selector, evaluated over the selection itself, doesn't match."""
        return self._next(nav.semi(self.df, select(self.df, selector, self.trees.registry), "left_anti", file_path="file_path", node_id="node_id"), "not_", selector)

    def unique(self) -> Selection:
        return self._next(files.sorted_apart(self.df, *TREE_KEY, parts=files.parts_of(self.df)).dropDuplicates(TREE_KEY), "unique")

    def at_line(self, n: int) -> Selection:
        return self._next(self.df.where((F.col("start_line") <= n) & (F.col("end_line") >= n)), "at_line", n)

    def at_lines(self, first: int, last: int) -> Selection:
        """Rows that share a line with the range."""
        return self._next(self.df.where((F.col("start_line") <= last) & (F.col("end_line") >= first)), "at_lines", first, last)

    def containing(self, text: str) -> Selection:
        found = view.texts(self.df, self._sources()).where(F.col("text").contains(text))
        return self._next(found.drop("text"), "containing", text)

    # --- navigation

    def parent(self) -> Selection:
        return self._next(nav.parents_of(self.nodes, self.df), "parent")

    def children(self) -> Selection:
        return self._next(nav.children_of(self.nodes, self.df), "children")

    def siblings(self) -> Selection:
        return self._next(nav.siblings_of(self.nodes, self.df), "siblings")

    def next(self) -> Selection:
        return self._next(nav.beside(self.nodes, self.df, 1), "next")

    def prev(self) -> Selection:
        return self._next(nav.beside(self.nodes, self.df, -1), "prev")

    def ancestor(self, selector: str, nearest: bool = False) -> Selection:
        """Matches above the selected nodes: all, or the innermost of each."""
        found = select(self.nodes, selector, self.trees.registry)
        return self._next((nav.nearest_ancestors_of if nearest else nav.ancestors_of)(found, self.df), "ancestor", selector, **({"nearest": True} if nearest else {}))

    ancestors, descendants = ancestor, find

    # --- call graph and scopes

    def callers(self) -> Selection:
        return self._next(graph.callers(self.nodes, self.df), "callers")

    def callees(self) -> Selection:
        return self._next(graph.callees(self.nodes, self.df), "callees")

    def references(self) -> Selection:
        return self._next(graph.references(self.nodes, self.df), "references")

    def scope(self) -> Selection:
        return self._next(graph.scopes(self.nodes, self.df), "scope")

    def defs(self, name: str | None = None) -> Selection:
        found = graph.definitions_in(self.nodes, self.df)
        return self._next(found if name is None else found.where(F.col("name") == name), "defs", *[name] * (name is not None))

    def refs(self, name: str | None = None) -> Selection:
        found = graph.references_in(self.nodes, self.df)
        return self._next(found if name is None else found.where(F.col("name") == name), "refs", *[name] * (name is not None))

    # --- paging, in the order of files and nodes

    #: What an offset was taken of, and its rows.
    _skipped: tuple[DataFrame, int] | None = None

    def limit(self, n: int) -> Selection:
        """After an offset, each task keeps the first rows of both only, and no task sorts all."""
        df, skipped = self._skipped or (self.df, 0)
        first = df.orderBy(*_ORDER).limit(skipped + n)
        return self._next(first.offset(skipped) if skipped else first, "limit", n)

    def offset(self, n: int) -> Selection:
        out = self._next(self.df.orderBy(*_ORDER).offset(n), "offset", n)
        out._skipped = (self.df, n)
        return out

    def page(self, n: int, size: int) -> Selection:
        return self.offset(n * size).limit(size)

    def first(self) -> Selection:
        return self.limit(1)

    def nth(self, n: int) -> Selection:
        return self.offset(n).limit(1)

    def last(self) -> Selection:
        return self._next(self.df.orderBy(*[F.desc(c) for c in _ORDER]).limit(1), "last")

    # --- terminals

    def count(self) -> int:
        return self.df.count()

    def names_df(self) -> DataFrame:
        return self.df.where("name IS NOT NULL AND name <> ''").select("name").distinct().orderBy("name")

    def names(self) -> list[str]:
        return [r.name for r in self.names_df().collect()]

    def files(self) -> list[str]:
        return [r.file_path for r in self.df.select("file_path").distinct().orderBy("file_path").collect()]

    def text_df(self) -> DataFrame:
        return view.texts(self.df, self._sources()).where("text <> ''").select("file_path", "node_id", "start_line", "text")

    def text(self) -> list[str]:
        return [r.text for r in self.text_df().orderBy("file_path", "start_line", "node_id").collect()]

    def attr(self, name: str) -> list:
        if name not in NODE.names:
            raise ValueError(f"{name!r} is no column of nodes")
        return [r[0] for r in self.df.select(name, *_ORDER).orderBy(*_ORDER).collect()]

    def complexity(self) -> list[int]:
        return self.attr("descendant_count")

    def materialize(self) -> list[dict]:
        return [r.asDict(True) for r in self.df.collect()]

    rows = materialize

    def read(self) -> str:
        """The texts of all nodes, one after another."""
        return "\n".join(self.text())

    def to_df(self):
        """As a pandas DataFrame, in order."""
        return self.df.orderBy(*_ORDER).toPandas()

    def __iter__(self):
        return iter(self.materialize())

    def __len__(self) -> int:
        return self.count()

    def __bool__(self) -> bool:
        return not self.df.isEmpty()

    def __repr__(self) -> str:
        said = ".".join(f"{s.op}({', '.join([*map(repr, s.args), *(f'{k}={v!r}' for k, v in s.kwargs.items())])})" for s in self.steps)
        return f"Selection({said}: {self.count()} nodes)"

    def listing(self) -> str:
        rows = self.df.select("file_path", "start_line", "node_id", F.coalesce(F.nullif("name", F.lit("")), "type").alias("what")).orderBy("file_path", "start_line", "node_id").collect()
        return "\n".join(f"{r.file_path}:{r.start_line} {r.what}" for r in rows)

    __str__ = listing

    # --- search, views, blocks, history

    def _sources(self) -> DataFrame:
        if self.trees.sources is None:
            raise ValueError("these trees have no source text")
        return self.trees.sources

    def search(self, query: str, limit: int = 10, kind: str | None = None) -> Selection:
        """The selected nodes (of a kind such as function or class) whose text has the words, best first, with ``score``."""
        found = search.content(view.texts(self.df, self._sources()), None)
        hits = search.search(found if kind is None else found.where(F.col("kind") == kind), query, limit)
        ranked = self.df.withColumn("id", F.concat_ws("#", "file_path", F.col("node_id").cast("string"))).join(hits, "id").drop("id")
        return self._next(ranked.orderBy(F.desc("score"), *_ORDER), "search", query, limit, **({"kind": kind} if kind else {}))

    def isolate(self) -> DataFrame:
        return isolate.isolate(self.nodes, self.df, self._sources())

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def file_commits(self) -> DataFrame:
        """(file_path, commit): what touched the selected nodes' files."""
        return git.file_commits(self.spark, self.trees.repo or ".", self.files())

    def history(self, spark: SparkSession | None = None) -> DataFrame:
        """Commits that touched the selected nodes' files, newest first."""
        return self.file_commits().drop("file_path").dropDuplicates(["hash"]).orderBy(F.desc(F.to_timestamp("author_date")), "hash")

    def authors(self, spark: SparkSession | None = None) -> list[str]:
        return [r.author_email for r in self.file_commits().select("author_email").distinct().orderBy("author_email").collect()]

    def blame(self) -> DataFrame:
        """(file_path, node_id, line, hash): the last commit of each line of the selected nodes."""
        repo, said = self.trees.repo or ".", None
        for path in self.files():
            part = git.blame(self.spark, repo, os.path.relpath(path, repo) if os.path.isabs(path) else path).withColumn("file_path", F.lit(path))
            said = part if said is None else said.unionByName(part)
        own = self.df.select("file_path", "node_id", F.explode(F.sequence("start_line", "end_line")).alias("line"))
        return own.join(said, ["file_path", "line"]).select("file_path", "node_id", "line", "hash") if said is not None else own.withColumn("hash", F.lit(None).cast("string")).limit(0)

    def _texts_at(self, revision: str) -> DataFrame:
        """(file_path, node_id, text): of each selected node, the first node of that name and type at a revision; null if there is none."""
        repo = self.trees.repo or "."
        read = [(p, git.text_at(repo, os.path.relpath(p, repo) if os.path.isabs(p) else p, revision)) for p in self.files()]
        then = self.spark.createDataFrame([r for r in read if r[1] is not None], "file_path string, text string")
        old = self.trees.languages.nodes(then).where(F.col("flags").bitwiseAND(1) == 0)
        first = old.groupBy("file_path", "name", "type").agg(F.min_by(F.struct("start_line", "end_line"), "node_id").alias("at")).select("file_path", "name", "type", "at.start_line", "at.end_line")
        found = view.texts(first, then).select("file_path", F.col("name").alias("_n"), F.col("type").alias("_t"), "text")
        own = self.df.select("file_path", "node_id", "name", "type")
        hit = (own["file_path"] == found["file_path"]) & own["name"].eqNullSafe(found["_n"]) & (own["type"] == found["_t"])
        return own.join(found, hit, "left").select(own["file_path"], "node_id", "name", "type", "text")

    def at(self, spark: SparkSession | str, revision: str | None = None) -> DataFrame:
        """(file_path, name, type, text) of the selected nodes as they were at a revision; gone ones are left out."""
        return self._texts_at(revision if revision is not None else spark).where("text IS NOT NULL").select("file_path", "name", "type", "text").distinct()

    def diff(self, revision: str, now: str = "HEAD") -> DataFrame:
        """(file_path, node_id, name, diff) for each selected node: a unified diff of its text from a revision to ``now``; empty where it is missing in either."""
        repo = self.trees.repo or "."
        a = self._texts_at(revision).withColumnRenamed("text", "old")
        both = a.join(self._texts_at(now).select("file_path", "node_id", F.col("text").alias("new")), ["file_path", "node_id"])

        @F.pandas_udf("string")
        def unified(path: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
            out = []
            for p, x, y in zip(path, old, new):
                place = os.path.relpath(p, repo) if os.path.isabs(p) else p
                lines = difflib.unified_diff((x + "\n").splitlines(True), (y + "\n").splitlines(True), f"{place}@{revision}", f"{place}@{now}") if x is not None and y is not None else ()
                out.append("".join(lines))
            return pd.Series(out, dtype=object)

        return both.select("file_path", "node_id", "name", unified("file_path", "old", "new").alias("diff"))

    # --- edits: planned in workers, written by the driver

    def rewrite(self, edit: rw.Edit) -> DataFrame:
        """The plan of an edit: old and new text of each file."""
        return rewrite.plan(self.df, self._sources(), lambda node: edit, self.trees.languages)

    _EDITS = {
        "addParam": rw.add_item, "removeParam": rw.remove_item, "addArg": rw.add_item, "removeArg": rw.remove_item, "rename": rw.rename, "prepend": rw.prepend, "append": rw.append, "wrap": rw.wrap, "unwrap": rw.unwrap, "remove": rw.remove, "clearBody": rw.clear_body, "patch": rw.patch,
        "replaceWith": lambda code, new=None: rw.replace(code) if new is None else rw.substitute(code, new),
    }

    def planned(self, op: str, *args) -> DataFrame:
        """What an edit, by its name, would do: old and new text of each file. Nothing is written."""
        if op in ("insertBefore", "insertAfter"):
            anchor, code = args
            chosen, after = rewrite.anchored(self.df, select(self.nodes, anchor, self.trees.registry)), op == "insertAfter"
            return rewrite.plan(chosen, self._sources(), lambda n: rw.beside(code, int(n["anchor_start"]), int(n["anchor_end"]), after), self.trees.languages)
        return self.rewrite(self._EDITS[op](*args))

    def _edit(self, edit: rw.Edit, op: str, *args) -> Selection:
        """Write an edit. The selection that follows reads the files anew."""
        rewrite.commit(self.rewrite(edit))
        return self._next(self.df, op, *args)

    def replaceWith(self, code: str, new: str | None = None) -> Selection:
        return self._edit(rw.replace(code) if new is None else rw.substitute(code, new), "replaceWith", code, *[new] * (new is not None))

    def addParam(self, spec: str) -> Selection:
        return self._edit(rw.add_item(spec), "addParam", spec)

    def removeParam(self, name: str) -> Selection:
        return self._edit(rw.remove_item(name), "removeParam", name)

    def addArg(self, spec: str) -> Selection:
        return self._edit(rw.add_item(spec), "addArg", spec)

    def removeArg(self, name: str) -> Selection:
        return self._edit(rw.remove_item(name), "removeArg", name)

    def rename(self, new: str) -> Selection:
        return self._edit(rw.rename(new), "rename", new)

    def prepend(self, code: str) -> Selection:
        return self._edit(rw.prepend(code), "prepend", code)

    def append(self, code: str) -> Selection:
        return self._edit(rw.append(code), "append", code)

    def wrap(self, before: str, after: str = "") -> Selection:
        return self._edit(rw.wrap(before, after), "wrap", before, after)

    def unwrap(self) -> Selection:
        return self._edit(rw.unwrap(), "unwrap")

    def remove(self) -> Selection:
        return self._edit(rw.remove(), "remove")

    def clearBody(self) -> Selection:
        return self._edit(rw.clear_body(), "clearBody")

    def patch(self, content: str) -> Selection:
        return self._edit(rw.patch(content), "patch", content)

    def _beside(self, anchor: str, code: str, op: str) -> Selection:
        rewrite.commit(self.planned(op, anchor, code))
        return self._next(self.df, op, anchor, code)

    def insertBefore(self, anchor: str, code: str) -> Selection:
        return self._beside(anchor, code, "insertBefore")

    def insertAfter(self, anchor: str, code: str) -> Selection:
        return self._beside(anchor, code, "insertAfter")


class DocSelection:
    """Sections of markdown."""

    def __init__(self, df: DataFrame, steps: tuple[Step, ...] = ()):
        self.df, self.steps = df, steps

    def _next(self, df: DataFrame, op: str, *args, **kwargs) -> DocSelection:
        return DocSelection(df, (*self.steps, Step(op, args, kwargs)))

    def filter(self, level: int | None = None, min_level: int | None = None, max_level: int | None = None, search: str | None = None, file_path: str | None = None) -> DocSelection:
        given = {"level": level, "min_level": min_level, "max_level": max_level, "search": search, "file_path": file_path}
        tests: dict[str, Column] = {
            "level": F.col("level") == level,
            "min_level": F.col("level") >= min_level,
            "max_level": F.col("level") <= max_level,
            "search": F.col("title").ilike(f"%{search}%") | F.col("content").ilike(f"%{search}%"),
            "file_path": F.col("file_path").ilike(f"%{file_path}%"),
        }
        df = self.df
        for name, value in given.items():
            if value is not None:
                df = df.where(tests[name])
        return self._next(df, "filter", **{k: v for k, v in given.items() if v is not None})

    def outline(self, max_level: int = 3) -> DocSelection:
        return self._next(self.df.where(F.col("level") <= max_level), "outline", max_level)

    def search(self, query: str, limit: int = 10) -> DocSelection:
        """The best of these sections (restricted first, then limited), with ``score``."""
        hits = search.search(self.df.select(F.col("section_id").alias("id"), F.col("content").alias("text")), query, limit)
        return self._next(self.df.join(hits.withColumnRenamed("id", "section_id"), "section_id").orderBy(F.desc("score"), "section_id"), "search", query, limit)

    def titles(self) -> list[str]:
        return [r.title for r in self.df.orderBy("file_path", "start_line").select("title").collect()]

    def sections(self) -> list[dict]:
        return [r.asDict() for r in self.df.orderBy("file_path", "start_line").collect()]

    def content(self) -> list[str]:
        return [r.content for r in self.df.orderBy("file_path", "start_line").select("content").collect()]

    def count(self) -> int:
        return self.df.count()

    def files(self) -> list[str]:
        return [r.file_path for r in self.df.select("file_path").distinct().orderBy("file_path").collect()]

    def show(self, n: int = 10) -> None:
        self.df.select("file_path", "level", "title").show(n, False)


class Source:
    """A pattern of files; nothing is read before ``find``."""

    def __init__(self, grove: Grove, pattern: str):
        self.grove, self.pattern = grove, pattern

    def find(self, selector: str) -> Selection:
        return replace_source(self.grove, self.pattern).find(selector)


class Grove:
    """The entry point: trees of files, a table or given nodes.

    ``plugins`` are classes, instances or names. ``cache`` is a ``TreeCache`` or a folder that all executors share.
    """

    def __init__(self, spark: SparkSession, code: str | list[str] | None = None, repo: str | None = None, nodes: DataFrame | None = None, sources: DataFrame | None = None, plugins: tuple = (), cache=None, docs: str | None = None, languages: Languages = LANGUAGES):
        self.spark, self.code, self.repo, self.docs_pattern, self.languages = spark, code, repo, docs, languages
        self.cache = TreeCache(spark, cache, languages) if isinstance(cache, str) else cache
        self.registry, self.plugins = BUILT_IN.copy(), PluginRegistry(lambda name: hasattr(Selection, name))
        for p in plugins:
            self.plugins.register(resolve([p])[0] if isinstance(p, str) else p, self.registry)
        self.fn = Macros(spark)
        if nodes is None and code is not None:
            nodes, sources = self._load([code] if isinstance(code, str) else code)
        self.trees = Trees(nodes, sources, self.registry, self.plugins, repo, tuple([code] if isinstance(code, str) else code or ()), languages)
        for p in self.plugins.plugins:
            if hasattr(p, "setup"):
                p.setup(self)

    def _load(self, patterns: list[str]) -> tuple[DataFrame, DataFrame | None]:
        """A name with ``*`` or ``/`` is files; else a table of nodes if there is one; else a file.

        A pattern without an ending takes the files that a parser reads; a file that is named, or an
        ending that is, must have one.
        """
        if len(patterns) == 1 and not set("*/") & set(patterns[0]) and self.spark.catalog.tableExists(patterns[0]):
            return self.spark.table(patterns[0]), None
        paths = set()
        for pattern in patterns:
            found = files.listed(pattern, self.repo)
            named = "." in os.path.basename(pattern) and not os.path.basename(pattern).endswith(".*")
            for p in found:
                if named:
                    self.languages.of(p)  # or an error that says so
                if self.languages.reads(p):
                    paths.add(p)
        texts = files.read(self.spark, sorted(paths))
        if self.cache is not None and len(patterns) == 1:
            return self.cache.get(patterns[0], self.repo), texts
        return self.languages.nodes(texts), texts

    def over(self, sources: DataFrame) -> Grove:
        """The same over other texts (file_path, text)."""
        new = object.__new__(Grove)
        new.__dict__.update(self.__dict__)
        new.trees = replace(self.trees, nodes=self.languages.nodes(sources), sources=sources)
        return new

    def find(self, selector: str) -> Selection:
        if self.trees.nodes is None:
            raise SelectorError("there is no source to search")
        return Selection(self.trees, select(self.trees.nodes, selector, self.registry), (Step("find", (selector,)),))

    def source(self, pattern: str) -> Source:
        return Source(self, pattern)

    def all(self) -> Selection:
        return Selection(self.trees, self.trees.nodes)

    def docs(self, pattern: str | None = None) -> DocSelection:
        pattern = pattern or self.docs_pattern or "**/*.md"
        return DocSelection(markdown.sections(files.read(self.spark, files.listed(pattern, self.repo))), (Step("docs", (pattern,)),))

    def view_df(self, query: str) -> DataFrame:
        return view.blocks(self.trees.nodes, self.trees.sources, view.parse_rules(query), lambda nodes, s: select(nodes, s, self.registry))

    def view(self, query: str) -> view.View:
        return view.collected(self.view_df(query), query)

    def _definitions(self) -> Selection:
        return Selection(self.trees, self.trees.nodes.where(F.col("semantic_name").isin("DEFINITION_FUNCTION", "DEFINITION_CLASS")))

    def search(self, query: str, limit: int = 10, kind: str | None = None) -> Selection:
        return self._definitions().search(query, limit, kind)

    def build_index(self, folder: str, name: str = "content", docs: str | None = None) -> search.Collection:
        """An index of the code's definitions and of the sections of markdown, for searches that read no source."""
        code = view.texts(self._definitions().df, self.trees.sources)
        rows = search.content(code, self.docs(docs).df)
        held = rows.select("id", "text", F.create_map(*[x for c in ("file_path", "ordinal", "extractor", "kind") for x in (F.lit(c), F.col(c).cast("string"))]).alias("metadata"))
        out = search.Collection(self.spark, folder, name)
        out.create(held)
        return out

    def search_index(self, index: search.Collection, query: str, limit: int = 10, extractor: str | None = None, kind: str | None = None) -> DataFrame:
        """(file_path, ordinal, extractor, kind, score) of an index, best first."""
        where = F.lit(True)
        for name, value in (("extractor", extractor), ("kind", kind)):
            if value is not None:
                where = where & (F.col("metadata")[name] == value)
        m = F.col("metadata")
        return index.search(query, limit, where).select(m["file_path"].alias("file_path"), m["ordinal"].cast("long").alias("ordinal"), m["extractor"].alias("extractor"), m["kind"].alias("kind"), "score")

    # --- forms of the entry object itself

    def to_dict(self) -> dict:
        out = {"code": self.code, "docs": self.docs_pattern, "plugins": self.plugins.titles(), "repo": self.repo}
        return {k: v for k, v in out.items() if v}

    @classmethod
    def from_dict(cls, spark: SparkSession, said: dict) -> Grove:
        return cls(spark, said.get("code"), repo=said.get("repo"), docs=said.get("docs"), plugins=tuple(said.get("plugins", ())))

    def to_json(self, **how) -> str:
        return json.dumps(self.to_dict(), **how)

    @classmethod
    def from_json(cls, spark: SparkSession, text: str) -> Grove:
        return cls.from_dict(spark, json.loads(text))

    def to_argv(self) -> list[str]:
        code = [self.code] if isinstance(self.code, str) else list(self.code or ())
        flags = [("--plugin", p) for p in self.plugins.titles()] + [(f, v) for f, v in (("--repo", self.repo), ("--docs", self.docs_pattern)) if v]
        return [w for pair in flags for w in pair] + code

    @classmethod
    def from_argv(cls, spark: SparkSession, words: list[str]) -> Grove:
        """Flags and one source; further words are left alone."""
        said: dict = {"plugins": []}
        left = list(words)
        while left:
            word = left.pop(0)
            flag, eq, value = word.partition("=")
            if flag in ("--plugin", "-p", "--repo", "-r", "--docs"):
                value = value if eq else left.pop(0) if left else ""
                name = {"-p": "plugin", "-r": "repo"}.get(flag, flag.lstrip("-"))
                if name == "plugin":
                    said["plugins"].append(value)
                else:
                    said[name] = value
            elif not word.startswith("-") and "code" not in said:
                said["code"] = word
        return cls.from_dict(spark, said)


def replace_source(grove: Grove, pattern: str) -> Grove:
    new = object.__new__(Grove)
    new.__dict__.update(grove.__dict__)
    nodes, sources = grove._load([pattern])
    new.trees = replace(grove.trees, nodes=nodes, sources=sources, names=(pattern,))
    return new


def sections_of(df: DataFrame) -> DocSelection:
    """A selection over a table of sections or of (file_path, text)."""
    return DocSelection(df if set(SECTION.names) <= set(df.columns) else markdown.sections(df))
