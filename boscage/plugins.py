"""Plugins: more methods for selections, more pseudo-classes, and changes to what methods return."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from typing import Any

from .functions.predicates import Registry


class PluginError(ValueError):
    """A plugin that can't be found or clashes with another."""


class Plugin:
    """Base of plugins.

    ``methods``: public name to the plugin's own method, by name or as a callable; it is called with the selection
    and the arguments. ``pseudo_classes``: name to a builder of a Column, or (builder, type of each argument).
    ``upgrades``: name of a method of any plugin to an own method that is called with its result and the selection.
    ``setup`` is called once with the entry object.
    """

    name: str = ""
    methods: dict[str, str | Callable] = {}
    pseudo_classes: dict[str, Any] = {}
    upgrades: dict[str, str | Callable] = {}

    def setup(self, grove) -> None:
        """Nothing to do by default."""

    @property
    def title(self) -> str:
        return self.name or type(self).__name__


#: Where methods that are no part of the core come from, for messages and for short names of plugins.
SHIPPED = {"Changes": "boscage.plugins:Changes"}
_PROVIDED = {"churn": "Changes", "last_changed": "Changes"}


class PluginRegistry:
    """The plugins of one entry object."""

    def __init__(self, taken: Callable[[str], bool] = lambda name: False):
        self.plugins: list[Plugin] = []
        self._methods: dict[str, tuple[Plugin, Callable]] = {}
        self._upgrades: dict[str, list[Callable]] = {}
        self._taken = taken

    @staticmethod
    def _function(plugin: Plugin, how: str | Callable) -> Callable:
        return getattr(plugin, how) if isinstance(how, str) else how

    def register(self, plugin: Plugin | type[Plugin], predicates: Registry) -> None:
        plugin = plugin() if isinstance(plugin, type) else plugin
        title = getattr(plugin, "title", None) or type(plugin).__name__
        for name, how in getattr(plugin, "methods", {}).items():
            if name in self._methods:
                raise PluginError(f"{name!r} of plugin {title} is already brought by plugin {self.provider(name)}")
            if self._taken(name):
                raise PluginError(f"{name!r} of plugin {title} is a method of every selection")
            self._methods[name] = plugin, self._function(plugin, how)
        for name, how in getattr(plugin, "upgrades", {}).items():
            self._upgrades.setdefault(name, []).append(self._function(plugin, how))
        for name, build in getattr(plugin, "pseudo_classes", {}).items():
            build, *takes = build if isinstance(build, tuple) else (build,)
            predicates.register(name, build, *takes)
        self.plugins.append(plugin)

    def provider(self, name: str) -> str | None:
        """The plugin that brings a method, be it here or not."""
        if name in self._methods:
            plugin = self._methods[name][0]
            return getattr(plugin, "title", None) or type(plugin).__name__
        return _PROVIDED.get(name)

    def method(self, name: str) -> Callable | None:
        """The method with all upgrades, to be called with the selection first."""
        if name not in self._methods:
            return None
        core, upgrades = self._methods[name][1], self._upgrades.get(name, ())

        def call(selection, *args, **kwargs):
            found = core(selection, *args, **kwargs)
            for u in upgrades:
                found = u(found, selection)
            return found

        return call

    def names(self) -> list[str]:
        return sorted(self._methods)

    def titles(self) -> list[str]:
        """How the plugins are named in serialized forms: short names, else ``module:Class``."""
        out = []
        for p in self.plugins:
            place = f"{type(p).__module__}:{type(p).__qualname__}"
            out.append(next((short for short, at in SHIPPED.items() if at == place), place))
        return out


def resolve(names: list[str] | tuple[str, ...]) -> list[type[Plugin]]:
    """Plugins by short name or ``module:Class``."""
    out = []
    for name in names:
        place = SHIPPED.get(name, name)
        if ":" not in place:
            raise PluginError(f"unknown plugin {name!r}; known are {', '.join(sorted(SHIPPED))}, others are named module:Class")
        module, _, cls = place.rpartition(":")
        try:
            out.append(getattr(importlib.import_module(module), cls))
        except (ImportError, AttributeError) as e:
            raise PluginError(f"plugin {name!r} can't be imported: {e}") from None
    return out


class Changes(Plugin):
    """How often and when the files of selected nodes changed, from git."""

    name = "Changes"
    methods = {"churn": "churn", "last_changed": "last_changed"}

    def churn(self, selection) -> dict[str, int]:
        """Number of commits for each file."""
        return {r.file_path: r.n for r in selection.file_commits().groupBy("file_path").count().withColumnRenamed("count", "n").collect()}

    def last_changed(self, selection) -> dict[str, str]:
        """Date of the last commit for each file."""
        return {r.file_path: r.at for r in selection.file_commits().groupBy("file_path").agg({"author_date": "max"}).withColumnRenamed("max(author_date)", "at").collect()}
