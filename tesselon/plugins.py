"""Plugins: analyzers, signals, rerankers, summarizers, graph extensions and hooks."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame

from .errors import PluginError

HOOKS = ("after_index", "before_retrieve", "after_retrieve", "before_context")


@dataclass
class Signal:
    """A column over nodes, by name, with its weight in the fusion."""

    name: str
    compute: Callable[[str], Column]
    weight: float = 0.05


@dataclass
class Plugin:
    name: str
    analyzers: tuple = ()
    signals: tuple[Signal, ...] = ()
    rerank: Callable[[DataFrame], DataFrame] | None = None
    summarize: Callable[[str, str], str] | None = None
    extend_graph: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]] | None = None
    providers: tuple = ()
    hooks: dict[str, Callable] = field(default_factory=dict)


class Plugins:
    def __init__(self):
        self.all: list[Plugin] = []

    def use(self, plugin: Plugin) -> None:
        if not isinstance(plugin, Plugin) or not plugin.name:
            raise PluginError("a plugin is a Plugin with a name")
        if any(p.name == plugin.name for p in self.all):
            raise PluginError(f"plugin {plugin.name!r} is there already")
        if wrong := set(plugin.hooks) - set(HOOKS):
            raise PluginError(f"plugin {plugin.name!r}: unknown hooks {', '.join(sorted(wrong))}")
        self.all.append(plugin)

    def load(self, given, root: str = ".") -> None:
        """Plugins, factories, module names or files (relative to root) with `plugin`."""
        try:
            if isinstance(given, str):
                if given.endswith(".py"):
                    spec = importlib.util.spec_from_file_location(Path(given).stem, Path(root) / given)
                    module = importlib.util.module_from_spec(spec)
                    spec.loader.exec_module(module)
                else:
                    module = importlib.import_module(given)
                given = module.plugin
            made = given() if callable(given) and not isinstance(given, Plugin) else given
        except Exception as e:
            raise PluginError(f"{given!r}: {e}") from e
        self.use(made)

    def run(self, hook: str, value):
        """Each plugin's hook in order; a hook may return a new value."""
        for p in self.all:
            if hook in p.hooks:
                try:
                    got = p.hooks[hook](value)
                except Exception as e:
                    raise PluginError(f"plugin {p.name!r}, {hook}: {e}") from e
                value = value if got is None else got
        return value

    @property
    def signals(self) -> list[Signal]:
        return [s for p in self.all for s in p.signals]

    @property
    def analyzers(self) -> tuple:
        return tuple(a for p in self.all for a in p.analyzers)

    def summary(self, path: str, text: str) -> str:
        for p in self.all:
            if p.summarize:
                text = p.summarize(path, text)
        return text

    def reranked(self, ranked: DataFrame) -> DataFrame:
        for p in self.all:
            if p.rerank:
                ranked = p.rerank(ranked)
        return ranked

    def extended(self, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        for p in self.all:
            if p.extend_graph:
                nodes, edges = p.extend_graph(nodes, edges)
        return nodes, edges
