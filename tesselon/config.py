"""Configuration: defaults, legal ranges, discovery and merging."""

from __future__ import annotations

import importlib.util
import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace
from pathlib import Path
from typing import Any

from .errors import ConfigError
from .operators.expand import KIND_WEIGHTS
from .operators.rank import WEIGHTS

# What is scanned and what never is.
EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
IGNORED = (
    ".git/", ".tesselon/", "node_modules/", "dist/", "build/", "out/", "coverage/", ".next/", ".nuxt/", ".turbo/", ".cache/",
    ".output/", "vendor/", "tmp/", "*.min.js", "*.bundle.js", "*.d.ts", "*.d.mts", "*.d.cts", "*.map",
)
MAX_FILE_BYTES = 1_572_864
FILE_NAMES = ("tesselon.config.py", "tesselon.config.json", ".tesselonrc.json", ".tesselonrc")
STRATEGIES = ("hybrid", "lexical", "semantic", "graph")
RANKINGS = ("hybrid", "weighted", "rrf")
FORMATS = ("markdown", "json", "xml")


@dataclass(frozen=True)
class Expansion:
    traversal_budget: int = 300
    min_score: float = 0.05
    decay: float = 0.6
    hub_degree_limit: int = 64
    edge_weights: dict = field(default_factory=lambda: dict(KIND_WEIGHTS))


@dataclass(frozen=True)
class Retrieval:
    limit: int = 20
    candidate_limit: int = 100
    snippet_length: int = 240


@dataclass(frozen=True)
class Context:
    max_tokens: int = 12_000
    max_file_tokens: int = 2000
    max_symbol_tokens: int = 800
    format: str = "markdown"
    include_architecture: bool = True
    include_dependencies: bool = True
    include_recommendations: bool = True


@dataclass(frozen=True)
class Git:
    enabled: bool = True
    window_days: int = 180
    max_commits: int = 2000


@dataclass(frozen=True)
class Telemetry:
    enabled: bool = False
    file: bool = False


@dataclass(frozen=True)
class Config:
    root: str = "."
    extensions: tuple = EXTENSIONS
    exclude: tuple = ()
    max_file_size_bytes: int = MAX_FILE_BYTES
    graph_depth: int = 2
    max_nodes: int = 50
    strategy: str = "hybrid"
    ranking: str = "hybrid"
    weights: dict = field(default_factory=lambda: dict(WEIGHTS))
    expansion: Expansion = field(default_factory=Expansion)
    retrieval: Retrieval = field(default_factory=Retrieval)
    context: Context = field(default_factory=Context)
    git: Git = field(default_factory=Git)
    telemetry: Telemetry = field(default_factory=Telemetry)
    store: str | None = None
    provider: str = "auto"
    embedding_provider: str = "auto"
    models: dict = field(default_factory=dict)
    plugins: tuple = ()

    @property
    def store_path(self) -> str:
        return self.store or str(Path(self.root) / ".tesselon")


# Legal ranges (low, high; None is open).
RANGES = {
    "max_file_size_bytes": (1024, None), "graph_depth": (0, 6), "max_nodes": (1, 1000), "expansion.traversal_budget": (1, 100_000),
    "expansion.min_score": (0, 1), "expansion.hub_degree_limit": (1, None), "retrieval.limit": (1, 500), "retrieval.candidate_limit": (1, 5000),
    "retrieval.snippet_length": (0, 4000), "context.max_tokens": (256, None), "context.max_file_tokens": (64, None), "context.max_symbol_tokens": (32, None),
    "git.window_days": (1, 3650), "git.max_commits": (1, 100_000),
}


def validated(c: Config) -> Config:
    wrong = []
    for path, (low, high) in RANGES.items():
        value: Any = c
        for part in path.split("."):
            value = getattr(value, part)
        if isinstance(value, bool) or not isinstance(value, (int, float)) or value < low or (high is not None and value > high):
            wrong.append(f"{path}: {value!r} is not in {low} .. {'any' if high is None else high}")
    if not 0 < c.expansion.decay <= 1:
        wrong.append(f"expansion.decay: {c.expansion.decay!r} is not over 0 and up to 1")
    for path, value, legal in (("strategy", c.strategy, STRATEGIES), ("ranking", c.ranking, RANKINGS), ("context.format", c.context.format, FORMATS)):
        if value not in legal:
            wrong.append(f"{path}: {value!r} is none of {', '.join(legal)}")
    wrong += [f"extensions: {e!r} does not start with a dot" for e in c.extensions if not str(e).startswith(".")]
    wrong += [f"weights.{k}: {v!r} is not in 0 .. 100" for k, v in c.weights.items() if not 0 <= v <= 100]
    for k, v in c.expansion.edge_weights.items():
        if k not in KIND_WEIGHTS:
            wrong.append(f"expansion.edge_weights: {k!r} is not a kind of edge")
        elif not 0 <= v <= 1:
            wrong.append(f"expansion.edge_weights.{k}: {v!r} is not in 0 .. 1")
    if wrong:
        raise ConfigError("; ".join(wrong))
    return c


def merged(base: Config, given: dict) -> Config:
    """Field by field; excludes are joined, plugins appended, weights updated."""
    known = {f.name for f in fields(base)}
    if unknown := set(given) - known:
        raise ConfigError(f"unknown settings: {', '.join(sorted(unknown))}")
    changes: dict[str, Any] = {}
    for name, value in given.items():
        old = getattr(base, name)
        if is_dataclass(old):
            own = {f.name for f in fields(old)}
            if not isinstance(value, dict) or set(value) - own:
                raise ConfigError(f"{name}: expected some of {', '.join(sorted(own))}")
            value = {**value, "edge_weights": {**old.edge_weights, **value["edge_weights"]}} if "edge_weights" in value else value
            changes[name] = replace(old, **value)
        elif name == "exclude":
            changes[name] = tuple(dict.fromkeys([*old, *value]))
        elif name == "plugins":
            changes[name] = (*old, *value)
        elif name in ("weights", "models"):
            changes[name] = {**old, **value}
        else:
            changes[name] = tuple(value) if isinstance(old, tuple) else value
    return replace(base, **changes)


def discover(start: str) -> Path | None:
    """The nearest configuration file in a folder or above it."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        for name in FILE_NAMES:
            if (folder / name).is_file():
                return folder / name
    return None


def read(path: Path) -> dict:
    try:
        if path.suffix == ".py":
            spec = importlib.util.spec_from_file_location("tesselon_user_config", path)
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
            value = module.config
            return dict(value() if callable(value) else value)
        return dict(json.loads(path.read_text()))
    except ConfigError:
        raise
    except Exception as e:
        raise ConfigError(f"{path}: {e}") from e


def load(root: str = ".", overrides: dict | None = None, file: str | None = None) -> Config:
    found = Path(file) if file else discover(root)
    c = Config(root=root)
    if found:
        c = merged(c, read(found))
    return validated(merged(c, overrides or {}))


def as_dict(c: Config) -> dict:
    return asdict(c)
