"""Settings: defaults, deep merge of a JSON file over them, next-run overrides."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, field, fields, is_dataclass, replace
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Graph:
    max_depth: int = 2


@dataclass(frozen=True)
class Relevance:
    threshold: float = 0.45
    semantic_weight: float = 0.4
    graph_weight: float = 0.6
    top_k: int = 50


@dataclass(frozen=True)
class Budget:
    max_tokens: int = 2000
    escalate: bool = True


@dataclass(frozen=True)
class Config:
    graph: Graph = field(default_factory=Graph)
    relevance: Relevance = field(default_factory=Relevance)
    budget: Budget = field(default_factory=Budget)
    ignore: tuple[str, ...] = ()


def merge(base: Any, over: dict) -> Any:
    """over on top of base: objects are merged, all else (arrays too) is replaced; unknown keys are left out."""
    known = {f.name for f in fields(base)}
    new = {}
    for k, v in over.items():
        if k in known:
            old = getattr(base, k)
            new[k] = merge(old, v) if is_dataclass(old) and isinstance(v, dict) else tuple(v) if isinstance(v, list) else v
    return replace(base, **new)


def load(path: str | Path) -> Config:
    """The settings of a file; the defaults if it is missing, and with a warning if it is not JSON."""
    try:
        return merge(Config(), json.loads(Path(path).read_text()))
    except FileNotFoundError:
        return Config()
    except ValueError as e:
        warnings.warn(f"settings not read: {e}", stacklevel=2)
        return Config()


def _plain(x: Any) -> Any:
    return {f.name: _plain(getattr(x, f.name)) for f in fields(x)} if is_dataclass(x) else list(x) if isinstance(x, tuple) else x


def save(config: Config, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(_plain(config), indent=2))


def load_overrides(path: str | Path) -> dict[str, list[str]]:
    """Files to take in or leave out on the next run; empty if the file is missing or broken."""
    try:
        x = json.loads(Path(path).read_text())
        return {"include": [str(p) for p in x.get("include", [])], "exclude": [str(p) for p in x.get("exclude", [])]}
    except (OSError, ValueError, AttributeError):
        return {"include": [], "exclude": []}


def add_override(path: str | Path, kind: str, files: list[str]) -> dict[str, list[str]]:
    """Add files to a list; they leave the other one."""
    x = load_overrides(path)
    other = "exclude" if kind == "include" else "include"
    x[kind] = list(dict.fromkeys([*x[kind], *files]))
    x[other] = [p for p in x[other] if p not in files]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(x, indent=2))
    return x


def clear_overrides(path: str | Path) -> None:
    Path(path).unlink(missing_ok=True)
