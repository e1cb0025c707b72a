"""Named plugins of a pipeline by kind; user code adds its own."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

# Kinds of plugins.
KINDS = ("input", "positionRepo", "output", "filters", "matcher", "scheduler", "sqlExecutionEngine")

_PLUGINS: dict[str, dict[str, Callable[..., Any]]] = {k: {} for k in KINDS}


def register(kind: str, name: str, replace: bool = False):
    """Adds a callable under a name; a name is given once unless ``replace``."""
    if kind not in _PLUGINS:
        raise ValueError(f"unknown plugin kind {kind!r}")

    def add(fn):
        if name in _PLUGINS[kind] and not replace:
            raise ValueError(f"plugin {name!r} of kind {kind!r} exists already")
        _PLUGINS[kind][name] = fn
        return fn

    return add


def plugin(kind: str, name: str) -> Callable[..., Any]:
    try:
        return _PLUGINS[kind][name]
    except KeyError:
        raise ValueError(f"no plugin {name!r} of kind {kind!r}") from None


def names(kind: str) -> list[str]:
    return sorted(_PLUGINS[kind])
