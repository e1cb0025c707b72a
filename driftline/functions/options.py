"""Reading settings with their types."""

from __future__ import annotations

from typing import Any


def option(settings: dict, name: str, kind: type, default: Any = None) -> Any:
    """The setting, or the default where it is absent.  Numbers with a zero
    fraction count as whole ones, a lone text as a list of one; any other type
    is an error that names the setting."""
    if name not in settings:
        return default
    v = settings[name]
    if kind is int and isinstance(v, float) and v.is_integer():
        return int(v)
    if kind is float and isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    if kind is list and isinstance(v, str):
        return [v]
    if not isinstance(v, kind) or (kind is int and isinstance(v, bool)):
        raise ValueError(f"{name} is invalid: {v!r} is no {kind.__name__}")
    return v
