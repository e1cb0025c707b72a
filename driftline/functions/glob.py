"""Globs with ``*`` only: case-sensitive, whole text; an empty pattern matches only empty text."""

from __future__ import annotations

import re

from pyspark.sql import Column


def glob_regex(pattern: str) -> str:
    return "(?s)^" + ".*".join(re.escape(p) for p in pattern.split("*")) + r"\z"


def glob(c: Column, pattern: str) -> Column:
    """Null text matches nothing (null)."""
    return c.rlike(glob_regex(pattern))


def glob_matches(text: str, pattern: str) -> bool:
    """The same on the driver, for names of catalogues."""
    return re.match(glob_regex(pattern).replace(r"\z", r"\Z"), text) is not None
