"""Matchers: configuration to one Column, so that Catalyst can push it down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline import registry
from driftline.functions.glob import glob

OPS = ("insert", "update", "delete")


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _list(v) -> list[str]:
    return [v] if isinstance(v, str) else list(v)


def match_schema(v: str, c: str = "db") -> Column:
    return glob(F.col(c), v)


def match_table(v, c: str = "tbl") -> Column:
    return _any([glob(F.col(c), p) for p in _list(v)])


def match_table_regex(v, c: str = "tbl") -> Column:
    """Unanchored regular expression, or any of several."""
    return _any([F.col(c).rlike(p) for p in _list(v)])


def match_dml_op(v, c: str = "op") -> Column:
    ops = [o.lower() for o in _list(v)]
    bad = [o for o in ops if o not in OPS]
    if bad:
        raise ValueError(f"unknown dml operations {bad}")
    return F.coalesce(F.col(c).isin(ops), F.lit(False))


def match_ddl_regex(v, c: str = "ddl") -> Column:
    """False for anything but schema changes."""
    return F.coalesce((F.col("msg_type") == "ddl") & _any([F.col(c).rlike(p) for p in _list(v)]), F.lit(False))


MATCHERS = {
    "match-schema": match_schema,
    "match-table": match_table,
    "match-table-regex": match_table_regex,
    "match-dml-op": match_dml_op,
    "match-ddl-regex": match_ddl_regex,
}


def matcher(config: dict) -> Column:
    """AND of all keys that begin with ``match``; none matches everything.
    Further matchers are plugins: callables of the value that give a condition."""
    found = []
    for k, v in config.items():
        if k.startswith("match"):
            if k not in MATCHERS and k not in registry.names("matcher"):
                raise ValueError(f"unknown matcher {k!r}")
            found.append((MATCHERS.get(k) or registry.plugin("matcher", k))(v))
    return reduce(lambda a, b: a & b, found, F.lit(True))
