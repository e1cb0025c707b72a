"""Filters on change rows: DataFrame to DataFrame.

Column filters work on map columns (``data``, ``old``, ``pks``) where rows of
several tables share a feed, and on plain columns where a feed is typed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline import registry
from driftline.operators.predicates import matcher


def accept(df: DataFrame, p: Column) -> DataFrame:
    return df.where(p)


def reject(df: DataFrame, p: Column) -> DataFrame:
    """Drops matching rows; rows of which the condition is null stay."""
    return df.where(~F.coalesce(p, F.lit(False)))


def delete_map_columns(df: DataFrame, p: Column, columns: Sequence[str], maps: Sequence[str] = ("data", "old", "pks")) -> DataFrame:
    """Removes columns from data, old image and key of matching rows.  A key
    column removed can't be used to delete later."""
    p = F.coalesce(p, F.lit(False))
    return df.withColumns({m: F.when(p, F.map_filter(m, lambda k, v: ~k.isin(list(columns)))).otherwise(F.col(m)) for m in maps if m in df.columns})


def rename_map_columns(df: DataFrame, p: Column, old: Sequence[str], new: Sequence[str]) -> DataFrame:
    """Renames in list order; data and old image get the new name even where
    the old one is absent (as null), the key only where it is present."""
    if len(old) != len(new):
        raise ValueError("'from' and 'to' must have the same length")
    p = F.coalesce(p, F.lit(False))

    def moved(m: Column, a: str, b: str) -> Column:
        value = F.element_at(m, F.lit(a))
        rest = F.map_filter(m, lambda k, v: ~k.isin([a, b]))
        return F.map_concat(rest, F.create_map(F.lit(b), value))

    for a, b in zip(old, new):
        updates = {}
        for m in ("data", "old", "pks"):
            if m in df.columns:
                there = F.col(m).isNotNull() & p if m != "pks" else F.col(m).isNotNull() & p & F.map_contains_key(m, F.lit(a))
                updates[m] = F.when(there, moved(F.col(m), a, b)).otherwise(F.col(m))
        df = df.withColumns(updates)
    return df


def sidecar(df: DataFrame, fn: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """A user's function over Arrow batches as pandas frames; it may rewrite or
    drop rows.  Keep it last in a chain: filters are not pushed through it."""
    return df.mapInPandas(fn, schema)


CONTROL = ("ctl", "closeInput")

BUILT_IN: dict[str, Callable[[DataFrame, dict, Column], DataFrame]] = {
    "accept": lambda df, c, passing: accept(df, matcher(c) | passing),
    "reject": lambda df, c, passing: reject(df, matcher(c) & ~passing),
    "delete-dml-column": lambda df, c, passing: delete_map_columns(df, matcher(c) & ~passing, c["columns"]),
    "rename-dml-column": lambda df, c, passing: rename_map_columns(df, matcher(c) & ~passing, c["from"], c["to"]),
}


def register(kind: str):
    """Adds a filter under a name; user filters are Python callables of the
    rows and the filter's settings."""
    if kind in BUILT_IN:
        raise ValueError(f"filter {kind!r} is built in")
    return registry.register("filters", kind, replace=True)


def chain(df: DataFrame, configs: Sequence[dict]) -> DataFrame:
    """Filters in order; control messages pass by: built-in filters let them
    through in the same pass over the rows, users' filters don't see them.  A
    filter without a matcher is a mistake in the configuration."""
    passing = F.coalesce(F.col("msg_type").isin(*CONTROL), F.lit(False)) if "msg_type" in df.columns else None
    for c in configs:
        kind, conf = c["type"], c.get("config", {})
        if kind not in BUILT_IN and kind not in registry.names("filters"):
            raise ValueError(f"unknown filter {kind!r}")
        if not any(k.startswith("match") for k in conf):
            raise ValueError(f"filter {kind!r} has no matcher")
        if kind in BUILT_IN:
            df = BUILT_IN[kind](df, conf, F.lit(False) if passing is None else passing)
        elif passing is None:
            df = registry.plugin("filters", kind)(df, conf)
        else:
            df = registry.plugin("filters", kind)(df.where(~passing), conf).unionByName(df.where(passing), allowMissingColumns=True)
    return df
