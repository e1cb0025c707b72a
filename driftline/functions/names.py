"""Canonical forms of database, table, key and operation spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = " \t\r\n"


def plain_name(c: Column) -> Column:
    """Lower case, without backquotes and outer blanks; null stays null."""
    return F.lower(F.btrim(F.translate(c, "`", ""), F.lit(_BLANKS)))


def plain_op(c: Column) -> Column:
    return F.lower(F.btrim(c, F.lit(_BLANKS)))


def key_entries(pks_json: Column) -> Column:
    """The key as an array of (key, value) in alphabetical order of the names."""
    return F.array_sort(F.map_entries(F.from_json(pks_json, "map<string,string>")))


def key_text(entries: Column) -> Column:
    """Key values as text, joined with ``|``; a null value counts as empty text."""
    return F.array_join(F.transform(entries, lambda e: F.coalesce(e["value"], F.lit(""))), "|")
