"""MySQL column types: reading a declaration, Spark types, decoding, writing.

A declaration is a type word, sizes or values in brackets, and attributes.
The type word alone names the type; ``unsigned`` widens integers.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DECLARATION = re.compile(r"^\s*([a-z]+(?:\s+precision)?)\s*(?:\(([^)]*)\))?\s*(.*)$", re.I | re.S)

# Bytes of MySQL's integer types.
INTEGER_BYTES = {"tinyint": 1, "smallint": 2, "mediumint": 3, "int": 4, "integer": 4, "bigint": 8}
# Spark types of the other type words; times of day, texts, enums, sets and JSON stay text.
OTHER_TYPES = {
    "bit": "bigint",
    "bool": "tinyint",
    "boolean": "tinyint",
    "year": "int",
    "float": "float",
    "double": "double",
    "double precision": "double",
    "real": "double",
    "date": "date",
    "datetime": "timestamp_ntz",
    "timestamp": "timestamp",
    "binary": "binary",
    "varbinary": "binary",
    "tinyblob": "binary",
    "blob": "binary",
    "mediumblob": "binary",
    "longblob": "binary",
}


class Declaration(NamedTuple):
    word: str
    sizes: tuple[int, ...]
    unsigned: bool


def declaration(raw: str) -> Declaration:
    m = _DECLARATION.match(raw)
    if not m:
        return Declaration("", (), False)
    numbers = tuple(int(n) for n in re.findall(r"\d+", m[2] or "")) if not re.search(r"['\"]", m[2] or "") else ()
    words = m[3].lower().split()
    return Declaration(" ".join(m[1].lower().split()), numbers, "unsigned" in words or "zerofill" in words)


def spark_type(raw: str) -> str:
    """The Spark type that holds a column exactly."""
    word, sizes, unsigned = declaration(raw)
    if word in INTEGER_BYTES:
        bits = 8 * INTEGER_BYTES[word] - (not unsigned)
        for name, room in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)):
            if bits <= room:
                return name
        return "decimal(20,0)"
    if word in ("decimal", "numeric", "dec", "fixed"):
        precision, scale = (*sizes, *(10, 0)[len(sizes) :])[:2]
        return f"decimal({min(precision, 38)},{scale})"
    return OTHER_TYPES.get(word, "string")


def decode(c: Column, raw: str) -> Column:
    """Text to the column's type; what doesn't fit, as a zero date, is null."""
    t = spark_type(raw)
    return c if t == "string" else c.try_cast(t)


# MySQL types that hold Spark's.
MYSQL_TYPES = {"tinyint": "tinyint", "smallint": "smallint", "int": "int", "bigint": "bigint", "float": "float", "double": "double", "boolean": "tinyint(1)", "date": "date", "timestamp": "timestamp(6)", "timestamp_ntz": "datetime(6)", "binary": "longblob"}


def mysql_type(t: T.DataType, key: bool = False) -> str:
    """The MySQL type of a Spark column: text in a key is of bounded length,
    arrays, maps and structs are JSON."""
    if isinstance(t, T.DecimalType):
        return f"decimal({t.precision},{t.scale})"
    if isinstance(t, T.StringType):
        return "varchar(255)" if key else "longtext"
    return MYSQL_TYPES.get(t.simpleString(), "json")
