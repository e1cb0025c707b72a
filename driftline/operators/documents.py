"""Related tables as nested documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.joins import null_safe_join


def document_id(*key: Column) -> Column:
    """Key values in schema order joined with ``_``."""
    return F.concat_ws("_", *[k.cast("string") for k in key])


def index_name(name: Column) -> Column:
    return F.lower(F.ltrim(name, F.lit("_-+")))


def pick_columns(columns: Sequence[str], include: Sequence[str] = (), exclude: Sequence[str] = (), convert: dict[str, str] | None = None, prefix: str = "") -> list[tuple[str, str]]:
    """(column, name in the document): excluded ones go first, then only the
    included stay, then renamed ones get their name and others the prefix."""
    convert = convert or {}
    kept = [c for c in columns if c not in exclude and (not include or c in include)]
    return [(c, convert.get(c) or prefix + c) for c in kept]


# Types of a document index for Spark types.
INDEX_TYPES = {"string": "keyword", "bigint": "long", "int": "integer", "smallint": "short", "tinyint": "byte", "double": "double", "float": "float", "boolean": "boolean", "date": "date", "timestamp": "date", "timestamp_ntz": "date", "binary": "binary"}


def index_mapping(schema: T.StructType) -> dict:
    """The mapping of a document table: nested for arrays of objects, object
    for objects, decimals as text so that they stay exact."""

    def one(t: T.DataType) -> dict:
        if isinstance(t, T.ArrayType):
            inner = one(t.elementType)
            return {**inner, "type": "nested"} if "properties" in inner else inner
        if isinstance(t, T.StructType):
            return {"type": "object", "properties": {f.name: one(f.dataType) for f in t}}
        return {"type": INDEX_TYPES.get(t.simpleString(), "keyword")}

    return {"properties": {f.name: one(f.dataType) for f in schema}}


def merged_fields(changes: DataFrame, keys: Sequence[str], order: str, fields: str = "data") -> DataFrame:
    """(keys, fields): an insert replaces the element of its key, an update
    merges the fields it carries (a map) into it or, without one, makes it, a
    delete removes it.  Each field is that of the latest change that carries
    it since the last insert or delete: aggregates with map-side combine, no
    key is gathered."""
    reset = F.max(F.when(F.col("op") != "update", F.col(order)))
    last = changes.groupBy(*keys).agg(reset.alias("_reset"), F.max_by("op", order).alias("_op"))
    live = last.where("_op <> 'delete'").drop("_op")
    since = null_safe_join(changes.where("op <> 'delete'"), live, keys, "inner").where(F.col("_reset").isNull() | (F.col(order) >= F.col("_reset")))
    each = since.select(*keys, order, F.explode_outer(fields).alias("_f", "_v"))
    latest = each.groupBy(*keys, "_f").agg(F.max_by(F.struct("_v"), order).alias("_v"))
    entries = F.collect_list(F.when(F.col("_f").isNotNull(), F.struct("_f", F.col("_v._v").alias("_v"))))
    return latest.groupBy(*keys).agg(F.map_from_entries(F.array_sort(entries)).alias(fields))


def attach_object(main: DataFrame, other: DataFrame, on: Sequence[str], name: str, columns: list[tuple[str, str]]) -> DataFrame:
    """One-to-one as a nested object, null where there is none."""
    o = other.select(*on, F.struct(*[F.col(c).alias(n) for c, n in columns]).alias(name))
    return main.join(o, list(on), "left")


def attach_flat(main: DataFrame, other: DataFrame, on: Sequence[str], columns: list[tuple[str, str]]) -> DataFrame:
    """One-to-one as columns of the document."""
    return main.join(other.select(*on, *[F.col(c).alias(n) for c, n in columns]), list(on), "left")


def attach_many(main: DataFrame, other: DataFrame, on: Sequence[str], name: str, columns: list[tuple[str, str]], order: Sequence[str]) -> DataFrame:
    """One-to-many as an array of objects in a fixed order, empty where there
    are none.  A document holds its children, so a parent with very many
    children makes a very large document; that is the format asked for."""
    element = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c).alias(n) for c, n in columns])
    arrays = other.groupBy(*on).agg(F.array_sort(F.collect_list(element)).alias(name))
    clean = F.transform(name, lambda e: F.struct(*[e[n].alias(n) for _, n in columns]))
    empty = F.array().cast(arrays.select(clean.alias("x")).schema["x"].dataType)
    return main.join(arrays, list(on), "left").withColumn(name, F.coalesce(clean, empty))
