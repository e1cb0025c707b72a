"""JSON held as text: canonical comparison forms and loose nested parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TIME = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s?(Z|[+-]\d{2}:?\d{2})?)?$"
_ZERO = r"^0000-00-00"


def canonical_text(t: Column) -> Column:
    """Text for comparison: times as instants in microseconds (without zone:
    UTC), zero dates as themselves whichever separator they have, all else as is."""
    plain = F.regexp_replace(F.regexp_replace(t, "T", " "), "Z$", "")
    return (
        F.when(t.rlike(_ZERO), F.concat(F.lit("z"), plain))
        .when(t.rlike(_TIME), F.coalesce(F.concat(F.lit("t"), F.unix_micros(F.try_to_timestamp(t)).cast("string")), F.concat(F.lit("s"), t)))
        .otherwise(F.concat(F.lit("s"), t))
    )


def canonical_number(t: Column) -> Column:
    """A JSON number by value: exact up to 20 digits before and 18 after the
    point, else as a double."""
    exact = F.regexp_replace(F.regexp_replace(t.try_cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.concat(F.lit("n"), F.coalesce(F.when(t.try_cast("decimal(38,18)") == 0, F.lit("0")), F.when(~t.contains("E"), exact), t.try_cast("double").cast("string"), t))


def canonical_value(v: Column) -> Column:
    """A VARIANT value for comparison; JSON null and absence are null, empty
    text is a value, objects compare regardless of the order of their fields."""
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    return (
        F.when(v.isNull() | (kind == "VOID"), F.lit(None).cast("string"))
        .when(kind == "STRING", canonical_text(text))
        .when(kind == "BOOLEAN", F.concat(F.lit("b"), text))
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.concat(F.lit("j"), F.to_json(v)))
        .otherwise(canonical_number(text))
    )


def elements(part: Column) -> Column:
    """The elements of a nested part held as JSON text: an array's elements as
    JSON text, a lone object as the one element 0, anything else none.  A null
    element keeps its place."""
    t = F.ltrim(part)
    return (
        F.when(t.startswith("["), F.from_json(t, "array<string>"))
        .when(t.startswith("{"), F.array(t))
        .otherwise(F.lit(None).cast("array<string>"))
    )


def is_object(text: Column) -> Column:
    return F.coalesce(F.ltrim(text).startswith("{"), F.lit(False))
