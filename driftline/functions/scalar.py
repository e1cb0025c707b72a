"""Scalar computations of change pipelines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DB_TIME = "yyyy-MM-dd HH:mm:ss"


def table_identity(db: Column, tbl: Column) -> Column:
    return F.concat(F.lit("`"), db, F.lit("`.`"), tbl, F.lit("`"))


def key_signature(db: Column, tbl: Column, *key: Column) -> Column:
    """Name and key values in schema order, each value followed by ``_``."""
    return F.concat(table_identity(db, tbl).substr(F.lit(2), F.length(table_identity(db, tbl)) - 2), F.lit(":"), *[F.concat(k.cast("string"), F.lit("_")) for k in key])


def capitalise(c: Column) -> Column:
    """First letter in upper case if it is an ASCII letter; the rest as it is."""
    first = F.substring(c, 1, 1)
    return F.concat(F.when(first.rlike("^[a-z]$"), F.upper(first)).otherwise(first), F.substring(c, 2, 2**30))


def unsigned(c: Column, bits: int) -> Column:
    """A signed value of ``bits`` read as unsigned (exact, also for 64 bits)."""
    wide = c.cast("decimal(20,0)")
    return F.when(wide < 0, wide + F.lit(str(2**bits)).cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")


def trimmed_time(ts: Column) -> Column:
    """``yyyy-mm-dd hh:mm:ss`` and the fraction without trailing zeros."""
    return ts.cast("string")


def rfc3339(ts: Column) -> Column:
    """UTC time as RFC 3339, the fraction without trailing zeros."""
    return F.concat(F.translate(ts.cast("string"), " ", "T"), F.lit("Z"))


def tso_seconds(tso: Column) -> Column:
    """Seconds of a timestamp oracle value (18 logical bits below milliseconds)."""
    return F.floor(F.shiftright(tso.cast("bigint"), 18) / 1000).cast("bigint")


def oplog_seconds(ts: Column) -> Column:
    """Seconds of a 64-bit log timestamp (upper half)."""
    return F.shiftright(ts.cast("bigint"), 32)


def latency_bucket(seconds: Column, least: float = 0.0005) -> Column:
    """Number of the exponential bucket (base 2 from ``least``) of a latency."""
    return F.floor(F.log2(seconds / F.lit(least))).cast("int")


def range_partition(i: Column, n_members: int, n_partitions: int) -> Column:
    """The member that owns partition i when member m takes the range from
    round(m * share) to round((m + 1) * share), halves rounded up.  In whole
    numbers: the last m with m * share < i + 1/2."""
    return (F.ceil((2 * i + 1) * F.lit(n_members) / F.lit(2 * n_partitions)) - 1).cast("int")


def round_robin(i: Column, n_members: int) -> Column:
    """The member that owns partition i when members take turns."""
    return F.pmod(i, F.lit(n_members)).cast("int")


def compare_positions(name_a: Column, pos_a: Column, name_b: Column, pos_b: Column, deviation: int = 0) -> Column:
    """-1, 0 or 1: log positions by file name, then by offset; offsets no
    further apart than ``deviation`` are equal.  Null where one is."""
    by_name = F.when(name_a < name_b, -1).when(name_a > name_b, 1)
    by_pos = F.when(F.abs(pos_a - pos_b) <= deviation, 0).when(pos_a < pos_b, -1).when(pos_a > pos_b, 1)
    return F.when(name_a.isNull() | name_b.isNull(), F.lit(None).cast("int")).otherwise(F.coalesce(by_name, by_pos)).cast("int")
