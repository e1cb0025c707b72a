"""Differences between two copies of a table, field by field.

A column-by-bucket checksum matrix locates them: each side sums two wide
(128-bit) additive hashes of its cells by (table, key bucket, field).  Rows
are read and joined only in buckets, and only for fields, whose sums are
unequal.

A bucket is a part of a shuffle partition: bucket numbers come from the hash
by which Spark spreads the keys, so the rows of a bucket lie in one task once
their latest messages are found, its sums are whole there, and the matrix, a
few bytes a row, is all that is shuffled for it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.jsontext import canonical_value
from driftline.session import cut, shuffle_partitions

_ROW = "\x00row"  # stands for the row itself among the fields
ROWS_PER_BUCKET = 16


KEYS = ["_t", "_p"]


def keyed(messages: DataFrame) -> DataFrame:
    """Adds _t and _p: tbl and payload_id as texts that are never null."""
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    return messages.withColumns({"_t": text("tbl"), "_p": text("payload_id")})


def unkeyed(key: str) -> Column:
    return F.when(F.col(key) != "", F.substring(F.col(key), 2, 2**30))


def latest_images(messages: DataFrame) -> DataFrame:
    """(_t, _p, cells): rows a side holds by the message with the
    largest msg_time (a null time is oldest; of equal times the largest
    rec_no).  A row whose latest message is a DELETE isn't held.  Content that
    is null or no object is a row without fields."""
    order = F.struct(F.coalesce(F.col("msg_time"), F.lit(-(2**62))), "rec_no")
    last = keyed(messages).groupBy(*KEYS).agg(F.max_by("payload_content", order).alias("_c"))
    # nothing is parsed before the latest message of each row is known
    op = F.upper(F.regexp_extract("_c", r"^\s*(\S+)", 1))
    body = F.regexp_extract("_c", r"(?s)^\s*\S+\s(.*)$", 1)
    held = last.where(F.coalesce(op != "DELETE", F.lit(True)))
    cells = F.from_json(body, "map<string,variant>")
    return held.select(*KEYS, cells_of(cells).alias("cells"))


def cells_of(variants: Column) -> Column:
    """Fields as an array of (field, value) in comparison form; nulls are left out."""
    each = F.transform(F.map_entries(variants), lambda e: F.struct(e["key"].alias("field"), canonical_value(e["value"]).alias("value")))
    return F.coalesce(F.filter(each, lambda c: c["value"].isNotNull()), F.array().cast("array<struct<field:string,value:string>>"))


def _halves(h: Column) -> list[Column]:
    """A 64-bit hash as two numbers whose sums can't overflow."""
    return [h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)]


def checksum_matrix(rows: DataFrame) -> DataFrame:
    """(_t, bucket, field, s0..s3): additive hashes of the cells; the row itself counts as a field."""
    whole = F.array(F.struct(F.lit(_ROW).alias("field"), F.lit("").alias("value")))
    c = rows.select(*KEYS, "bucket", F.explode(F.concat(whole, "cells")).alias("_c")).select(*KEYS, "bucket", "_c.field", "_c.value")
    parts = _halves(F.xxhash64(*KEYS, "field", "value")) + _halves(F.xxhash64(F.lit(1), "value", "field", "_p", "_t"))
    return c.groupBy("_t", "bucket", "field").agg(*[F.sum(x).alias(f"s{i}") for i, x in enumerate(parts)])


def unequal_cells(source_matrix: DataFrame, target_matrix: DataFrame) -> DataFrame:
    """(_t, bucket, fields): the fields of each bucket whose sums differ or
    that only one side has.  The sides cancel out in one sum, so they are
    added, not joined."""
    sums = [f"s{i}" for i in range(4)]
    both = source_matrix.unionByName(target_matrix.select("_t", "bucket", "field", *[(-F.col(s)).alias(s) for s in sums]))
    off = both.groupBy("_t", "bucket", "field").agg(*[F.sum(s).alias(s) for s in sums]).where(" or ".join(f"{s} <> 0" for s in sums))
    return off.groupBy("_t", "bucket").agg(F.collect_set("field").alias("fields"))


def table_differences(source: DataFrame, target: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``tbl, payload_id, kind, field``: rows that only one side holds and
    fields whose values differ.

    ``source`` and ``target`` hold messages with tbl, payload_id,
    payload_content, msg_time and rec_no; further columns are ignored.  A null
    tbl or payload_id is a value of its own.  An empty side makes every row of
    the other one missing.
    """
    spark = source.sparkSession
    tasks = shuffle_partitions(spark)
    per_task = max(1, math.ceil(max(source.count(), target.count()) / rows_per_bucket / tasks))
    # pmod(hash, tasks) is the task that Spark's hash partitioning gives a key
    bucket = F.pmod(F.hash(*KEYS), F.lit(tasks * per_task))
    s, t = (cut(latest_images(m).withColumn("bucket", bucket)) for m in (source, target))
    wrong = cut(unequal_cells(checksum_matrix(s), checksum_matrix(t)))

    def affected(rows: DataFrame) -> DataFrame:
        near = rows.join(wrong, ["_t", "bucket"])
        return near.select(*KEYS, F.filter("cells", lambda c: F.array_contains("fields", c["field"])).alias("cells"))

    a, b = affected(s).withColumnRenamed("cells", "_a"), affected(t).withColumnRenamed("cells", "_b")
    both = a.join(b, KEYS, "full_outer")
    off = F.concat(F.array_except("_a", "_b"), F.array_except("_b", "_a"))
    differs = F.transform(F.array_distinct(F.transform(off, lambda c: c["field"])), lambda f: F.struct(F.lit("value_differs").alias("kind"), f.alias("field")))
    missing = lambda kind: F.array(F.struct(F.lit(kind).alias("kind"), F.lit("").alias("field")))
    found = F.when(F.col("_b").isNull(), missing("missing_in_target")).when(F.col("_a").isNull(), missing("missing_in_source")).otherwise(differs)
    each = both.select(*KEYS, F.explode(found).alias("_d"))
    return each.select(unkeyed("_t").alias("tbl"), unkeyed("_p").alias("payload_id"), "_d.kind", "_d.field")
