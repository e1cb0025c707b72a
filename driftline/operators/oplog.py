"""Document-store logs: entries to changes, lookup order, table formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Operation letters of the log.
OPERATIONS = {"i": "insert", "u": "update", "d": "delete"}


def parse(ops: DataFrame) -> DataFrame:
    """(op_no, op, db, coll, id, body): inserts and deletes take the id from
    their document, updates from the entry; of commands only drops stay, as
    ``drop`` of a collection.  Entries without a namespace are left out."""
    letter = F.lower(F.btrim("operation"))
    dropped = F.get_json_object("data_json", "$.drop")
    op = F.when(letter == "c", F.when(dropped.isNotNull(), F.lit("drop")))
    for k, v in OPERATIONS.items():
        op = op.when(letter == k, F.lit(v))
    own = F.coalesce(F.get_json_object("data_json", "$._id['$oid']"), F.get_json_object("data_json", "$._id"))
    coll = F.regexp_replace("op_ns", r"^[^.]*\.?", "")
    return ops.where("op_ns is not null").select(
        "op_no",
        op.alias("op"),
        F.substring_index("op_ns", ".", 1).alias("db"),
        F.when(letter == "c", dropped).otherwise(coll).alias("coll"),
        F.when(letter.isin("i", "d"), F.coalesce(own, F.col("obj_id"))).when(letter == "u", F.col("obj_id")).alias("id"),
        F.when(letter.isin("i", "u"), F.col("data_json")).alias("body"),
    ).where("op is not null")


ORDERINGS = ("log", "namespace", "document")


def ordering_key(ordering: str, db: Column, coll: Column, doc_id: Column) -> Column:
    """What must keep its order: the whole log, a namespace or a document."""
    if ordering == "log":
        return F.lit(0).cast("bigint")
    if ordering == "namespace":
        return F.xxhash64(db, coll)
    if ordering == "document":
        return F.xxhash64(db, coll, F.coalesce(doc_id, F.lit("")))
    raise ValueError(f"unknown ordering {ordering!r}")


def spread(df: DataFrame, ordering: str, n: int, order: str) -> DataFrame:
    """The log over ``n`` tasks, each in order."""
    key = ordering_key(ordering, F.col("db"), F.col("coll"), F.col("id"))
    return df.withColumn("_k", key).repartition(n, "_k").sortWithinPartitions(order).drop("_k")
