"""Decoding logs into changes, transactions, order and dependency keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.ordering import running


def split_key_updates(df: DataFrame, old: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    """An update that changes the key becomes a delete with the old key and
    image and an insert with the new ones; ``sub`` orders them.  ``old`` gives
    the old image: column name to its value before; columns it lacks are the
    same on both rows.  Null keys compare as values."""
    moved = F.lit(False)
    for k in keys:
        moved = moved | ~F.col(k).eqNullSafe(old[k])

    def row(sub: int, op: Column, image) -> Column:
        return F.struct(F.lit(sub).alias("sub"), op.alias("op"), *[image(c).alias(c) for c in old])

    both = F.array(row(0, F.lit("delete"), lambda c: old[c]), row(1, F.lit("insert"), F.col))
    one = F.array(row(0, F.col("op"), F.col))
    split = F.explode(F.when((F.col("op") == "update") & moved, both).otherwise(one))
    return df.withColumn("_s", split).withColumns({c: F.col(f"_s.{c}") for c in ("sub", "op", *old)}).drop("_s")


def transaction_batches(df: DataFrame, txn: str, order: str, limit: int = 1024) -> DataFrame:
    """Adds ``batch``: a transaction is handed on whole, or in batches of
    ``limit`` messages if it is longer; ``last`` marks the message that ends it."""
    n = running(df, [txn], [order], F.col(order), _n=("row_number",))
    ends = df.groupBy(txn).agg(F.max(order).alias("_end"))
    return n.join(ends, txn).withColumns({"batch": F.floor((F.col("_n") - 1) / limit), "last": F.col(order) == F.col("_end")}).drop("_n", "_end")


def suppress_loops(df: DataFrame, txn: str, is_tag: Column, order: str) -> DataFrame:
    """Of a transaction with a tag row only the last message stays, as the
    changes were written by a pipeline of our own.  Tags and last messages are
    aggregated with map-side combine and joined, no transaction is gathered."""
    per = df.groupBy(txn).agg(F.max(F.coalesce(is_tag, F.lit(False)).cast("int")).alias("_tag"), F.max(order).alias("_last")).where("_tag = 1")
    return df.join(per, txn, "left").where(F.col("_tag").isNull() | (F.col(order) == F.col("_last"))).drop("_tag", "_last")


def fail_on_tag(df: DataFrame, pipeline: Column, bad: Column) -> DataFrame:
    """Aborts the query at the first row whose tag names a forbidden pipeline."""
    stop = F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.concat(F.lit("transaction of pipeline "), pipeline)))
    return df.where(stop.isNull())


def stream_sequence(df: DataFrame, stream: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Sequence numbers from 1 in each stream; the first order column is a number."""
    return running(df, stream, order, F.col(order[0]), seq_no=("row_number",))


def statement_epochs(df: DataFrame, stream: Sequence[str], order: str, is_ddl: Column) -> DataFrame:
    """The number of schema changes of the stream up to each message."""
    return running(df, stream, [order], F.col(order), epoch=("sum", F.when(is_ddl, 1).otherwise(0)))


def dependency_keys(db: Column, tbl: Column, unique_keys: dict[str, Sequence[tuple[Column, Column | None]]]) -> Column:
    """Hashes of all unique keys a message touches.  For each key, its new
    values (and, if they changed, the old ones) are hashed with database,
    table, key name and column places; a key of nulls only gives none.

    ``unique_keys``: key name to (new value, old value or None) of each column.
    Messages that share a hash must not change their order.
    """

    def one(name: str, values: Sequence[Column]) -> Column:
        present = [F.when(v.isNotNull(), F.concat(F.lit(f"{i}="), v.cast("string"))) for i, v in enumerate(values)]
        some = F.coalesce(*[v.isNotNull().cast("int") * F.when(v.isNotNull(), 1) for v in values])
        return F.when(some.isNotNull(), F.xxhash64(db.cast("string"), tbl.cast("string"), F.lit(name), F.array(*present)))

    out = []
    for name, columns in unique_keys.items():
        new = [c[0] for c in columns]
        out.append(one(name, new))
        if all(c[1] is not None for c in columns):
            changed = F.lit(False)
            for n, o in columns:
                changed = changed | ~n.eqNullSafe(o)
            out.append(F.when(changed, one(name, [c[1] for c in columns])))
    return F.array_compact(F.array(*out))


def batch_islands(df: DataFrame, order: str, partition: Sequence[str] = ()) -> DataFrame:
    """Runs of non-deletes share an island, every delete is one of its own."""
    seen = running(df, partition, [order], F.col(order), _op=("lag", F.col("op")))
    alone = (F.col("op") == "delete") | F.coalesce(F.col("_op") == "delete", F.lit(True))
    return running(seen.withColumn("_new", alone.cast("int")), partition, [order], F.col(order), island=("sum", F.col("_new"))).drop("_new", "_op")


def committed_prefix(acks: DataFrame, stream: str, seq: str, acked: Column) -> DataFrame:
    """(stream, n, committed): the length of each stream's prefix without a
    missing acknowledgement; one aggregate, as sequences run from 1 without gaps."""
    missing = F.min(F.when(~F.coalesce(acked, F.lit(False)), F.col(seq)))
    return acks.groupBy(stream).agg(F.count(F.lit(1)).alias("n"), F.coalesce(missing - 1, F.max(seq)).alias("committed"))


def low_watermark(df: DataFrame, stream: str, enqueued: Column, committed: Column) -> DataFrame:
    """(stream, watermark): the earlier of the last enqueued and the last committed event."""
    return df.groupBy(stream).agg(F.least(F.max(enqueued), F.max(committed)).alias("watermark"))


def internal_traffic(df: DataFrame, own_heartbeat: str, positions: Sequence[str] = ("positions",), heartbeats: str = "heartbeat") -> DataFrame:
    """Drops rows of the server's own schema, foreign heartbeats and dead
    signals, and stored positions."""
    internal = (F.col("db") == "mysql") | F.col("tbl").isin(*positions, "dead_signals") | (F.col("tbl").startswith(heartbeats) & ~F.coalesce(F.col("pks")["name"] == own_heartbeat, F.lit(False)))
    return df.where(~F.coalesce(internal, F.lit(False)))
