"""Changes as messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIME_ZONE = "Asia/Shanghai"  # literal of the header, a setting
KEEP_NULLS = {"ignoreNullFields": "false"}


def text_map(columns: Sequence[str]) -> Column:
    """Every value as text, null stays null."""
    return F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c).cast("string") for c in columns]))


def json_v01(db: Column, tbl: Column, op: Column, ts: Column, data: Column, old: Column | None = None, pks: Column | None = None, zone: str = TIME_ZONE) -> Column:
    """Header and data with every value as text; time in epoch seconds."""
    none = F.lit(None).cast("map<string,string>")
    return F.to_json(
        F.struct(
            F.lit("0.1").alias("version"),
            db.alias("database"),
            tbl.alias("table"),
            op.alias("type"),
            F.unix_timestamp(ts).alias("ts"),
            F.lit(zone).alias("time_zone"),
            data.alias("data"),
            (none if old is None else old).alias("old"),
            (none if pks is None else pks).alias("pks"),
        ),
        KEEP_NULLS,
    )


def json_v20(db: Column, tbl: Column, op: Column, ts: Column, data: Column, old: Column | None = None, pks: Column | None = None) -> Column:
    """Typed values; the body's names are capitalised."""
    none = F.lit(None).cast("map<string,string>")
    return F.to_json(
        F.struct(
            F.lit("2.0.alpha").alias("version"),
            db.alias("database"),
            tbl.alias("table"),
            op.alias("type"),
            ts.alias("ts"),
            data.alias("Data"),
            (none if old is None else old).alias("Old"),
            (none if pks is None else pks).alias("Pks"),
        ),
        KEEP_NULLS,
    )


def embedded(document: Column) -> Column:
    """A JSON document held as text, to stand within other JSON; null is
    ``null``, text that is no JSON becomes a JSON string."""
    return F.when(document.isNull(), "null").when(F.try_parse_json(document).isNotNull(), document).otherwise(_string(document))


def _object(*parts: tuple[str, Column]) -> Column:
    out = []
    for k, (name, value) in enumerate(parts):
        out += [F.lit(("{" if k == 0 else ",") + f'"{name}":'), value]
    return F.concat(*out, F.lit("}"))


def _string(c: Column) -> Column:
    json = F.to_json(F.struct(c.alias("v")), KEEP_NULLS)
    return json.substr(F.lit(6), F.length(json) - 6)


def mongo_json(version: str, db: Column, coll: Column, data: Column, row: Column, source: Column | None = None, doc_id: Column | None = None, op: Column | None = None, from_query: Column | None = None) -> Column:
    """Document changes.  Version 0.1 embeds the log entry (``_id``,
    operation, namespace, data, row, source) and names the server it came
    from; version 2.0.alpha carries change and row.  Documents keep their
    text."""
    none = F.lit(None).cast("string")
    head = [("version", F.lit(f'"{version}"')), ("database", _string(db)), ("collection", _string(coll))]
    if version == "2.0.alpha":
        return _object(*head, ("data", embedded(data)), ("row", embedded(row)))
    if version != "0.1":
        raise ValueError(f"unknown version {version!r}")
    number = F.coalesce((F.lit(0) if from_query is None else from_query).cast("int").cast("string"), F.lit("null"))
    entry = _object(("_id", _string(none if doc_id is None else doc_id)), ("operation", _string(none if op is None else op)), ("namespace", _string(F.concat(db, F.lit("."), coll))), ("data", embedded(data)), ("row", embedded(row)), ("source", number))
    return _object(*head, ("unique_source_name", _string(F.lit("") if source is None else source)), ("oplog", entry))


def protobuf(value: Column, message: str, descriptor: str) -> Column:
    """Messages of a descriptor file; needs Spark's protobuf module."""
    from pyspark.sql.protobuf.functions import to_protobuf

    return to_protobuf(value, message, descFilePath=descriptor)


def message_size(key: Column, value: Column) -> Column:
    return F.lit(26) + F.coalesce(F.octet_length(key), F.lit(0)) + F.coalesce(F.octet_length(value), F.lit(0))


def checksum(op: Column, row: Column) -> Column:
    return F.md5(F.concat(F.upper(op), F.lit(" "), row).cast("binary"))


def kafka_rows(df: DataFrame, key: Column, value: Column, limit: int | None = None, skip_large: bool = False) -> DataFrame:
    """(topic, partition, key, value) for a Kafka writer.  Messages above
    ``limit`` bytes are dropped with ``skip_large``, else an error."""
    out = df.select("topic", "partition", key.cast("string").alias("key"), value.alias("value"))
    if limit is None:
        return out
    large = message_size(F.col("key"), F.col("value")) > limit
    if skip_large:
        return out.where(~large)
    return out.withColumn("value", F.when(large, F.raise_error(F.lit("message too large"))).otherwise(F.col("value")))
