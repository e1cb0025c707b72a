"""Sources: tables and files as change feeds, and feeds derived from tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.session import table

ENVELOPE = T.StructType(
    [
        T.StructField("stream_key", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("msg_type", T.StringType()),
        T.StructField("db", T.StringType()),
        T.StructField("tbl", T.StringType()),
        T.StructField("event_ts", T.TimestampNTZType()),
        T.StructField("op", T.StringType()),
        T.StructField("data", T.MapType(T.StringType(), T.StringType())),
        T.StructField("old", T.MapType(T.StringType(), T.StringType())),
        T.StructField("pks", T.MapType(T.StringType(), T.StringType())),
        T.StructField("txn_id", T.LongType()),
    ]
)


def events_as_changes(events: DataFrame) -> DataFrame:
    """The ``events`` table as a feed: the key is the user, signup inserts,
    error deletes, all else updates; a secondary key comes from the k in props."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.lit("app").alias("db"),
        F.concat(F.lit("events_"), F.pmod("user_id", F.lit(4)).cast("string")).alias("tbl"),
        F.col("user_id").alias("pk"),
        F.col("event_id").alias("seq"),
        F.pmod("user_id", F.lit(2)).cast("bigint").alias("stream"),
        F.floor(F.col("event_id") / 8).cast("bigint").alias("txn_id"),
        F.col("ts").alias("event_ts"),
        F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("update").alias("op"),
        "event_type",
        "value",
        k.alias("k"),
        F.nullif(k, F.lit(0)).alias("uk"),
    )


def derived_feed(spark: SparkSession, d: str) -> DataFrame:
    return events_as_changes(table(spark, d, "events"))


def read_changes(spark: SparkSession, path: str, fmt: str = "json", streaming: bool = False, **options) -> DataFrame:
    """Change rows of files in the envelope's schema, in batch or as a stream.
    Column pruning and filters reach columnar files."""
    reader = (spark.readStream if streaming else spark.read).schema(ENVELOPE).format(fmt).options(**options)
    return reader.load(path)


def from_envelope(value: Column) -> Column:
    return F.from_json(value.cast("string"), ENVELOPE)


def from_binlog(descriptor: str, message: str) -> Callable[[Column], Column]:
    """Decodes the protobuf messages of a descriptor file; needs Spark's
    protobuf module."""

    def decode(value: Column) -> Column:
        from pyspark.sql.protobuf.functions import from_protobuf

        return from_protobuf(value, message, descFilePath=descriptor)

    return decode


def read_kafka(spark: SparkSession, servers: str, topic: str, streaming: bool = True, decode: Callable[[Column], Column] = from_envelope, **options) -> DataFrame:
    """Change rows of a topic; needs Spark's Kafka connector on the class
    path.  ``decode`` makes the struct of a change from a message's bytes.
    Schema changes don't come this way."""
    reader = (spark.readStream if streaming else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options)
    return reader.load().select(decode(F.col("value")).alias("m"), "topic", "partition", "offset").select("m.*", "topic", "partition", "offset")


OPLOG = "op_no bigint, obj_id string, operation string, op_ns string, data_json string, row_json string, ts_sec bigint, ts_ord int, op_source int"


def read_oplog(spark: SparkSession, path: str, fmt: str = "json", streaming: bool = False, **options) -> DataFrame:
    """Entries of a document store's log from files that arrive, for oplog.parse."""
    return (spark.readStream if streaming else spark.read).schema(OPLOG).format(fmt).options(**options).load(path)


def collected_messages(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Messages that other systems send to a socket, a JSON object a line:
    msg_id, msg_tag, barrier, payload_id, payload_content, msg_time, msg_checksum."""
    schema = "msg_id string, msg_tag string, barrier bigint, payload_id string, payload_content string, msg_time bigint, msg_checksum string"
    lines = spark.readStream.format("socket").options(host=host, port=str(port)).load()
    return lines.select(F.from_json("value", schema).alias("m")).where("m is not null").select("m.*")


def scan_documents(docs: DataFrame, id_field: str, bounds: Sequence) -> DataFrame:
    """A collection read in ranges of its ids [lower, upper), as inserts:
    columns range, id, op and the document's."""
    n = F.lit(0)
    for b in bounds:
        n = n + F.when(F.col(id_field) >= F.lit(b), 1).otherwise(0)
    rest = [c for c in docs.columns if c != id_field]
    return docs.select(n.alias("range"), F.col(id_field).alias("id"), F.lit("insert").alias("op"), *rest).repartitionByRange(max(1, len(bounds) + 1), "range", "id")


def read_table(spark: SparkSession, url: str, name: str, column: str | None = None, lower=None, upper=None, parts: int = 8, where: str | None = None, **options) -> DataFrame:
    """A table by JDBC, in ranges of a column where one is given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if column is not None:
        reader = reader.options(partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts))
    df = reader.load()
    return df.where(where) if where else df


def source(spark: SparkSession, mode: str, snapshot=None, stream=None):
    """Mode multiplexer: ``batch`` gives the snapshot, ``stream`` the log,
    ``replication`` both, the snapshot first (see snapshot.replicate and
    ``python -m driftline``, which runs them one after the other)."""
    if mode == "batch":
        return snapshot()
    if mode == "stream":
        return stream()
    if mode == "replication":
        return snapshot(), stream()
    raise ValueError(f"unknown source mode {mode!r}")


def empty_source(spark: SparkSession) -> DataFrame:
    """A source without messages."""
    return spark.createDataFrame([], ENVELOPE)
