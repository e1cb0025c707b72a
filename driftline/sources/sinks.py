"""Outputs of pipelines: in batch, or for each batch of a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators.apply import replace_rows
from driftline.operators.documents import document_id, index_name


def discard(df: DataFrame, **_) -> None:
    df.write.format("noop").mode("overwrite").save()


def console(df: DataFrame, rows: int = 20, **_) -> None:
    """Prints the first rows."""
    df.show(rows, truncate=False)


def parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite", **_) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def kafka(df: DataFrame, servers: str, **options) -> None:
    """(topic, partition, key, value) rows; needs Spark's Kafka connector.
    All replicas acknowledge and batches are compressed."""
    settings = {"kafka.bootstrap.servers": servers, "kafka.acks": "all", "kafka.compression.type": "snappy"} | options
    df.write.format("kafka").options(**settings).save()


def jdbc(df: DataFrame, url: str, name: str, mode: str = "append", **options) -> None:
    df.write.mode(mode).format("jdbc").options(url=url, dbtable=name, **options).save()


def documents(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], ignore_without_key: bool = False) -> DataFrame:
    """(index, doc_id, document): what a document index holds after the
    changes.  Rows whose key is null are an error, or left out on request."""
    lacking = F.lit(False)
    for k in keys:
        lacking = lacking | F.col(k).isNull()
    if ignore_without_key:
        df = df.where(~lacking)
    else:
        df = df.where(F.when(lacking, F.raise_error(F.lit("a change without primary key"))).isNull())
    live = replace_rows(df, ["tbl", *keys], order, columns)
    return live.select(index_name(F.col("tbl")).alias("index"), document_id(*[F.col(k) for k in keys]).alias("doc_id"), F.to_json(F.struct(*keys, *columns), {"ignoreNullFields": "false"}).alias("document"))


SINKS: dict[str, Callable] = {"discard": discard, "console": console, "parquet": parquet, "kafka": kafka, "jdbc": jdbc}
