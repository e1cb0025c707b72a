"""Routing: the first matching route, or all matching models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.options import option
from driftline.operators.predicates import matcher


def first_match(routes: Sequence[dict], value) -> Column:
    """``value(route)`` of the first route that matches, else null."""
    out = None
    for r in routes:
        cond, v = matcher(r), value(r)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return F.lit(None) if out is None else out


def route_tables(df: DataFrame, routes: Sequence[dict]) -> DataFrame:
    """Adds tgt_db and tgt_tbl; ``*`` or none keeps the source's name.  Rows
    that no route matches are dropped; without routes all rows stay."""
    if not routes:
        return df.withColumns({"tgt_db": F.col("db"), "tgt_tbl": F.col("tbl")})

    def name(r: dict, key: str, col: str) -> Column:
        v = r.get(key, "*")
        return F.col(col) if v == "*" else F.lit(v)

    target = first_match(routes, lambda r: F.struct(name(r, "target-schema", "db").alias("tgt_db"), name(r, "target-table", "tbl").alias("tgt_tbl")))
    return df.withColumn("_t", target).where("_t is not null").withColumns({"tgt_db": F.col("_t.tgt_db"), "tgt_tbl": F.col("_t.tgt_tbl")}).drop("_t")


def route_topics(df: DataFrame, routes: Sequence[dict], key: Column, partitions: int) -> DataFrame:
    """Adds topic and partition (key modulo the number of partitions, a random
    one without key); rows without a route, and everything if there is none,
    are dropped."""
    if not routes:
        return df.withColumns({"topic": F.lit(None).cast("string"), "partition": F.lit(None).cast("int")}).where("false")
    return df.withColumn("topic", first_match(routes, lambda r: F.lit(r["dml-topic"]))).where("topic is not null").withColumn("partition", F.coalesce(F.pmod(key, F.lit(partitions)), F.floor(F.rand() * partitions)).cast("int"))


def route_documents(df: DataFrame, routes: Sequence[dict], default_index: Column) -> DataFrame:
    """Adds index, doc_type and ignore_without_key of the first matching
    route: ``target-index`` (else ``default_index``), ``target-type`` (else
    ``doc``) and ``ignore-no-primary-key``.  Rows without a route are dropped."""

    def target(r: dict) -> Column:
        index = option(r, "target-index", str, "")
        return F.struct(
            (F.lit(index) if index else default_index).alias("index"),
            F.lit(option(r, "target-type", str, "doc")).alias("doc_type"),
            F.lit(option(r, "ignore-no-primary-key", bool, False)).alias("ignore_without_key"),
        )

    if not routes:
        return df.withColumns({"index": F.lit(""), "doc_type": F.lit(""), "ignore_without_key": F.lit(False)}).where("false")
    return df.withColumn("_t", first_match(routes, target)).where("_t is not null").withColumns({c: F.col(f"_t.{c}") for c in ("index", "doc_type", "ignore_without_key")}).drop("_t")


def route_models(df: DataFrame, models: Sequence[dict]) -> DataFrame:
    """One row for each matching model, each model at most once a message."""
    by_name: dict[str, Column] = {}
    for m in models:
        by_name[m["name"]] = by_name[m["name"]] | matcher(m) if m["name"] in by_name else matcher(m)
    if not by_name:
        return df.withColumn("model", F.lit(None).cast("string")).where("false")
    hits = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in by_name.items()])
    return df.withColumn("model", F.explode(F.array_compact(hits)))
