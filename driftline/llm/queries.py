"""Queries of the problems on documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import garbled, mixing, packing, tokens
from driftline.session import cut, table


def _sized(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their sizes, tokenized once."""
    docs = table(spark, d, "documents")
    return cut(tokens.with_token_counts(docs, F.col("text"), ["doc_id", "lang", "source"]))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """Where each piece of each document lies, for every pack of pack_specs."""
    return packing.pack(_sized(spark, d), table(spark, d, "pack_specs"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers and unused share of each pack."""
    return packing.container_report(p7_packed(spark, d))


def _rated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = _sized(spark, d)
    return sized, cut(mixing.rates(mixing.source_tokens(sized), table(spark, d, "mix_specs")))


def p8_mixed(spark: SparkSession, d: str) -> DataFrame:
    """Every copy of every document in every mix of mix_specs."""
    return mixing.mix(*_rated(spark, d))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share each source reaches in each mix."""
    sized, rated = _rated(spark, d)
    return mixing.share_report(mixing.mix(sized, rated), rated)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with three or more characters spoilt by a wrong encoding."""
    return garbled.garbled_documents(table(spark, d, "documents").select("doc_id", "text"), repairs=False).select("doc_id")


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    """Their original text where it can be had."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return garbled.restored_documents(docs, garbled.garbled_documents(docs))


QUERIES = {f.__name__: f for f in (p7_packed, p7_report, p8_mixed, p8_shares, p9_found, p9_restored)}
SQL: dict[str, str] = {}
