"""Mixing sources to target weights.

Tokens are summed per source; the wanted tokens of a source over those it has
give its repetition rate, at most ``max_repeat``.  Each document comes out
floor(rate) times, and once more if its seeded hash falls below the fraction,
so a mix needs no shuffle of documents and is the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_SPECS = 100_000


def source_tokens(sized: DataFrame) -> DataFrame:
    """(source, source_tokens, docs)."""
    return sized.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count(F.lit(1)).alias("docs"))


def rates(per_source: DataFrame, specs: DataFrame) -> DataFrame:
    """Specs with wanted_tokens, source_tokens (0 where a source has no
    documents) and rate.  A source listed twice in a mix is one listing with
    the sum of its shares and the larger max_repeat and corpus_fraction."""
    total = per_source.agg(F.coalesce(F.sum("source_tokens"), F.lit(0))).scalar()
    once = specs.groupBy("mix_id", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeat").alias("max_repeat"), F.max("corpus_fraction").alias("corpus_fraction"))
    wanted = F.col("corpus_fraction") * total * F.col("target_share")
    joined = once.join(per_source, "source", "left")
    have = F.coalesce("source_tokens", F.lit(0))
    rate = F.when(have > 0, F.least(F.col("max_repeat").cast("double"), F.greatest(wanted / have, F.lit(0.0)))).otherwise(0.0)
    return joined.select("mix_id", "source", "target_share", "max_repeat", wanted.alias("wanted_tokens"), have.alias("source_tokens"), F.coalesce(rate, F.lit(0.0)).alias("rate"))


def unit_hash(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) from a seeded hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") / float(1 << 53)


def mix(sized: DataFrame, rated: DataFrame, seed: int = 17) -> DataFrame:
    """(mix_id, source, doc_id, copy, n_tokens), copies from 1.

    Documents of a null source, or of one that no mix names, are in no mix.
    ``rated`` has one
    row a mix and source (checked against MAX_SPECS) and is broadcast, so hot
    sources aren't gathered anywhere.
    """
    if rated.limit(MAX_SPECS + 1).count() > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} mix specs")
    r = F.broadcast(rated.where("rate > 0").select("mix_id", "source", "rate"))
    whole = F.floor("rate").cast("int")
    extra = F.when(unit_hash(seed, F.col("mix_id"), F.col("doc_id")) < F.col("rate") - whole, 1).otherwise(0)
    counted = sized.join(r, "source").withColumn("_n", whole + extra).where("_n > 0")
    return counted.select("mix_id", "source", "doc_id", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"), "n_tokens")


def share_report(mixed: DataFrame, rated: DataFrame) -> DataFrame:
    """Per mix and source: wanted and reached tokens, target and reached share, most copies of a document."""
    got = mixed.groupBy("mix_id", "source").agg(F.sum("n_tokens").alias("tokens"), F.max("copy").alias("most_copies"))
    totals = got.groupBy("mix_id").agg(F.sum("tokens").alias("mix_tokens"))
    out = rated.join(got, ["mix_id", "source"], "left").join(totals, "mix_id", "left")
    tokens = F.coalesce("tokens", F.lit(0))
    return out.select("mix_id", "source", "target_share", "max_repeat", "wanted_tokens", "source_tokens", "rate", tokens.alias("tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.when(F.coalesce("mix_tokens", F.lit(0)) > 0, tokens / F.col("mix_tokens")).otherwise(0.0).alias("reached_share"))
