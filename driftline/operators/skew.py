"""Per-key results where a few keys hold most rows.

Value-frequency compression: rows are counted by (key, value) before they are
gathered by key.  The first shuffle is by key *and* value, with map-side
partial counts, so a hot key is spread over as many tasks as it has values and
repeated values travel once.  Exact distinct counts, modes and percentiles
follow from the weighted values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_frequencies(df: DataFrame, keys: Sequence[str], value: Column, *also: Column) -> DataFrame:
    """(keys, value, n, further aggregates).  A null value is a value of its own."""
    return df.select(*keys, value.alias("value"), *[c for c in df.columns if c not in keys and c != "value"]).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"), *also)


def from_frequencies(vf: DataFrame, keys: Sequence[str], *also: Column) -> DataFrame:
    """Exact per-key results of weighted values: ``n_rows``, ``n_distinct``
    (nulls don't count as a value), ``mode`` (the smallest of equally frequent
    values, null if all are) and ``mode_n``.  One aggregate that combines on
    the map side, so a hot key sends one row per task."""
    real = F.col("value").isNotNull()
    return vf.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"),
        F.count("value").alias("n_distinct"),
        F.min_by("value", F.when(real, F.struct(-F.col("n"), F.col("value")))).alias("mode"),
        F.max(F.when(real, F.col("n"))).alias("mode_n"),
        *also,
    )


def weighted_percentiles(vf: DataFrame, keys: Sequence[str], ps: Sequence[float], bins: int = 256) -> DataFrame:
    """(keys, p, value): exact discrete percentiles (the smallest value with at
    least p of the weight at or below it) of numeric values; nulls are left
    out, a key without values or with a null column gives no row.

    Values are cut into ``bins`` equal ranges between the key's least and
    greatest value.  Weights of whole bins (at most ``bins`` rows a key)
    decide the bin that holds the percentile; only the rows of such bins are
    ordered, in a window by (key, bin).  So no task sorts a whole hot key."""
    keys = list(keys)
    v = vf.where("value is not null")
    ends = v.groupBy(*keys).agg(F.min("value").cast("double").alias("_lo"), F.max("value").cast("double").alias("_hi"), F.sum("n").alias("_total"))
    width = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-300))
    binned = v.join(ends, keys).withColumn("_bin", F.least(F.floor((F.col("value").cast("double") - F.col("_lo")) / width * bins), F.lit(bins - 1)).cast("int"))
    per_bin = binned.groupBy(*keys, "_bin").agg(F.sum("n").alias("_w"), F.first("_total").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    per_bin = per_bin.withColumn("_before", F.coalesce(F.sum("_w").over(before), F.lit(0)))
    wanted = per_bin.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps]))).withColumn("_rank", F.greatest(F.ceil(F.col("p") * F.col("_total")), F.lit(1)))
    wanted = wanted.where("_rank > _before and _rank <= _before + _w").select(*keys, "_bin", "p", "_rank", "_before")
    inside = binned.select(*keys, "_bin", "value", "n").join(wanted.select(*keys, "_bin").distinct(), [*keys, "_bin"], "left_semi")
    upto = Window.partitionBy(*keys, "_bin").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_cum", F.sum("n").over(upto))
    return inside.join(wanted, [*keys, "_bin"]).where("_cum + _before >= _rank").groupBy(*keys, "p").agg(F.min("value").alias("value"))
