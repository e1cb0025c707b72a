"""Running results over long ordered streams without one task a stream.

A window over a stream puts all of it into one task.  Where the longest stream
is short (PLAIN rows), that is the cheapest plan and is used.  Else a stream
is cut into bins of its order column: windows run within (stream, bin), bins
are summed up, and only these sums, a row a bin and stream, are put in order
per stream.  Bins hold about equally many rows, as their bounds are quantiles
of the order column, so neither gaps nor outliers fill one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLAIN = 1_000_000  # rows of the longest stream up to which it is one window
ROWS = 250_000  # rows a bin holds, about
MOST_BINS = 50_000


def quantile_bounds(df: DataFrame, by: Column, bins: int) -> list[float]:
    """At most ``bins`` - 1 numbers between which about equally many rows lie."""
    if bins < 2:
        return []
    at = [i / bins for i in range(1, bins)]
    found = df.agg(F.percentile_approx(by.cast("double"), at, max(10_000, 4 * bins)).alias("q")).first()["q"]
    return sorted({x for x in found or [] if x == x})


def binned(df: DataFrame, by: Column, bins: int) -> DataFrame:
    """Adds _bin: which range between the quantiles of ``by`` a row is in;
    nulls come first.  The bounds are searched in the JVM, by halves."""
    bounds = quantile_bounds(df, by, bins)
    value = by.cast("double")
    if not bounds:
        return df.withColumn("_bin", F.when(value.isNull(), -1).otherwise(0))
    from pyspark.ml.feature import Bucketizer

    cutter = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="_by", outputCol="_bin", handleInvalid="keep")
    cut = cutter.transform(df.withColumn("_by", value))
    return cut.withColumn("_bin", F.when(F.col("_by").isNull(), -1).otherwise(F.col("_bin").cast("int"))).drop("_by")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], by: Column, bins: int | None = None, **wanted: tuple) -> DataFrame:
    """Adds a column for each of ``wanted``, in the order of ``order`` within
    ``keys`` (null keys are a stream of their own, no keys: one stream):

    ``("row_number",)``; ``("sum", column)``, a running sum with the row, null
    counts as 0; ``("last", column)``, the last non-null value up to the row;
    ``("lag", column)``, the value of the row before, null for the first.

    ``by`` is a number that never falls along the order.  Equal positions in
    ``order`` are put in any order, so it should name a row.  ``bins`` forces
    that many; without it streams are counted first.
    """
    if bins is None:
        counts = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("n"))
        longest, rows = counts.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        bins = 1 if longest <= PLAIN else min(MOST_BINS, math.ceil(rows / ROWS))
    if bins <= 1:
        return _windowed(df, keys, order, wanted)
    d = binned(df, by, bins).withColumn("_key", F.struct(*keys) if keys else F.struct(F.lit(0))).repartition("_key", "_bin")
    local = Window.partitionBy("_key", "_bin").orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct(*order)
    mine, sums, before, final = {}, [], {}, {}
    past = Window.partitionBy("_key").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    prev = Window.partitionBy("_key").orderBy("_bin")
    mine["_rn"] = F.row_number().over(local)
    for name, (kind, *arg) in wanted.items():
        m, s, b = f"_m_{name}", f"_s_{name}", f"_b_{name}"
        if kind == "row_number":
            sums.append(F.count(F.lit(1)).alias(s))
            before[b] = F.coalesce(F.sum(s).over(past), F.lit(0))
            final[name] = (F.col("_rn") + F.col(b)).cast("bigint")
        elif kind == "sum":
            value = F.coalesce(arg[0], F.lit(0))
            mine[m] = F.sum(value).over(upto)
            sums.append(F.sum(value).alias(s))
            before[b] = F.coalesce(F.sum(s).over(past), F.lit(0))
            final[name] = F.col(m) + F.col(b)
        elif kind == "last":
            mine[m] = F.last(arg[0], ignorenulls=True).over(upto)
            sums.append(F.max_by(arg[0], F.when(arg[0].isNotNull(), place)).alias(s))
            before[b] = F.last(s, ignorenulls=True).over(past)
            final[name] = F.coalesce(m, b)
        elif kind == "lag":
            boxed = F.struct(arg[0].alias("v"))
            mine[m] = F.lag(boxed).over(local)
            sums.append(F.max_by(boxed, place).alias(s))
            before[b] = F.lag(s).over(prev)
            final[name] = F.when(F.col("_rn") == 1, F.col(b)["v"]).otherwise(F.col(m)["v"])
        else:
            raise ValueError(f"unknown running result {kind!r}")
    per = d.groupBy("_key", "_bin").agg(*sums).withColumns(before).select("_key", "_bin", *before)
    return d.withColumns(mine).join(per, ["_key", "_bin"]).select(*df.columns, *[c.alias(n) for n, c in final.items()])


def _windowed(df: DataFrame, keys: Sequence[str], order: Sequence[str], wanted: dict[str, tuple]) -> DataFrame:
    """The same for streams short enough to be one window each."""
    if not keys:
        df, keys = df.withColumn("_all", F.lit(0)), ["_all"]
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for name, (kind, *arg) in wanted.items():
        if kind == "row_number":
            out[name] = F.row_number().over(w).cast("bigint")
        elif kind == "sum":
            out[name] = F.sum(F.coalesce(arg[0], F.lit(0))).over(upto)
        elif kind == "last":
            out[name] = F.last(arg[0], ignorenulls=True).over(upto)
        elif kind == "lag":
            out[name] = F.lag(arg[0]).over(w)
        else:
            raise ValueError(f"unknown running result {kind!r}")
    return df.withColumns(out).drop("_all")
