"""Does a target hold what the source holds?"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.times import micros
from driftline.operators.ordering import running


def range_counts(source: DataFrame, target: DataFrame, key: str, width: int) -> DataFrame:
    """(b, src, tgt, diff) of key ranges whose counts differ.  One pass over
    each side; nulls in the key aren't counted."""
    count = lambda df, n: df.where(F.col(key).isNotNull()).groupBy(F.floor(F.col(key) / width).cast("bigint").alias("b")).agg(F.count(F.lit(1)).alias(n))
    joined = count(source, "src").join(count(target, "tgt"), "b", "full_outer").na.fill(0, ["src", "tgt"])
    return joined.withColumn("diff", F.col("tgt") - F.col("src")).where("diff <> 0")


def bisect_counts(source: DataFrame, target: DataFrame, key: str, lo: int, width: int, levels: int) -> DataFrame:
    """(lvl, b, lo, hi, src, tgt, diff) of all ranges of a bisection whose
    counts differ, from one count of the finest ranges rolled up."""
    fine = width >> levels
    count = lambda df, n: df.where(F.col(key).isNotNull()).groupBy(F.floor((F.col(key) - lo) / fine).cast("bigint").alias("b")).agg(F.count(F.lit(1)).alias(n))
    both = count(source, "src").join(count(target, "tgt"), "b", "full_outer").na.fill(0, ["src", "tgt"])
    spread = both.withColumn("lvl", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("b", F.expr(f"shiftright(b, {levels} - lvl)"))
    per = spread.groupBy("lvl", "b").agg(F.sum("src").alias("src"), F.sum("tgt").alias("tgt")).withColumn("diff", F.col("tgt") - F.col("src")).where("diff <> 0")
    size = F.expr(f"shiftright({width}L, lvl)")
    return per.withColumns({"lo": F.lit(lo) + F.col("b") * size, "hi": F.lit(lo) + (F.col("b") + 1) * size - 1}).select("lvl", "b", "lo", "hi", "src", "tgt", "diff")


def _ancestors(ranges: DataFrame) -> DataFrame:
    """Each range with every wider range around it (_lvl, _b), a row a level."""
    wider = F.when(F.col("lvl") > 0, F.sequence(F.lit(0), F.col("lvl") - 1)).otherwise(F.array().cast("array<int>"))
    return ranges.withColumn("_lvl", F.explode(wider)).withColumn("_b", F.expr("shiftright(b, lvl - _lvl)"))


def visited_ranges(ranges: DataFrame, narrow: int = 10, few: int = 20, small: int = 10) -> DataFrame:
    """The ranges that a bisection from the widest one looks at: it goes on
    below a range whose counts differ, unless the range holds fewer than
    ``narrow`` numbers more than one or both counts are below ``few``, and its
    signed difference is below ``small``."""
    stops = (((F.col("hi") - F.col("lo") < narrow) | ((F.col("src") < few) & (F.col("tgt") < few))) & (F.col("diff") < small)) | (F.col("lo") == F.col("hi"))
    split = ranges.where(~stops).select(F.col("lvl").alias("_lvl"), F.col("b").alias("_b"))
    above = _ancestors(ranges).join(split, ["_lvl", "_b"]).groupBy("lvl", "b").agg(F.count(F.lit(1)).alias("_n"))
    return ranges.join(above, ["lvl", "b"], "left").where(F.coalesce("_n", F.lit(0)) == F.col("lvl")).drop("_n")


def prune_ranges(ranges: DataFrame) -> DataFrame:
    """Drops a range if any range within it, on whatever level, has the same
    difference: each range names the wider ones around it, at most one a
    level, so no ranges are compared pairwise."""
    inner = _ancestors(ranges).select(F.col("_lvl").alias("lvl"), F.col("_b").alias("b"), "diff").distinct()
    return ranges.join(inner, ["lvl", "b", "diff"], "left_anti")


def table_set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Names only one of two catalogues has."""
    return a.select("name").exceptAll(b.select("name")).withColumn("side", F.lit("source")).unionByName(b.select("name").exceptAll(a.select("name")).withColumn("side", F.lit("target")))


def table_checksum(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(n, sum_lo, sum_hi): count and additive hash of all rows, each value
    with its place so that nulls and shifted values count."""
    h = F.xxhash64(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in columns]))
    return df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))).alias("sum_lo"), F.sum(F.shiftrightunsigned("h", 32)).alias("sum_hi"))


def segments(messages: DataFrame, tag: str, seq: str, barrier: str) -> DataFrame:
    """Adds ``seg``: the last barrier before each message of its tag; messages
    before the first barrier have none."""
    return running(messages, [tag], [seq], F.col(seq), seg=("last", F.col(barrier)))


def barrier_errors(messages: DataFrame, tag: str, seq: str, barrier: str) -> DataFrame:
    """(tag, seq, error): the first message of a tag that is no barrier
    (``no first barrier``), and barriers that aren't one above the barrier
    before them in their tag (``jump``)."""
    seen = running(messages.select(tag, seq, barrier), [tag], [seq], F.col(seq), _n=("row_number",), _last=("last", F.col(barrier)))
    seen = running(seen, [tag], [seq], F.col(seq), _before=("lag", F.col("_last")))
    error = F.when((F.col("_n") == 1) & F.col(barrier).isNull(), "no first barrier").when(F.col(barrier) != F.col("_before") + 1, "jump")
    return seen.select(tag, seq, error.alias("error")).where("error is not null")


def barriers(spark: SparkSession, first: int, last: int, start: datetime, every_s: float = 1.0) -> DataFrame:
    """(id, offset, ts): what a barrier generator writes, a counter that is one
    higher each tick."""
    micros_each = int(every_s * 1_000_000)
    at = F.timestamp_micros(F.lit(int(start.timestamp() * 1_000_000)) + (F.col("id") - first) * micros_each)
    return spark.range(first, last + 1).select(F.lit(1).alias("_id"), F.col("id").alias("offset"), at.alias("ts")).withColumnRenamed("_id", "id")


def barrier_stream(spark: SparkSession, per_second: int = 1, first: int = 0) -> DataFrame:
    """The same as an endless stream."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return ticks.select(F.lit(1).alias("id"), (F.col("value") + first).alias("offset"), F.col("timestamp").alias("ts"))


def compare_segments(source: DataFrame, target: DataFrame) -> DataFrame:
    """(seg, verdict): same, diff or timeout (a segment the target lacks).
    Within a segment each payload's checksums are compared place by place in
    the order of (ts, id), so no payload's messages are gathered into one row.
    Inputs: seg, payload_id, ts, id, checksum; null checksums are equal."""

    def placed(df: DataFrame) -> DataFrame:
        time = F.col("ts").cast("double") if dict(df.dtypes)["ts"] not in ("timestamp", "timestamp_ntz") else micros("ts")
        return running(df.select("seg", "payload_id", "ts", "id", "checksum"), ["seg", "payload_id"], ["ts", "id"], time, place=("row_number",)).drop("ts", "id")

    keys = ["seg", "payload_id", "place"]
    a, b = placed(source).alias("a"), placed(target).alias("b")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    both = a.join(b, on, "full_outer")
    equal = F.col("a.place").isNotNull() & F.col("b.place").isNotNull() & F.col("a.checksum").eqNullSafe(F.col("b.checksum"))
    per = both.groupBy(F.when(F.col("a.place").isNotNull(), F.col("a.seg")).otherwise(F.col("b.seg")).alias("seg")).agg(F.bool_and(equal).alias("ok"), F.max(F.col("b.place").isNotNull()).alias("there"))
    return per.select("seg", F.when(~F.col("there"), "timeout").when(F.col("ok"), "same").otherwise("diff").alias("verdict"))
