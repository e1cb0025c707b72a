"""Snapshot scans, ranges and the handover from snapshot to log."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.glob import glob_matches
from driftline.functions.mysql_types import mysql_type
from driftline.operators.apply import replace_rows


def discover(tables: Sequence[tuple[str, str]], schema: str, patterns: Sequence[str], ignore: Sequence[str] = ()) -> list[tuple[str, str]]:
    """Tables of a schema that match a glob and aren't ignored (names of a
    catalogue, so on the driver)."""
    return [t for t in tables if t[0] == schema and any(glob_matches(t[1], p) for p in patterns) and not any(glob_matches(t[1], p) for p in ignore)]


def scan_columns(primary: Sequence[str], unique: Sequence[Sequence[str]], rows: int, full_dump_limit: int) -> list[str]:
    """Columns to cut a scan by: the primary key, else a unique index of one
    column, else none if the table is small enough to read at once."""
    if primary:
        return list(primary)
    for u in unique:
        if len(u) == 1:
            return list(u)
    if rows < full_dump_limit:
        return []
    raise ValueError("no key to scan by and too many rows for a full dump")


def key_bounds(df: DataFrame, key: Sequence[str], where: str | None = None) -> DataFrame:
    """One row with the least and greatest key in lexicographic order."""
    df = df.where(where) if where else df
    k = F.struct(*key)
    return df.agg(F.min(k).alias("lo"), F.max(k).alias("hi")).select(*[F.col(f"lo.{c}").alias(f"min_{c}") for c in key], *[F.col(f"hi.{c}").alias(f"max_{c}") for c in key])


def page_after(df: DataFrame, key: Sequence[str], last: Sequence | None, size: int, collation: str | None = None) -> DataFrame:
    """The next page of a keyset scan.  The first column's bound is stated
    beside the lexicographic one so that it reaches the file scan.  With a
    ``collation`` (such as UTF8_LCASE) text columns compare and sort by it."""
    if collation:
        text = {k for k in key if dict(df.dtypes)[k].startswith("string")}
        by = lambda c, k: F.collate(c, collation) if k in text else c
        if last is not None:
            at, out = F.lit(False), F.lit(True)
            for k, v in zip(key, last):
                at = at | (out & (by(F.col(k), k) > by(F.lit(v), k)))
                out = out & (by(F.col(k), k) == by(F.lit(v), k))
            df = df.where(at)
        return df.orderBy(*[by(F.col(k), k) for k in key]).limit(size)
    if last is not None:
        df = df.where((F.col(key[0]) >= F.lit(last[0])) & (F.struct(*key) > F.struct(*[F.lit(v).alias(k) for k, v in zip(key, last)])))
    return df.orderBy(*key).limit(size)


def full_scan(df: DataFrame, key: Sequence[str], size: int, start: Sequence | None = None) -> Iterator[tuple[list, DataFrame]]:
    """Pages of a whole table in the order of its key, each with the key it
    ends with (the position from which a scan can go on), for a source that
    gives only pages.  Where Spark reads the table itself, ranged_scan reads
    all ranges at once."""
    last = start
    while True:
        page = page_after(df, key, last, size).persist()
        ends = page.orderBy(*[F.desc(k) for k in key]).select(*key).first()
        if ends is None:
            page.unpersist()
            return
        last = list(ends)
        yield last, page
        page.unpersist()


def resume(df: DataFrame, key: Sequence[str], current: Sequence | None) -> DataFrame:
    """What is left of a table's scan: rows from the current key on, which is
    read once more, as it may not have been written."""
    if current is None:
        return df
    return df.where((F.col(key[0]) >= F.lit(current[0])) & (F.struct(*key) >= F.struct(*[F.lit(v).alias(k) for k, v in zip(key, current)])))


def ranged_scan(df: DataFrame, key: Sequence[str], parts: int) -> DataFrame:
    """The whole table in key ranges, each sorted; bounds are half-open, so no
    row comes twice."""
    return df.repartitionByRange(parts, *key).sortWithinPartitions(*key)


def chunk_bounds(df: DataFrame, key: str, chunks: int) -> DataFrame:
    """(chunk, n, lo, hi): equi-depth ranges of a unique numeric key, exact.

    Ranks need no window over the whole table: rows are counted per bin of the
    key (4096 bins), bins get their first rank from a running sum over at most
    4096 rows, and rows are ranked within their bin."""
    from pyspark.sql import Window

    ends = df.agg(F.min(key).cast("double").alias("lo"), F.max(key).cast("double").alias("hi"), F.count(key).alias("total"))
    lo, hi, total = ends.select("lo").scalar(), ends.select("hi").scalar(), ends.select("total").scalar()
    b = F.least(F.floor((F.col(key) - lo) / F.greatest(hi - lo, F.lit(1e-9)) * 4096), F.lit(4095))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), b.alias("b"))
    bins = rows.groupBy("b").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("k"))).join(bins.select("b", "before"), "b")
    at = F.col("r") + F.col("before") - 1
    base, extra = F.floor(total / chunks), total % chunks
    wide = extra * (base + 1)
    chunk = F.when(at < wide, F.floor(at / (base + 1))).otherwise(extra + F.floor((at - wide) / F.greatest(base, F.lit(1)))) + 1
    return ranked.withColumn("chunk", chunk.cast("bigint")).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"))


def is_empty(df: DataFrame, where: str | None = None) -> bool:
    """Looks for one row only."""
    return (df.where(where) if where else df).isEmpty()


def sampled_bounds(df: DataFrame, key: str, chunks: int, sample: float = 0.05, threshold: int = 50_000) -> list:
    """Inner bounds of about equal chunks from a sample of a numeric key: at
    most ``chunks`` - 1 numbers.  Tables under the threshold are one chunk.
    Ranges are [lower, upper), so no row is in two chunks."""
    if chunks < 2 or df.limit(threshold + 1).count() <= threshold:
        return []
    at = [i / chunks for i in range(1, chunks)]
    row = df.where(F.col(key).isNotNull()).sample(sample, seed=1).agg(F.percentile_approx(key, at, 10_000).alias("q")).first()
    return sorted(set(row.q or []))


def table_message(name: str, df: DataFrame, key: Sequence[str] = ()) -> str:
    """The statement that makes a table for a snapshot, told before its rows."""
    cols = [f"`{f.name}` {mysql_type(f.dataType, f.name in key)}" for f in df.schema]
    tail = [f"PRIMARY KEY ({', '.join(f'`{k}`' for k in key)})"] if key else []
    return f"CREATE TABLE IF NOT EXISTS `{name}` ({', '.join(cols + tail)})"


def replicate(snapshot: DataFrame, changes: DataFrame, start: int, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Snapshot first, then the log after the position taken before the scan."""
    first = snapshot.select(*keys, *columns).withColumns({"op": F.lit("insert"), order: F.lit(-1).cast("bigint")})
    later = changes.where(F.col(order) > start).select(*keys, *columns, "op", F.col(order).cast("bigint").alias(order))
    return replace_rows(first.unionByName(later), keys, order, columns)


def lookup(changes: DataFrame, current: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Attaches the current document of each update; gone ones give null."""
    return changes.join(current.select(*keys, column), list(keys), "left")
