"""A target table on a shared folder that batches are merged into.

Rows lie in buckets of their keys.  A batch reads and writes the buckets that
its keys touch and no others; a manifest then names the version of each
bucket.  A batch that is run again begins from the manifest before it and
writes the same files again, so nothing is added twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Folder:
    """Small files and folders below a path of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, sub: str = "") -> list[str]:
        p = self._Path(f"{self.path}/{sub}" if sub else self.path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._Path(f"{self.path}/{name}"))
        try:
            return bytes(b & 0xFF for b in stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """A reader sees the whole file or none."""
        final, part = self._Path(f"{self.path}/{name}"), self._Path(f"{self.path}/{name}.tmp")
        out = self._fs.create(part, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self._fs.delete(final, False)
        self._fs.rename(part, final)

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._Path(f"{self.path}/{name}" if name else self.path), True)


class KeyedTable:
    """Rows by bucket of ``keys``.  ``buckets`` is a setting of the table:
    choose it so that a bucket is some hundred megabytes."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        self.folder = Folder(spark, path)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _batches(self) -> list[int]:
        return sorted(int(n.partition(".")[0]) for n in self.folder.names("manifest") if n.endswith(".json"))

    def current(self) -> int | None:
        """The last batch that was merged."""
        return max(self._batches(), default=None)

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """Bucket to the batch that wrote it last."""
        n = max((b for b in self._batches() if before is None or b < before), default=None)
        return {} if n is None else {int(k): v for k, v in json.loads(self.folder.read(f"manifest/{n}.json")).items()}

    def read(self, before: int | None = None, only: Sequence[int] | None = None) -> DataFrame | None:
        """All rows, or those of some buckets; None if nothing was written."""
        at = {b: v for b, v in self.manifest(before).items() if only is None or b in set(only)}
        paths = [p for v in sorted(set(at.values())) for p in self._paths(v, {b for b in at if at[b] == v})]
        return self.spark.read.parquet(*paths) if paths else None

    def _paths(self, version: int, buckets: set[int]) -> list[str]:
        there = {n for n in self.folder.names(f"v={version}")}
        return [f"{self.path}/v={version}/_bucket={b}" for b in sorted(buckets) if f"_bucket={b}" in there]

    def merge(self, batch: DataFrame, batch_id: int, fold: Callable[[DataFrame], DataFrame], keep: int = 3) -> list[int]:
        """Folds the rows of the buckets that ``batch`` touches together with
        it and returns their numbers.  At most ``buckets`` numbers are collected."""
        touched = sorted(r[0] for r in batch.select(self.bucket().alias("b")).distinct().collect())
        old = self.read(batch_id, touched)
        rows = fold(batch if old is None else old.unionByName(batch, allowMissingColumns=True))
        self.put(rows, touched, batch_id, keep)
        return touched

    def put(self, rows: DataFrame, touched: Sequence[int], batch_id: int, keep: int = 3) -> None:
        """Writes the whole content of some buckets."""
        before = self.manifest(batch_id)
        if touched:
            placed = rows.withColumn("_bucket", self.bucket())
            placed.repartition(min(len(touched), 4 * self.buckets), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/v={batch_id}")
        self.folder.write(f"manifest/{batch_id}.json", json.dumps({**before, **{b: batch_id for b in touched}}))
        done = self._batches()
        for old in done[: max(0, len(done) - keep)]:
            self.folder.delete(f"manifest/{old}.json")
        used = {v for b in self._batches() for v in json.loads(self.folder.read(f"manifest/{b}.json")).values()}
        for n in self.folder.names():
            if n.startswith("v=") and int(n[2:]) not in used and int(n[2:]) != batch_id:
                self.folder.delete(n)

    def reset(self) -> None:
        self.folder.delete()
