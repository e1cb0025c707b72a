"""Exactly one copy of messages that were delivered at least once.

A Bloom filter for each time bucket screens identifiers that are definitely
new; the rest, possible repeats, is verified exactly against the stored
messages of the matching buckets only.

The filter is register-blocked: an identity sets four bits of one 64-bit word,
so a filter is rows (word, bucket, bits) made by ``bit_or`` with map-side
combine, and probing is an equi-join on the word.  Nothing is broadcast by
hand: the filter grows with the data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.session import cut

_ID = r"([0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12})[^0-9a-f]*:\s*0*([0-9]+)\s*$"
IDS_PER_WORD = 4


def gtid(c: Column) -> Column:
    """``uuid:number`` in one spelling (lower case, no dashes, no leading
    zeros); null where the text names no server UUID and number."""
    low = F.lower(c)
    uuid, number = F.regexp_extract(low, _ID, 1), F.regexp_extract(low, _ID, 2)
    return F.when(uuid != "", F.concat_ws(":", F.translate(uuid, "-", ""), number))


def _hashed(df: DataFrame, n_words: int) -> DataFrame:
    """Adds _h (identity hash), _w (word of the filter) and _m (its bits)."""
    h2 = F.xxhash64(F.lit("bits"), "_tag", "_id")
    bit = lambda k: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(_h2, {6 * k}) & 63 as int))")
    mask = bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).bitwiseOR(bit(3))
    return (
        df.withColumn("_h", F.xxhash64("_tag", "_id"))
        .withColumn("_h2", h2)
        .withColumns({"_w": F.pmod(F.col("_h"), F.lit(n_words)), "_m": mask})
        .drop("_h2")
    )


def _identified(df: DataFrame, record: str, msg_id: Column, tag: Column, at: Column) -> DataFrame:
    """(_rec, _id, _tag, _at); a null tag is a tag of its own."""
    return df.select(F.col(record).alias("_rec"), gtid(msg_id).alias("_id"), F.coalesce(F.concat(F.lit("t"), tag.cast("string")), F.lit("")).alias("_tag"), at.cast("bigint").alias("_at"))


def bloom_filter(hashed: DataFrame) -> DataFrame:
    """(_w, _b, bits): one Bloom filter for each time bucket _b."""
    return hashed.groupBy("_w", "_b").agg(F.bit_or("_m").alias("bits"))


def repeated_records(df: DataFrame, record: str, msg_id: Column, tag: Column, at: Column, bucket_s: int = 3600, max_buckets: int = 64) -> DataFrame:
    """Every record that is a later copy and has to go.

    Records are copies if ``tag`` is equal and ``msg_id`` names the same
    server UUID and number.  The copy with the smallest ``at`` stays, nulls
    last, then the one with the smallest ``record``.  Records without a
    readable id are never copies; a null tag is a tag of its own.  Returns
    ``record`` and the ``kept`` record; a table without copies gives no rows.

    ``at`` (epoch seconds) is cut into buckets of ``bucket_s``, folded onto
    ``max_buckets``; all buckets are compared, so no horizon hides a copy.
    """
    ids = _identified(df, record, msg_id, tag, at).where("_id is not null")
    n_words = max(64, 2 ** math.ceil(math.log2(max(1, df.count()) / IDS_PER_WORD)))
    bucket = F.coalesce(F.pmod(F.floor(F.col("_at") / bucket_s), F.lit(max_buckets)), F.lit(-1)).cast("int")
    hashed = _hashed(ids.withColumn("_b", bucket), n_words)
    # one narrow row an identity and bucket: a hot identity collapses on the map side
    seen = cut(hashed.groupBy("_w", "_b", "_h", "_m").agg(F.count(F.lit(1)).alias("_n")))
    filters = bloom_filter(seen).groupBy("_w").agg(F.collect_list(F.struct("_b", "bits")).alias("_f"))
    elsewhere = F.exists("_f", lambda f: (f["_b"] != F.col("_b")) & (f["bits"].bitwiseAND(F.col("_m")) == F.col("_m")))
    twice = seen.where("_n > 1").select("_b", "_h")
    screened = seen.where("_n = 1").join(filters, "_w").where(elsewhere).select("_b", "_h")
    # only what the filters couldn't clear is read with its whole identity
    possible = cut(hashed.join(twice.unionByName(screened), ["_b", "_h"], "left_semi").select("_rec", "_id", "_tag", "_at"))
    first = possible.groupBy("_tag", "_id").agg(F.min_by("_rec", F.struct(F.col("_at").isNull(), "_at", "_rec")).alias("kept"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return possible.join(first, ["_tag", "_id"]).where("_rec <> kept").select(F.col("_rec").alias(record), "kept")


class MessageStore:
    """Identities seen so far, on a shared folder, for batches that arrive one
    after another (``foreachBatch``): ``ids`` holds (tag, id) in a folder for
    each time bucket, ``filters`` the Bloom words of each bucket.  A batch
    reads the filters, then ids of the buckets alone that they name.  A batch
    that was applied before (same ``batch_id``) is read from the store again,
    not applied twice.  Here the first copy delivered stays, as a later one
    cannot call back what was passed on.  ``compact`` joins the files of many
    batches; run it every some dozens of batches."""

    def __init__(self, path: str, n_words: int = 1 << 20, bucket_s: int = 3600):
        self.path, self.n_words, self.bucket_s = path.rstrip("/"), n_words, bucket_s

    def _folders(self, spark: SparkSession, kind: str) -> dict[int, str]:
        """Number to folder of the whole ones below ``kind``."""
        jvm = spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return {}
        names = [x.getPath().getName() for x in fs.listStatus(top)]
        return {int(n.partition("=")[2]): f"{self.path}/{kind}/{n}" for n in names if "=" in n and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{n}/filters/_SUCCESS"))}

    def _stored(self, spark: SparkSession, before: int) -> tuple[DataFrame, DataFrame]:
        """(ids, filters) of all batches but those from ``before`` on."""
        base = self._folders(spark, "base")
        upto = max((n for n in base if n < before), default=None)
        parts = ([base[upto]] if upto is not None else []) + [p for n, p in sorted(self._folders(spark, "batch").items()) if n < before and (upto is None or n > upto)]
        ids = spark.createDataFrame([], "_tag string, _id string, _h bigint, _b bigint")
        filters = spark.createDataFrame([], "_w bigint, _b bigint, bits bigint")
        for p in parts:
            ids = ids.unionByName(spark.read.schema("_tag string, _id string, _h bigint, _b bigint").parquet(f"{p}/ids"))
            filters = filters.unionByName(spark.read.schema("_w bigint, _b bigint, bits bigint").parquet(f"{p}/filters"))
        return ids, filters

    def _write(self, ids: DataFrame, folder: str) -> DataFrame:
        """Buckets are folders, filters are made from what was written; their success tells that all is whole."""
        spark = ids.sparkSession
        ids.select("_tag", "_id", "_h", "_b").repartition("_b", F.pmod("_h", F.lit(16))).write.mode("overwrite").partitionBy("_b").parquet(f"{folder}/ids")
        kept = spark.read.schema("_tag string, _id string, _h bigint, _b bigint").parquet(f"{folder}/ids")
        _hashed(kept, self.n_words).groupBy("_w", "_b").agg(F.bit_or("_m").alias("bits")).write.mode("overwrite").parquet(f"{folder}/filters")
        return kept

    def matching(self, stored: DataFrame, filters: DataFrame, hashed: DataFrame) -> DataFrame:
        """Stored ids of the buckets that the filters name for ``hashed``.
        Bucket numbers, one an hour or so of data, are collected, so only
        their folders are listed and read."""
        named = cut(filters.withColumnRenamed("_b", "_sb").join(hashed.select("_w", "_h", "_m"), "_w").where(F.col("bits").bitwiseAND(F.col("_m")) == F.col("_m")).select(F.col("_sb").alias("_b"), "_h").distinct())
        buckets = [r[0] for r in named.select("_b").distinct().collect()]
        return stored.where(F.col("_b").isin(buckets)).join(named, ["_b", "_h"], "left_semi")

    def new_messages(self, batch: DataFrame, record: str, msg_id: Column, tag: Column, at: Column, batch_id: int) -> DataFrame:
        """Rows of ``batch`` that were not delivered before, one of each."""
        spark = batch.sparkSession
        ids = _identified(batch, record, msg_id, tag, at)
        known = ids.where("_id is not null")
        first = known.groupBy("_tag", "_id").agg(F.min(F.struct(F.col("_at").isNull(), "_at", "_rec")).alias("_s")).select("_tag", "_id", F.col("_s._rec").alias("_rec"), F.coalesce(F.floor(F.col("_s._at") / self.bucket_s), F.lit(-1)).cast("bigint").alias("_b"))
        hashed = _hashed(first, self.n_words)
        stored, filters = self._stored(spark, batch_id)
        repeats = self.matching(stored, filters, hashed).select("_tag", "_id").distinct()
        kept = self._write(hashed.join(repeats, ["_tag", "_id"], "left_anti"), f"{self.path}/batch/batch_id={batch_id}")
        out = first.join(kept.select("_tag", "_id"), ["_tag", "_id"], "left_semi").select("_rec").unionByName(ids.where("_id is null").select("_rec"))
        return batch.join(out.withColumnRenamed("_rec", record), record, "left_semi")

    def compact(self, spark: SparkSession, upto: int) -> None:
        """Joins all batches up to ``upto``, which can't come again, into one
        base with one set of files a bucket, and removes theirs."""
        stored, _ = self._stored(spark, upto + 1)
        old = {**{("batch", n): p for n, p in self._folders(spark, "batch").items() if n <= upto}, **{("base", n): p for n, p in self._folders(spark, "base").items() if n < upto}}
        self._write(stored, f"{self.path}/base/upto={upto}")
        for p in old.values():
            gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
            gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
