"""Reading tables, sizing partitions and storing what is read more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir where the cluster names one.
    Only a local session without one gets a temporary folder; on a cluster a
    folder of one machine would be lost to the others, so that is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="driftline-ckpt-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir() or folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read from there,
    for a result that is read more than once or a Python stage that must not
    be repeated.  It survives the loss of executors, readers take only the
    columns they need, and its size is known to later joins."""
    spark = df.sparkSession
    path = f"{stored_under(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_registered: set[str] = set()


def stored_under(spark: SparkSession) -> str:
    """Where the tables of this application lie; they go when it ends."""
    folder = f"{ensure_checkpoint_dir(spark)}/cut-{spark.sparkContext.applicationId}"
    if folder not in _registered:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _registered.add(folder)
    return folder


def release(spark: SparkSession) -> None:
    """Removes the stored tables of this application before it ends; call it when results are written."""
    folder = stored_under(spark)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _registered.discard(folder)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
