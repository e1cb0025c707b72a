"""The shared folder and the tables stored in it."""

import pytest

from driftline import session
from driftline.operators.verify import barrier_stream
from driftline.streaming.changes import heartbeats


class Conf:
    def __init__(self, folder):
        self.folder = folder

    def get(self, _key, default=None):
        return self.folder or default


class FakeContext:
    def __init__(self, master, folder=None):
        self.master, self.folder, self.dir = master, folder, None

    def getConf(self):
        return Conf(self.folder)

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, d):
        self.dir = d


class FakeSession:
    def __init__(self, *a):
        self.sparkContext, self.conf = FakeContext(*a), Conf(None)


def test_no_folder_of_one_machine_on_a_cluster():
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,3000]"):
        with pytest.raises(ValueError):
            session.ensure_checkpoint_dir(FakeSession(master))
    assert session.ensure_checkpoint_dir(FakeSession("yarn", "hdfs://shared/dir")) == "hdfs://shared/dir"
    assert "driftline" in session.ensure_checkpoint_dir(FakeSession("local[4]"))


def test_stored_tables(spark):
    df = spark.createDataFrame([(1, None, [("a", 2)]), (2, "x", None)], "a int, b string, c array<struct<k:string,n:int>>")
    stored = session.cut(df)
    assert sorted(map(str, stored.collect())) == sorted(map(str, df.collect())) and stored.schema == df.schema
    assert session.stored_under(spark).partition(":")[2].lstrip("/") in stored.inputFiles()[0]
    assert session.cut(df.where("false")).count() == 0
    session.release(spark)
    assert session.cut(df).count() == 2


def test_endless_probes(spark):
    for df in (barrier_stream(spark), heartbeats(spark, "p")):
        assert df.isStreaming and "offset" in df.columns
