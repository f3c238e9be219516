import time

import pytest
from pyspark.sql import functions as F

from quantloom.llm import common


class Conf:
    def __init__(self, **told):
        self.told = told

    def get(self, key, default=None):
        return self.told.get(key.replace(".", "_"), default)


class Session:
    def __init__(self, **told):
        self.conf = Conf(**told)


def test_a_cluster_needs_a_shared_folder():
    assert common.shared_dir(Session(spark_checkpoint_dir="hdfs://a/b/", spark_master="yarn")) == "hdfs://a/b"
    for master in ("local", "local[*]", "local[4, 2]"):
        assert common.shared_dir(Session(spark_master=master)).startswith("file:///")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", ""):
        with pytest.raises(ValueError):
            common.shared_dir(Session(spark_master=master))


def test_broadcasts_are_bounded_in_bytes(spark):
    df = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("s"), F.array("id", "id").alias("a"))
    assert 100 * 1000 < common.memory_bytes(df) < 100 * 1400
    assert common.small(df, 200_000) and not common.small(df, 100_000)
    assert common.memory_bytes(df.limit(0)) == 0


def test_stored_tables_leave_no_shuffle_files(spark):
    import glob

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    files = lambda: {f for d in glob.glob("/tmp/blockmgr-*") for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}
    had = files()
    out = common.store(spark.range(1000).repartition(3, "id"), "t")
    assert out.count() == 1000 and spark.conf.get(key) == before
    for _ in range(50):
        if not files() - had:
            break
        time.sleep(0.1)
    # counting shuffles too, and its files stay until Spark's cleaner finds them; those of the stored table are gone
    assert len(files() - had) <= 4
