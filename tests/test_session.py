"""Where intermediate tables go."""

from types import SimpleNamespace

import pytest

from hearthline import session


def fake(master, named=None, current=None):
    made = []
    context = SimpleNamespace(
        master=master, getCheckpointDir=lambda: current, setCheckpointDir=made.append)
    conf = SimpleNamespace(get=lambda key, default: named)
    return SimpleNamespace(conf=conf, sparkContext=context), made


def test_the_named_folder_is_used():
    spark, made = fake("yarn", named="hdfs://shared/steps/")
    assert session.checkpoint_root(spark) == "hdfs://shared/steps/"
    first, second = (session.fresh_dir(spark, "x") for _ in range(2))
    assert first.startswith("hdfs://shared/steps/x-") and first != second
    assert made == []


def test_a_cluster_must_name_one():
    spark, _ = fake("yarn")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_root(spark)


def test_one_machine_gets_a_fresh_one():
    spark, made = fake("local[2]")
    root = session.checkpoint_root(spark)
    assert root.startswith("/tmp/run-") and made == [root]


def test_a_cut_table_is_read_back(spark):
    from pyspark.sql import functions as F

    df = spark.range(10).withColumn("r", F.rand())
    stored = session.cut_lineage(df)
    assert stored.dtypes == df.dtypes
    assert sorted(stored.collect()) == sorted(stored.collect())
