"""Staged copies and the shuffle files behind them."""

from pyspark.sql import functions as F

from readsift import session


def _shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "/shuffle_" in f}


def test_a_staged_copy_leaves_no_shuffle_files(spark):
    df = spark.range(1000).withColumn("h", F.xxhash64("id")).repartition("h").groupBy("h").count()
    before = _shuffle_files(spark)
    staged = session.stage(df)
    assert not _shuffle_files(spark) - before
    assert staged.count() == 1000
    assert df.count() == 1000 and session.stage(df).count() == 1000


def test_writes_side_by_side_put_the_setting_back(spark):
    was = spark.conf.get(session._CLEANUP)
    with session._shuffles_go_at_the_end(spark):
        with session._shuffles_go_at_the_end(spark):
            assert spark.conf.get(session._CLEANUP) == "true"
        assert spark.conf.get(session._CLEANUP) == "true"
    assert spark.conf.get(session._CLEANUP) == was
    made = session.in_threads([lambda: session.stage(spark.range(50).repartition(3)).count()] * 4, spark, 4)
    assert made == [50] * 4 and spark.conf.get(session._CLEANUP) == was
