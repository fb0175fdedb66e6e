import os

from pyspark.sql import functions as F

from volspark.llm import common


def test_tables_come_and_go(spark):
    df = spark.range(10).select("id", (F.col("id") * 2).alias("n"))
    a, b = common.materialise(df, "a"), common.materialise(df, "b")
    assert a.count() == b.count() == 10
    common.discard(a)
    path = b.shared_path.removeprefix("file:")
    assert not os.path.exists(a.shared_path.removeprefix("file:")) and os.path.exists(path)
    common.clear(spark)
    assert not os.path.exists(path)


def test_free_name(spark):
    assert common.free_name(spark.range(1).select(F.col("id").alias("N"), F.col("id").alias("_n")), "n") == "__n"


def test_words():
    assert common.ascii_words("A-b\x00cÄ 9\n") == ["a".encode(), b"b", "cÄ".encode(), b"9"]
    assert common.ascii_words(None) == []
