from pyspark.sql import functions as F

from bandloom.common import fits, one_per_key
from bandloom.session import cut, discard


def test_fits_measures_values(spark):
    """Few rows with long texts don't fit, many short ones may; null and nested values are measured, too."""
    df = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    assert fits(df, 8, 200_000) and not fits(df, 8, 100_000) and not fits(df, 8, 799)
    nested = spark.createDataFrame([(None, None), ([("ab", [1, 2])], {"k": "v"})], "a array<struct<s: string, n: array<int>>>, m map<string,string>")
    assert fits(nested, 8, 1000) and not fits(nested, 8, 60) and fits(nested.limit(0), 8, 16)


def test_one_per_key(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, None, 1), (None, "x", 0), (1, "a", 1)], "k int, v string, loadedat int")
    assert sorted((r["k"], r["v"]) for r in one_per_key(df, "k").collect()) == [(1, "a"), (2, None)]


def test_cuts_are_deleted(spark):
    import os

    kept = cut(spark.range(3).toDF("v"))
    path = kept._cut_at.removeprefix("file:")
    again = cut(kept.withColumn("w", F.col("v") + 1))
    discard(kept, spark.range(1))
    assert not os.path.exists(path) and again.count() == 3
