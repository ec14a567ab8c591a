"""The skew-safe join equals the plain one, and deals hot keys evenly."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shoreline.operators.joins import null_safe_join
from shoreline.operators.skew import skew_safe_join


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def sides(spark, seed):
    rng = random.Random(seed)
    key = lambda hot: rng.choice([None, "hot", rng.choice("abcdefgh")]) if rng.random() < hot else rng.choice("abcdefghijklmnop")
    left = [(key(0.9), rng.choice([1, None]), i % 7, "same") for i in range(600)]
    right = [(key(0.4), rng.choice([1, None, 2]), i, "same") for i in range(60)]
    return (spark.createDataFrame(left, "k string, j int, v int, w string"), spark.createDataFrame(right, "k string, j int, u int, w string"))


@pytest.mark.parametrize("how", ["full", "left", "right", "inner"])
@pytest.mark.parametrize("pieces", [4, 50])
def test_equals_the_plain_join(spark, how, pieces):
    left, right = sides(spark, pieces)
    for x, y in ((left, right), (right, left), (left, right.limit(0)), (left.limit(0), right)):
        assert rows(skew_safe_join(x, y, ["k", "j"], how, min_rows=1, pieces=pieces)) == rows(null_safe_join(x, y, ["k", "j"], how))
    assert skew_safe_join(left, right, ["k", "j"], how).columns == null_safe_join(left, right, ["k", "j"], how).columns


def test_both_sides_hot_and_one_sided_keys(spark):
    left = spark.range(400).select(F.when(F.col("id") % 2 == 0, F.lit("both")).otherwise(F.lit("left")).alias("k"), "id")
    right = spark.range(90).select(F.when(F.col("id") % 2 == 0, F.lit("both")).otherwise(F.lit("right")).alias("k"), F.col("id").alias("n"))
    got = skew_safe_join(left, right, ["k"], "full", min_rows=1, pieces=20)
    assert rows(got) == rows(null_safe_join(left, right, ["k"], "full"))
    assert got.count() == 200 * 45 + 200 + 45


@pytest.mark.parametrize("hot", ["NULL", "'x'"])
def test_a_third_of_the_rows_on_one_key_is_dealt_evenly(spark, hot):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(60_000).select(F.expr(f"if(id % 3 = 0, {hot}, cast(id % 9973 as string))").alias("k"), "id")
        right = spark.range(9_000).select(F.expr(f"if(id = 0, {hot}, cast(id as string))").alias("k"), F.col("id").alias("n"))
        joined = skew_safe_join(left, right, ["k"], "full", min_rows=10)
        sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect())
        assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
        plain = sorted(r["count"] for r in null_safe_join(left, right, ["k"], "full").groupBy(F.spark_partition_id()).count().collect())
        assert plain[-1] > 3 * plain[len(plain) // 2]
        assert joined.count() == null_safe_join(left, right, ["k"], "full").count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_nothing_runs_while_it_is_built(spark):
    left, right = sides(spark, 3)
    spark.sparkContext.setJobGroup("skew", "built")
    try:
        skew_safe_join(left, right, ["k"], "full")
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("skew")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_other_kinds_are_refused(spark):
    left, right = sides(spark, 4)
    with pytest.raises(ValueError):
        skew_safe_join(left, right, ["k"], "cross")
