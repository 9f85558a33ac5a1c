"""Partition sizing and size checks."""

import pytest
from pyspark.sql import functions as F

from framescope.operators import guards


def test_key_partitions_floor_from_input_size(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    base = guards.key_partitions(d)
    assert base >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16KB")
        size = guards.estimated_bytes(d)
        assert guards.key_partitions(d) == max(base, -(-size // (16 * 1024)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_unknown_size_estimates_are_ignored(spark):
    local = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert guards.key_partitions(local) <= 1_000_000
    assert guards.key_partitions(local, 7) == 7


def test_spread_only_when_few_splits(spark):
    one = spark.range(10).coalesce(1)
    assert guards.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(100).repartition(spark.sparkContext.defaultParallelism * 2)
    assert guards.spread(many) is many


def test_spread_leaves_shuffled_frames_unrun(spark):
    tracker = spark.sparkContext.statusTracker()
    group = "spread-probe"
    spark.sparkContext.setJobGroup(group, group)
    derived = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert guards.spread(derived) is derived
    assert not tracker.getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_collect_small_raises_over_the_bound(spark):
    assert len(guards.collect_small(spark.range(3), 3, "x")) == 3
    with pytest.raises(guards.TooLargeToBroadcast):
        guards.collect_small(spark.range(4), 3, "x")
    checked = guards.checked_broadcast(spark.range(5), 4, "x")
    assert not checked.broadcast and checked.rows == 5
