"""Shuffle partitions are merged to small ones, whose rows one task can sort."""

from pyspark.sql import functions as F

from inkwell.session import configure


def test_merged_partitions_stay_small(spark):
    configure(spark)
    trial = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {key: spark.conf.get(key) for key in trial}
    try:
        for key, value in trial.items():
            spark.conf.set(key, value)
        # About 30 MB compressed: one partition under Spark's default of 64 MB.
        rows = spark.range(3_000_000).select(F.xxhash64("id").alias("k")).repartition("k")
        sizes = rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sum(sizes) == 3_000_000
    assert max(sizes) < 1_200_000
