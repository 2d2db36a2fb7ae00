"""Constraints over time: a batch is checked without rescanning the table.

A key index is a stored table (batch, bucket, key, n) of every key loaded so
far, partitioned by batch and by a digest bucket of the key. A batch counts
its own keys, reads only the buckets they fall in, and so knows exactly which of
them exist already (unique) or which parents do not (relationships). It then
adds its keys under its own name; a batch that is repeated replaces what it
added, so checks after a failure give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators.incremental import read_table

#: Folders of a batch in a key index.
INDEX_BUCKETS = 32


def key_counts(rows: DataFrame, column: str) -> DataFrame:
    """(bucket, key, n): the non-null keys of ``rows`` and how often each occurs."""
    keys = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("key"))
    out = keys.agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(INDEX_BUCKETS)).cast("int"))


def add_keys(rows: DataFrame, column: str, path: str, batch: str) -> None:
    """Add the keys of ``rows`` to the index at ``path`` under the name ``batch``."""
    (key_counts(rows, column).withColumn("batch", F.lit(batch)).hint("rebalance", "bucket")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch", "bucket").parquet(path))


def loaded_keys(spark: SparkSession, path: str, wanted: DataFrame, batch: str) -> DataFrame:
    """(key, loaded): how often the keys of ``wanted`` (bucket, key) are in the
    index, not counting ``batch`` itself. Buckets without a wanted key are not read."""
    index = read_table(spark, path)
    if index is None:
        return wanted.select("key", F.lit(0).cast("long").alias("loaded")).limit(0)
    buckets = [r[0] for r in wanted.select("bucket").distinct().collect()]  # at most INDEX_BUCKETS
    index = index.where(F.col("bucket").isin(buckets) & (F.col("batch").cast("string") != batch))
    return (index.select("key", "n").join(wanted.select("key").distinct(), "key", "left_semi")
            .groupBy("key").agg(F.sum("n").alias("loaded")))


def unique_failures(spark: SparkSession, rows: DataFrame, column: str, path: str, batch: str) -> DataFrame:
    """(key, n_records) of the keys of ``rows`` that then occur more than once in
    all that is loaded. Null keys never fail."""
    own = key_counts(rows, column)
    old = loaded_keys(spark, path, own, batch)
    total = F.col("n") + F.coalesce("loaded", F.lit(0))
    return own.join(old, "key", "left").select("key", total.alias("n_records")).where("n_records > 1")


def relationship_failures(spark: SparkSession, rows: DataFrame, column: str, parents: str) -> DataFrame:
    """(key, n_records) of the values of ``rows`` that are no key of the parent's
    index. Null values never fail."""
    own = key_counts(rows, column)
    known = loaded_keys(spark, parents, own, "")
    return own.join(known, "key", "left_anti").select("key", F.col("n").alias("n_records"))
