"""Dense numbers for keys, places within groups, short lists of groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): the distinct non-null keys numbered 0, 1, ... in key order.

    Keys are range-partitioned, numbered within their partition and shifted by
    the sizes of the partitions before; only the table of partition sizes (one
    row per partition) is ordered in one task. The numbered keys are
    checkpointed, so every reader sees the same numbers."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    at = F.monotonically_increasing_id()
    keys = (keys.repartitionByRange(n, key).sortWithinPartitions(key).withColumn("_at", at)
            .checkpoint())
    keys = keys.select(key, F.shiftrightunsigned("_at", 33).alias("_part"),
                       F.col("_at").bitwiseAND((1 << 33) - 1).alias("_pos"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = keys.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    return keys.join(F.broadcast(shift), "_part").select(key, (F.col("_shift") + F.col("_pos")).alias(name))


# Lists of up to so many groups are broadcast; beyond, Spark shuffles.
BROADCAST_GROUPS = 10_000


def group_positions(df: DataFrame, group: str, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with the row's place (1, 2, ...) in its group. Rows are
    range-partitioned by group and order, so a large group spans many tasks;
    each counts its own rows, and a small table (a row for every group of every
    partition: at most groups + partitions) says how many come before."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(group).asc_nulls_first(), *order]
    rows = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
            .withColumn("_at", F.monotonically_increasing_id()).checkpoint())
    part = F.shiftrightunsigned("_at", 33).alias("_part")
    before = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy(F.col(group).alias("_g"), part).agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    runs = runs.select("_g", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = rows.withColumn("_part", part)
    on = F.col(group).eqNullSafe(F.col("_g")) & (rows["_part"] == runs["_part"])
    place = F.col("_before") + F.col("_at") - F.col("_first") + 1
    return rows.join(runs, on).select(*df.columns, place.cast("int").alias(name))


def with_group_heads(df: DataFrame, heads: DataFrame, group: str, order: Sequence[Column],
                     item: Column, n: int) -> DataFrame:
    """``df`` (with ``group``) beside ``_head``, the first ``n`` items of its
    group in ``heads``. The heads come from a row_number filter (a group limit:
    n rows of a group leave a task) and are one short list for each group;
    their table is counted and, if small, sent to ``df``, which then needs no
    shuffle. Rows with a null group find none."""
    w = Window.partitionBy(group).orderBy(*order)
    first = (heads.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
             .groupBy(F.col(group).alias("_g"))
             .agg(F.array_sort(F.collect_list(F.struct(F.col("_r"), item.alias("item")))).alias("_l")))
    first = first.select("_g", F.transform("_l", lambda x: x["item"]).alias("_head")).checkpoint()
    if first.count() <= BROADCAST_GROUPS:
        first = F.broadcast(first)
    return df.join(first, F.col(group) == F.col("_g")).drop("_g")
