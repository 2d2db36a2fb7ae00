"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.session import ensure_checkpoint_dir

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: A side of a join is broadcast only below so many (counted) rows.
BROADCAST_ROWS = 20_000


def words(text: Column) -> Column:
    """Array of the words of a text (null text: empty array)."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here,
    and the rows stay the same however often they are read."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shielded(docs: DataFrame, own: Sequence[str],
             work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work(docs)`` with the columns of ``docs``; those not in ``own`` have
    neutral names meanwhile, so that none can clash with a name of the work."""
    safe = {c: c if c in own else f"__{i}" for i, c in enumerate(docs.columns)}
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    out = work(docs.select(*[quoted(c).alias(s) for c, s in safe.items()]))
    return out.select(*[F.col(s).alias(c) for c, s in safe.items()])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_counted(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join that broadcasts ``right`` if its counted rows are few; else Spark
    picks a shuffled join, whose skewed partitions AQE splits."""
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        right = F.broadcast(right)
    return left.join(right, on, how)


def ranged(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` globally sorted by ``order`` and stored, with ``_part`` and
    ``_pos`` (partition in range order, place in the partition). Rows equal in
    ``order`` are spread by their place in the input, so repeated rows never
    gather in one partition."""
    spark = df.sparkSession
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*order, F.col("_tie").asc()]
    at = F.monotonically_increasing_id()
    out = (
        tied.repartitionByRange(shuffle_partitions(spark), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", at)
        .withColumn("_part", F.shiftrightunsigned("_at", 33).cast("int"))
        .withColumn("_pos", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_tie", "_at")
    )
    return stored(out, name)


def numbered(df: DataFrame, order: Sequence[Column], name: str,
             total: str | None = None) -> DataFrame:
    """``df`` with ``row_number`` (gapless from 0 in ``order``) and, if
    ``total`` names a column, ``running`` (its inclusive sum in ``order``).

    Rows are range-partitioned and sorted; each partition counts from 0 and is
    shifted by the sizes of those before it. The table of shifts has one row
    per partition, which bounds the broadcast.
    """
    rows = ranged(df, order, name)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.count(F.lit(1)).alias("_n")]
    if total:
        sums.append(F.sum(total).alias("_s"))
    shifts = rows.groupBy("_part").agg(*sums)
    shifts = shifts.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *([F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0")] if total else []))
    out = rows.join(F.broadcast(shifts), "_part")
    if total:
        upto = Window.partitionBy("_part").orderBy("_pos").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        out = out.withColumn("running", F.sum(total).over(upto) + F.col("_s0"))
    return (out.withColumn("row_number", F.col("_n0") + F.col("_pos"))
            .drop("_part", "_pos", "_n0", "_s0"))
