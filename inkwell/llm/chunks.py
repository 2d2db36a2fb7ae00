"""Documents in chunks: a stored table whose buckets are groups of rows.

A chunk's rows can be met again and again (grouped or cogrouped by ``_chunk``)
without a shuffle of their texts; only what is sent to a chunk is shuffled.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.session import ensure_checkpoint_dir

#: Bytes of text in a chunk, about.
CHUNK_BYTES = 8 << 20
#: Buckets of the stored table; more chunks than that share buckets.
MAX_BUCKETS = 8192


def chunked(docs: DataFrame, chunk_bytes: int | None = None) -> tuple[DataFrame, int]:
    """``docs`` with ``_row`` and ``_chunk``, stored in buckets of whole chunks
    without a shuffle: each task deals its rows to its own chunks, and a
    chunk's number is one that Spark hashes to the chunk's bucket."""
    spark = docs.sparkSession
    docs, chunk_bytes = docs.drop("_row", "_chunk"), chunk_bytes or CHUNK_BYTES
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = docs.withColumn("_row", F.monotonically_increasing_id())
    task = F.shiftrightunsigned("_row", 33)
    tasks = (rows.agg(F.max(task)).first()[0] or 0) + 1
    each = max(1, -(-size // (tasks * chunk_bytes)))
    chunks = tasks * each
    number = task % tasks * each + F.col("_row").bitwiseAND((1 << 33) - 1) % each
    rows = rows.withColumn("_chunk", number.cast("int"))
    buckets = min(chunks, MAX_BUCKETS)
    if chunks == buckets:  # one chunk to a bucket; the table has a row for each
        fit = _bucket_numbers(spark, buckets)
        rows = rows.withColumnRenamed("_chunk", "_n").join(F.broadcast(fit), "_n", "left")
        rows = rows.withColumn("_chunk", F.coalesce("_fit", F.lit(0))).drop("_n", "_fit")
    name = f"document_chunks_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    rows.write.bucketBy(buckets, "_chunk").option("path", path).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE `{name}`")  # the plan above knows files and buckets; no entry stays in the catalog
    return table, chunks


def _bucket_numbers(spark: SparkSession, n: int) -> DataFrame:
    """(_n, _fit): for each of ``n`` buckets a whole number that falls into it."""
    tries = spark.range(n * (24 + 2 * n.bit_length())).select(F.col("id").cast("int").alias("k"))
    return tries.groupBy(F.expr(f"pmod(hash(k), {n})").cast("int").alias("_n")).agg(
        F.min("k").alias("_fit"))


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column laid end to end, and the ends of its values."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    if not len(column):
        return np.empty(0, np.uint8), np.empty(0, np.int64)
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    bounds = np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[bounds[0]:bounds[-1]], (bounds[1:] - bounds[0]).astype(np.int64)


def in_order(table: pa.Table) -> pa.Table:
    return table.sort_by("_row") if len(table) else table
