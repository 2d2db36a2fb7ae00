"""Structured Streaming loaders.

* ``fact_sales_stream``: sales files arriving in a landing folder become
  fact rows (staging rules + catalogue attributes) and are upserted by
  transaction_id into a partitioned fact table. ``foreachBatch`` rewrites
  only the partitions a micro-batch touches; the upsert is idempotent, so
  a replayed batch after a failure leaves the same table (the streaming
  checkpoint records which files were taken). Rows that arrive again
  unchanged are dropped by keyed state before the merge, so that replayed
  files rewrite no partition.
* ``campaign_window_stream``: raw events -> daily per-campaign impressions
  and clicks with a watermark (late events beyond it are dropped, state of
  closed windows is evicted), emitted in update mode and upserted by
  (user_id, window_date), so the table holds every window's latest value.

The keyed state of the sales grows with what arrives within the horizon, so it is
kept by RocksDB, on the executors' disks and in bounded memory, not in their heaps
(``disk_state``). Windows that are closed by a watermark stay few; their state is
kept by the provider that the session names.

``trigger(availableNow=True)`` processes what has landed and stops, the
batch-scheduled way to run a stream; the same query runs continuously
with a processing-time trigger.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import incremental, marts, staging
from inkwell.session import scratch_dir
from inkwell.sources.schemas import RAW_SALES


#: State on disk: changes are uploaded instead of whole files, and all stores of an executor share the memory.
DISK_STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


@contextmanager
def disk_state(spark: SparkSession) -> Iterator[None]:
    """Streams that are started within keep their state in RocksDB. A setting that the
    session names stays as it is; afterwards the session is as it was."""
    mine = {k: v for k, v in DISK_STATE.items() if k not in spark.conf.getAll}
    for key, value in mine.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key in mine:
            spark.conf.unset(key)


def new_run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir for one run."""
    return scratch_dir(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def land_in_time_order(df: DataFrame, ts: str, folder: str, slices: int = 4) -> str:
    """Write a frame as ``slices`` arrivals in time order (one write per
    equal time range, so file modification times follow event time, as
    they do when data lands over time)."""
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    bounds = df.agg(F.min(t).alias("lo"), F.max(t).alias("hi")).first()
    if bounds["lo"] is None:  # no rows, or none with a time: one arrival
        df.write.mode("append").parquet(folder)
        return folder
    lo, hi = int(bounds["lo"]), int(bounds["hi"])
    step = max(1, (hi - lo) // slices + 1)
    for i in range(slices):
        cond = (t >= lo + i * step) if i else F.lit(True)  # no time: with the first
        if i < slices - 1:
            cond = cond & (t < lo + (i + 1) * step)
        if i == 0:
            cond = cond | t.isNull()
        df.where(cond).write.mode("append").parquet(folder)
    return folder


def land_files(df: DataFrame, folder: str) -> str:
    """Write a frame as arrivals for a stream, one file for each task."""
    df.write.mode("overwrite").parquet(folder)
    return folder


def without_replays(arrivals: DataFrame, key: str, horizon: str) -> DataFrame:
    """Rows of a stream whose key has not arrived with the same contents in the
    last ``horizon``. State holds a digest of the row, its key included (16 bytes),
    and is evicted after ``horizon`` of processing time: the watermark follows the
    clock of the micro-batches, not a time in the data, so no row is ever too late.
    Null keys and null values are contents like any other."""
    # Cast values in a JSON array: nulls, separators and microseconds all tell rows apart.
    contents = [key, *[c for c in arrivals.columns if c != key]]
    row = F.unhex(F.md5(F.to_json(F.array(*[F.col(c).cast("string") for c in contents]))))
    seen = arrivals.withColumn("_row", row).withColumn("_arrived", F.current_timestamp())
    seen = seen.withWatermark("_arrived", horizon).dropDuplicatesWithinWatermark(["_row"])
    return seen.drop("_row", "_arrived")


def adaptive(load: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """``load`` of a micro-batch with adaptive plans. A stream turns them off in its
    session, for its own plan; the rows of a micro-batch come out of that plan, and
    what ``load`` does with them is batch work: without adaptive plans a rebalance
    is left out and each of the shuffle's tasks writes a file into every folder."""
    key = "spark.sql.adaptive.enabled"

    def run(batch: DataFrame, epoch_id: int) -> None:
        conf = batch.sparkSession.conf
        before = conf.get(key)
        conf.set(key, "true")
        try:
            load(batch, epoch_id)
        finally:
            conf.set(key, before)
    return run


def fact_sales_stream(spark: SparkSession, landing: str, dim_books: DataFrame, target: str,
                      checkpoint: str, files_per_batch: int | None = None,
                      version: str | None = "created_at", replay_horizon: str = "7 days") -> DataFrame:
    """Load every landed raw-sales file into the fact table; returns it. A run
    takes as long as what has landed needs. A sale that arrives again replaces
    the stored one unless its ``version`` is lower, so that corrections,
    replays and arrivals out of order leave its latest version.

    Rows that come again unchanged within ``replay_horizon`` do not reach the
    merge; later ones do, and the merge leaves the table as it is. Of rows with
    one key and version but different contents the last new one stands. Without
    a version an old row may be meant to return, so every row is merged."""
    books = dim_books.select("book_id", "publisher_id", "genre", "format", "price_category",
                             "length_category")

    def load(batch: DataFrame, epoch_id: int) -> None:
        facts = marts.fact_sales(staging.stg_sales(batch), books)
        incremental.write_upsert(batch.sparkSession, target, facts, key="transaction_id", mark=None,
                                 version=version)

    stream = _arrivals(spark, RAW_SALES, files_per_batch).parquet(landing)
    if version:
        stream = without_replays(stream, "transaction_id", replay_horizon)
    with disk_state(spark):
        q = (stream.writeStream.foreachBatch(adaptive(load)).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.parquet(target)


def _arrivals(spark: SparkSession, schema, files_per_batch: int | None):
    """File stream; ``files_per_batch`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    return reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)


EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def campaign_window_stream(spark: SparkSession, landing: str, target: str, checkpoint: str,
                           watermark: str = "1 day", files_per_batch: int | None = None) -> DataFrame:
    """Daily campaign windows (impressions, clicks, ctr) per user."""
    events = _arrivals(spark, EVENT_SCHEMA, files_per_batch).parquet(landing)
    # Watermarks need TIMESTAMP (with time zone); the session zone is UTC.
    ev = events.select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    agg = (ev.withWatermark("ts", watermark)
           .groupBy("user_id", F.window("ts", "1 day").alias("w"))
           .agg(F.count(F.when(F.col("event_type") == "view", 1)).alias("impressions"),
                F.count(F.when(F.col("event_type") == "click", 1)).alias("clicks")))

    def load(batch: DataFrame, epoch_id: int) -> None:
        rows = batch.select("user_id", F.col("w.start").cast("date").alias("window_date"),
                            "impressions", "clicks")
        incremental.write_upsert(batch.sparkSession, target, rows, key=["user_id", "window_date"],
                                 mark=None, partition_cols=("window_date",))

    q = (agg.writeStream.outputMode("update").foreachBatch(adaptive(load))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.parquet(target)
    return out.select("user_id", "window_date", "impressions", "clicks",
                      (F.col("clicks").cast("double") / F.nullif(F.col("impressions"), F.lit(0))).alias("ctr"))
