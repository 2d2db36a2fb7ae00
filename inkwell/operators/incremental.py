"""Incremental fact load: keep batch rows loaded after the target's last
load, replace rows with the same key, insert the rest.

The mark is the load stamp (when a row was loaded), not an event date: a
sale that arrives late, with an old date, is new. Parquet has no MERGE, so
the upsert is an anti join + ``unionByName``. A partitioned table is
rewritten only where a batch touches it: in the partitions of the batch's
rows and in those that hold older versions of its keys. The latter are
named by a key locator beside the table, (bucket, digest, partition) of
every key ever written, which is appended to by every batch. Digests that
collide and entries of keys that moved on cost a needless rewrite, never
a wrong row; ``build_locator`` starts it afresh.

Keys are unique in the result: of the rows of a batch with one key the one
with the highest mark stays (ties: the greatest row, column by column). A
null key is a key like any other, equal to null.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.sources.schemas import assert_schema

PARTITION_COLUMNS = ("sale_year", "sale_month")
LOAD_STAMP = "dbt_updated_at"
# Touched partitions beyond this count are found by a join, not a filter.
MAX_FILTERED = 2_000
# Digests of keys that a batch repeats; up to this many (some 30 MB) are broadcast.
MAX_REPEATED = 1_000_000
# Folders of the key locator.
LOCATOR_BUCKETS = 32
# Everything here is written once and read a few times.
CODEC = {"compression": "zstd"}


def new_rows(target: DataFrame, batch: DataFrame, mark: str = LOAD_STAMP) -> DataFrame:
    """Batch rows with mark > MAX(target.mark); an empty target (NULL mark)
    takes the whole batch (the source model would take nothing)."""
    hwm = target.select(F.max(mark)).scalar()
    return batch.where(hwm.isNull() | (F.col(mark) > hwm))


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _same_key(left: DataFrame, right: DataFrame, keys: list[str]):
    """Join condition on equal keys, null equal to null."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_key_{k}"]) for k in keys])


def _key_side(rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    return rows.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *more)


def one_per_key(rows: DataFrame, keys: list[str], mark: str | None) -> DataFrame:
    """Of the rows with one key the one with the highest ``mark`` (null lowest),
    then the greatest in the other columns: a partial aggregate, so that a key
    repeated in a third of the batch leaves a task once."""
    order = [*([mark] if mark in rows.columns else []), *[c for c in rows.columns if c not in (*keys, mark)]]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def _unique_aside(spark: SparkSession, rows: DataFrame, keys: list[str], mark: str | None, path: str) -> DataFrame:
    """``one_per_key`` of rows that are written once, below ``path``. Digests of the
    keys are counted to tell which rows have company; only these are compared, and
    the others, mostly all, are read as they came, without a shuffle. Where too
    many keys repeat to be broadcast, all rows are compared and written again."""
    rows.write.options(**CODEC).parquet(f"{path}/sent")
    sent = spark.read.schema(rows.schema).parquet(f"{path}/sent")
    found = sent.select(_digest(keys).alias("_digest")).groupBy("_digest").agg(F.count(F.lit(1)).alias("_n"))
    found.where("_n > 1").select("_digest").write.options(**CODEC).parquet(f"{path}/repeated")
    repeated = spark.read.schema("_digest long").parquet(f"{path}/repeated")
    n = repeated.count()
    if n == 0:
        return sent
    if n <= MAX_REPEATED:
        marked = sent.withColumn("_digest", _digest(keys))
        company = marked.join(F.broadcast(repeated), "_digest", "left_semi").select(*rows.columns)
        one_per_key(company, keys, mark).write.options(**CODEC).parquet(f"{path}/batch")
        alone = marked.join(F.broadcast(repeated), "_digest", "left_anti").select(*rows.columns)
        return alone.unionByName(spark.read.schema(rows.schema).parquet(f"{path}/batch"))
    one_per_key(sent, keys, mark).write.options(**CODEC).parquet(f"{path}/batch")
    return spark.read.schema(rows.schema).parquet(f"{path}/batch")


def upsert(target: DataFrame, batch: DataFrame, key: str | list[str] = "transaction_id",
           mark: str | None = LOAD_STAMP) -> DataFrame:
    """Whole merged table: target rows whose key is not in the batch,
    plus the (newer) batch rows. Schema change fails before any work."""
    assert_schema(batch, target.schema, "incremental batch")
    fresh = one_per_key(new_rows(target, batch, mark) if mark else batch, _keys(key), mark)
    known = _key_side(fresh, _keys(key))
    return target.join(known, _same_key(target, known, _keys(key)), "left_anti").unionByName(fresh)


# ---------------------------------------------------------------------------
# Key locator
# ---------------------------------------------------------------------------


def locator_path(target_path: str) -> str:
    return f"{target_path.rstrip('/')}__keys"


def _digest(keys: list[str]) -> Column:
    """Digest of a key; a null is told from any value by its place in the text."""
    return F.xxhash64(*[F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("-")) for k in keys])


def _located(rows: DataFrame, keys: list[str], partition_cols: tuple[str, ...]) -> DataFrame:
    """(digest, partition columns, bucket) of rows of unique keys. Only colliding
    digests give an entry twice, which costs nothing."""
    rows = rows.select(_digest(keys).alias("digest"), *partition_cols)
    return rows.withColumn("bucket", F.pmod("digest", F.lit(LOCATOR_BUCKETS)).cast("int"))


def _append_locator(entries: DataFrame, path: str, mode: str = "append") -> None:
    entries.hint("rebalance", "bucket").write.mode(mode).options(**CODEC).partitionBy("bucket").parquet(path)


def build_locator(spark: SparkSession, target_path: str, key: str | list[str] = "transaction_id",
                  partition_cols: tuple[str, ...] = PARTITION_COLUMNS) -> None:
    """Write the locator of a table from its rows (keys and partitions only are
    read), for a table that has none or whose locator lists many moved keys."""
    rows = spark.read.parquet(target_path)
    _append_locator(_located(rows, _keys(key), partition_cols), locator_path(target_path), "overwrite")


def _holding(locator: DataFrame, entries: DataFrame, partition_cols: tuple[str, ...]) -> DataFrame:
    """Distinct partitions that may hold a row with a key of ``entries``. Of the
    locator only the buckets that the keys fall in are read."""
    buckets = [r[0] for r in entries.select("bucket").distinct().collect()]  # at most LOCATOR_BUCKETS
    return locator.where(F.col("bucket").isin(buckets)).join(
        entries.select("bucket", "digest").distinct(), ["bucket", "digest"], "left_semi").select(
        *partition_cols).distinct()


def touched_partitions(target: DataFrame, batch: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Target rows in the partitions that ``batch`` has rows for. Up to
    ``MAX_FILTERED`` partitions become a filter that prunes the scan."""
    values = batch.select(*columns).distinct()
    found = values.limit(MAX_FILTERED + 1).collect()
    if len(found) > MAX_FILTERED:
        values = _key_side(values, list(columns))
        return target.join(values, _same_key(target, values, list(columns)), "left_semi")
    one = lambda row: reduce(
        lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(row[c])) for c in columns])
    return target.where(reduce(lambda a, b: a | b, map(one, found), F.lit(False)))


def _delete_files(spark: SparkSession, files: list[str]) -> None:
    """Delete data files through the file system of their path."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in files:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, False)


def write_upsert(spark: SparkSession, target_path: str, batch: DataFrame,
                 key: str | list[str] = "transaction_id", mark: str | None = LOAD_STAMP,
                 partition_cols: tuple[str, ...] = PARTITION_COLUMNS, version: str | None = None) -> DataFrame:
    """Apply a batch to a partitioned Parquet table in place, rewriting only
    the touched partitions. The batch is written once, beside the table, and
    read from there; so are the merged partitions, because a Parquet table
    cannot be read and overwritten by the same job.

    With ``version`` a batch row replaces a stored one only if its value there is
    not lower (null lowest), so that rows may arrive in any order.

    The locator is appended to before the table is changed, and files of
    partitions that lost their last row go after it: a batch that is repeated
    after a failure at any point finds every older version and ends alike.
    """
    keys, order = _keys(key), mark or version
    target, names = read_table(spark, target_path), locator_path(target_path)
    aside = f"{target_path.rstrip('/')}__staging/{uuid.uuid4().hex}"
    if target is None:  # first batch creates the table
        fresh = _unique_aside(spark, batch, keys, order, aside)
        _append_locator(_located(fresh, keys, partition_cols), names, "overwrite")
        (fresh.hint("rebalance", *partition_cols).write.mode("overwrite").options(**CODEC)
         .partitionBy(*partition_cols).parquet(target_path))
        return spark.read.schema(batch.schema).parquet(target_path)
    if set(batch.columns) == set(target.columns):  # a table lists its partition columns last
        batch = batch.select(*target.columns)
    assert_schema(batch, target.schema, "incremental batch")
    if read_table(spark, names) is None:
        build_locator(spark, target_path, key, partition_cols)
    fresh = _unique_aside(spark, new_rows(target, batch, mark) if mark else batch, keys, order, aside)
    fresh = fresh.select(*target.columns)
    if fresh.isEmpty():  # a micro-batch of nothing new
        return spark.read.schema(target.schema).parquet(target_path)
    entries = _located(fresh, keys, partition_cols)
    old = _holding(spark.read.schema(entries.schema).parquet(names), entries, partition_cols)
    touched = fresh.select(*partition_cols).unionByName(old).distinct()
    touched.write.options(**CODEC).parquet(f"{aside}/touched")
    touched = spark.read.schema(touched.schema).parquet(f"{aside}/touched")
    scope = touched_partitions(target, touched, partition_cols)
    if version:
        stored = _key_side(scope, keys, F.col(version).alias("_stored"), F.lit(True).alias("_known"))
        fresh = fresh.join(stored, _same_key(fresh, stored, keys), "left").where(
            F.col("_known").isNull() | F.col("_stored").isNull() | (F.col(version) >= F.col("_stored")))
        fresh = fresh.select(*target.columns)
        fresh.write.options(**CODEC).parquet(f"{aside}/newer")
        fresh = spark.read.schema(batch.schema).parquet(f"{aside}/newer").select(*target.columns)
    known = _key_side(fresh, keys)
    merged = scope.join(known, _same_key(scope, known, keys), "left_anti").unionByName(fresh)
    merged.hint("rebalance", *partition_cols).write.options(**CODEC).partitionBy(*partition_cols).parquet(f"{aside}/merged")
    staged = spark.read.schema(target.schema).parquet(f"{aside}/merged").select(*target.columns)
    left = _key_side(staged.select(*partition_cols).distinct(), list(partition_cols))
    emptied = scope.join(left, _same_key(scope, left, list(partition_cols)), "left_anti")
    files = [r[0] for r in emptied.select("_metadata.file_path").distinct().collect()]
    _append_locator(entries, names)
    (staged.write.mode("overwrite").options(**CODEC, partitionOverwriteMode="dynamic")
     .partitionBy(*partition_cols).parquet(target_path))
    _delete_files(spark, files)
    return spark.read.schema(target.schema).parquet(target_path)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None if there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
