"""Table access: scan, parameterised SQL, overwrite / append writers,
existence check and schema creation (the reference's database helper,
expressed with the Spark catalog and Parquet)."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from inkwell.sources.schemas import assert_schema

SCHEMAS = ("raw", "staging", "analytics")


def create_schemas(spark: SparkSession, names=SCHEMAS) -> None:
    for n in names:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {n}")


def scan_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read a Parquet table; with a declared schema the read skips
    inference and the result is checked against it."""
    if schema is None:
        return spark.read.parquet(path)
    return assert_schema(spark.read.schema(schema).parquet(path), schema, path)


def fetch(spark: SparkSession, query: str, params: dict[str, Any] | None = None,
          **frames: DataFrame) -> DataFrame:
    """Run SQL with named parameter markers (``:name``) bound as literals,
    never by string formatting; ``frames`` are referenced as ``{name}``."""
    return spark.sql(query, args=params or {}, **frames)


def table_exists(spark: SparkSession, table: str, schema: str | None = None) -> bool:
    name = f"{schema}.{table}" if schema else table
    return spark.catalog.tableExists(name)


def save_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite a Parquet table (written to its own folder; readers pick
    it up on their next scan)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV export with a header row (written by the executors, one file
    per task; nothing passes through the driver)."""
    df.write.mode("overwrite").option("header", True).csv(path)

