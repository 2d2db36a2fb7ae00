"""Declared schemas of the five raw tables and a check used before writes.

``created_at`` is TIMESTAMP_NTZ like the source columns it comes from.
Ids are the integer keys of the source tables (BIGINT joins hash and sort
far cheaper than strings at scale); ``transaction_id`` is a composite
string because no single source column is unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

RAW_PUBLISHERS = T.StructType([
    T.StructField("publisher_id", T.LongType()),
    T.StructField("publisher_name", T.StringType()),
    T.StructField("publisher_type", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("established_year", T.IntegerType()),
    T.StructField("total_titles", T.IntegerType()),
    T.StructField("active_status", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

RAW_BOOKS = T.StructType([
    T.StructField("book_id", T.LongType()),
    T.StructField("isbn", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("publisher_id", T.LongType()),
    T.StructField("genre", T.StringType()),
    T.StructField("publication_year", T.IntegerType()),
    T.StructField("page_count", T.IntegerType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("format", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

RAW_SALES = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("book_id", T.LongType()),
    T.StructField("sale_date", T.DateType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("unit_price", T.DoubleType()),
    T.StructField("discount_percent", T.DoubleType()),
    T.StructField("total_amount", T.DoubleType()),
    T.StructField("channel", T.StringType()),
    T.StructField("customer_type", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

RAW_INVENTORY = T.StructType([
    T.StructField("inventory_id", T.LongType()),
    T.StructField("book_id", T.LongType()),
    T.StructField("warehouse_location", T.StringType()),
    T.StructField("stock_quantity", T.IntegerType()),
    T.StructField("reorder_point", T.IntegerType()),
    T.StructField("last_restock_date", T.DateType()),
    T.StructField("storage_cost_per_unit", T.DoubleType()),
    T.StructField("shelf_life_days", T.IntegerType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

RAW_CAMPAIGN_EVENTS = T.StructType([
    T.StructField("campaign_id", T.StringType()),
    T.StructField("experiment_id", T.StringType()),
    T.StructField("treatment_group", T.StringType()),
    T.StructField("impressions", T.LongType()),
    T.StructField("clicks", T.LongType()),
    T.StructField("spend", T.DoubleType()),
    T.StructField("campaign_date", T.DateType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

RAW_SCHEMAS = {
    "publishers": RAW_PUBLISHERS,
    "books": RAW_BOOKS,
    "sales": RAW_SALES,
    "inventory": RAW_INVENTORY,
    "campaign_events": RAW_CAMPAIGN_EVENTS,
}


class SchemaChangeError(ValueError):
    """Raised when a frame no longer matches the schema of its target."""


def _shape(schema: T.StructType) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


def assert_schema(df: DataFrame, expected: T.StructType, what: str = "frame") -> DataFrame:
    """Fail (like an incremental model with schema change = fail) when the
    column names or types differ; nullability is not compared."""
    got, want = _shape(df.schema), _shape(expected)
    if got != want:
        raise SchemaChangeError(f"{what}: schema {got} does not match {want}")
    return df
