"""Staging: clean and stamp the raw tables (views in the reference).

Each function is ``DataFrame -> DataFrame``; ``run_ts`` adds the audit stamp
column only when a caller stores the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.columns import flag, sql_day_of_week


def _stamp(df: DataFrame, run_ts: str | None) -> DataFrame:
    if run_ts is None:
        return df
    return df.withColumn("dbt_updated_at", F.lit(run_ts).cast("timestamp_ntz"))


def stg_books(raw_books: DataFrame, run_ts: str | None = None) -> DataFrame:
    df = raw_books.where((F.col("page_count") > 0) & (F.col("price") > 0)).select(
        "book_id", "isbn", "title", "author", "publisher_id", "genre",
        "publication_year", "page_count", "price", "format", "language", "created_at")
    return _stamp(df, run_ts)


def stg_publishers(raw_publishers: DataFrame, run_ts: str | None = None) -> DataFrame:
    df = raw_publishers.select(
        "publisher_id", "publisher_name", "publisher_type", "country",
        "established_year", "total_titles",
        flag(F.col("active_status") == "Active").alias("is_active"),
        "created_at")
    return _stamp(df, run_ts)


def stg_inventory(raw_inventory: DataFrame, run_ts: str | None = None) -> DataFrame:
    df = raw_inventory.select(
        "inventory_id", "book_id", "warehouse_location", "stock_quantity",
        "reorder_point", "last_restock_date", "storage_cost_per_unit",
        "shelf_life_days", "created_at",
        flag(F.col("stock_quantity") <= F.col("reorder_point")).alias("needs_restock"))
    return _stamp(df, run_ts)


def stg_sales(raw_sales: DataFrame, run_ts: str | None = None) -> DataFrame:
    df = raw_sales.where(
        (F.col("quantity") > 0) & (F.col("unit_price") > 0) & (F.col("total_amount") > 0)
    ).select(
        "transaction_id", "book_id", "sale_date", "quantity", "unit_price",
        "discount_percent", "total_amount", "channel", "customer_type", "region",
        "created_at",
        F.year("sale_date").alias("sale_year"),
        F.month("sale_date").alias("sale_month"),
        sql_day_of_week(F.col("sale_date")).alias("day_of_week"))
    return _stamp(df, run_ts)
