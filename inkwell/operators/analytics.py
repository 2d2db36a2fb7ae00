"""Analytics marts: daily sales performance and inventory optimisation."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.columns import UNIT, exact_avg, exact_sum, pct_change, since

# Re-summing totals that are already sums needs more integer digits.
TOTAL = "decimal(28,4)"


def sales_daily_rollup(fact_sales: DataFrame) -> DataFrame:
    """Daily sales per (date, genre, channel, region); partial aggregation
    runs map-side, so a hot key costs one partial row per task."""
    return fact_sales.groupBy("sale_date", "genre", "channel", "region").agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum("quantity").alias("total_quantity"),
        exact_sum("total_amount").alias("total_revenue"),
        exact_avg("total_amount").alias("avg_transaction_value"),
        exact_avg("unit_price", UNIT).alias("avg_unit_price"),
        exact_avg("discount_percent").alias("avg_discount_percent"),
    )


def sales_performance_daily(fact_sales: DataFrame) -> DataFrame:
    """Rollup + previous-day revenue, 7-row moving average and growth."""
    return sales_trends(sales_daily_rollup(fact_sales))


def sales_trends(daily: DataFrame) -> DataFrame:
    """Trends of the daily rollup.

    The window partition is one (genre, channel, region) series of daily
    rows, so its size is bounded by the number of days, not by sales.
    """
    w = Window.partitionBy("genre", "channel", "region").orderBy("sale_date")
    w7 = w.rowsBetween(-6, Window.currentRow)
    rev = F.col("total_revenue")
    with_trends = daily.select(
        "*",
        F.lag(rev, 1).over(w).alias("prev_day_revenue"),
        (F.sum(rev.cast(TOTAL)).over(w7).cast("double") / F.count(rev).over(w7))
        .alias("rolling_7day_avg_revenue"),
    )
    return with_trends.select(
        "*",
        pct_change(rev, F.col("prev_day_revenue")).alias("day_over_day_growth_pct"),
        pct_change(rev, F.col("rolling_7day_avg_revenue")).alias("vs_7day_avg_pct"),
    )


def sales_velocity_30d(fact_sales: DataFrame, as_of: _dt.date | str | None = None,
                       days: int = 30) -> DataFrame:
    """Sales per book since ``as_of - days`` (the date filter reaches the
    scan / partition filter before aggregation)."""
    recent = since(fact_sales, as_of, days)
    return recent.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("transaction_count_30d"),
        F.sum("quantity").alias("units_sold_30d"),
        F.avg("quantity").alias("avg_quantity_per_transaction"),
    )


def inventory_optimization(stg_inventory: DataFrame, fact_sales: DataFrame,
                           dim_books: DataFrame, as_of: _dt.date | str | None = None) -> DataFrame:
    """Stock cover and velocity class per inventory row.

    Sales are aggregated to one row per book before the joins; both joins
    are on book_id, so they share one hash partitioning. 'Dead Stock' is
    unreachable (an unsold book has NULL units, not 0) as in the source.
    """
    sv = sales_velocity_30d(fact_sales, as_of).alias("sv")
    i = stg_inventory.alias("i")
    b = dim_books.select("book_id", "title", "genre", "publisher_name").alias("b")
    units = F.col("sv.units_sold_30d")
    cover = F.col("i.stock_quantity").cast("double") / F.nullif(units / F.lit(30.0), F.lit(0.0))
    joined = (i.join(sv, F.col("i.book_id") == F.col("sv.book_id"), "left")
               .join(b, F.col("i.book_id") == F.col("b.book_id"), "left"))
    return joined.select(
        "i.inventory_id", "i.book_id", "b.title", "b.genre", "b.publisher_name",
        "i.warehouse_location", "i.stock_quantity", "i.reorder_point", "i.needs_restock",
        "i.storage_cost_per_unit",
        F.coalesce(units, F.lit(0)).cast("bigint").alias("units_sold_30d"),
        F.coalesce(F.col("sv.transaction_count_30d"), F.lit(0)).cast("bigint").alias("transaction_count_30d"),
        F.when(units > 0, F.col("i.stock_quantity").cast("double") / (units / F.lit(30.0)))
         .alias("days_of_inventory"),
        (F.col("i.stock_quantity") * F.col("i.storage_cost_per_unit")).alias("total_storage_cost"),
        F.when(units == 0, "Dead Stock").when(cover < 7, "Fast Moving").when(cover < 30, "Normal")
         .when(cover < 90, "Slow Moving").otherwise("Very Slow").alias("velocity_category"),
    )
