"""Star schema: dim_publishers, dim_books, fact_sales.

Joins are left outer on the dimension key. The dimension side is broadcast
only when the planner's size check (static or AQE runtime statistics)
puts it under ``spark.sql.autoBroadcastJoinThreshold``; beyond that the
join is sort-merge, and AQE splits skewed key partitions (a best-seller
holding a third of all sales) of the fact side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.columns import band, sql_day_of_week


def dim_publishers(stg_publishers: DataFrame) -> DataFrame:
    year, titles = F.col("established_year"), F.col("total_titles")
    cols = ["publisher_id", "publisher_name", "publisher_type", "country",
            "established_year", "total_titles", "is_active"]
    extra = [c for c in ("created_at", "dbt_updated_at") if c in stg_publishers.columns]
    return stg_publishers.select(
        *cols,
        band(year, [(year < 1980, "Legacy"), (year < 2000, "Established")], "Modern").alias("publisher_era"),
        band(titles, [(titles > 100, "Large"), (titles > 20, "Medium")], "Small").alias("publisher_size"),
        *extra)


def dim_books(stg_books: DataFrame, dim_publishers: DataFrame) -> DataFrame:
    b = stg_books.alias("b")
    p = dim_publishers.select("publisher_id", "publisher_name", "publisher_type").alias("p")
    pages, price, year = F.col("b.page_count"), F.col("b.price"), F.col("b.publication_year")
    extra = [F.col(f"b.{c}") for c in ("created_at", "dbt_updated_at") if c in stg_books.columns]
    return b.join(p, F.col("b.publisher_id") == F.col("p.publisher_id"), "left").select(
        "b.book_id", "b.isbn", "b.title", "b.author", "b.publisher_id",
        "p.publisher_name", "p.publisher_type",
        "b.genre", "b.publication_year", "b.page_count", "b.price", "b.format", "b.language",
        band(pages, [(pages < 150, "Short"), (pages < 300, "Medium"), (pages < 500, "Long")],
             "Very Long").alias("length_category"),
        band(price, [(price < 15, "Budget"), (price < 30, "Standard"), (price < 50, "Premium")],
             "Luxury").alias("price_category"),
        band(year, [(year >= 2020, "Recent"), (year >= 2015, "Current"), (year >= 2010, "Older")],
             "Legacy").alias("recency_category"),
        *extra)


FACT_COLUMNS = [
    "transaction_id", "book_id", "sale_date", "quantity", "unit_price",
    "discount_percent", "total_amount", "channel", "customer_type", "region",
    "sale_year", "sale_month", "day_of_week",
    "publisher_id", "genre", "format", "price_category", "length_category",
]


def fact_sales(stg_sales: DataFrame, dim_books: DataFrame) -> DataFrame:
    """Sales with the attributes of their book. The parts of the date are taken
    after the join, so that its shuffle does not carry them."""
    s = stg_sales.drop("sale_year", "sale_month", "day_of_week").alias("s")
    b = dim_books.select("book_id", "publisher_id", "genre", "format",
                         "price_category", "length_category").alias("b")
    extra = [F.col(f"s.{c}") for c in ("created_at", "dbt_updated_at") if c in stg_sales.columns]
    day = F.col("s.sale_date")
    return s.join(b, F.col("s.book_id") == F.col("b.book_id"), "left").select(
        "s.transaction_id", "s.book_id", "s.sale_date", "s.quantity", "s.unit_price",
        "s.discount_percent", "s.total_amount", "s.channel", "s.customer_type", "s.region",
        F.year(day).alias("sale_year"), F.month(day).alias("sale_month"), sql_day_of_week(day).alias("day_of_week"),
        "b.publisher_id", "b.genre", "b.format", "b.price_category", "b.length_category",
        *extra)
