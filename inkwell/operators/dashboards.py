"""Dashboard queries (book analytics, inventory insights, recommendations
without the API, the genre-average fallback forecast), in batch form over
every book; a single-book page is a filter on these results.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.columns import UNIT, exact_avg, exact_sum
from inkwell.operators.keys import with_group_heads

# ---------------------------------------------------------------------------
# Catalog lists
# ---------------------------------------------------------------------------


def book_list(dim_books: DataFrame, n: int = 100) -> DataFrame:
    """First n books by title (top-k: TakeOrderedAndProject, no full sort)."""
    return (dim_books.select("book_id", "title", "genre", "price")
            .orderBy(F.col("title").asc_nulls_last(), "book_id").limit(n))


def selection_labels(dim_books: DataFrame) -> DataFrame:
    """'id - title' labels and the id parsed back from each label."""
    label = F.concat_ws(" - ", F.col("book_id").cast("string"), F.col("title"))
    return dim_books.select(
        label.alias("label"),
        F.split(label, " - ").getItem(0).cast("bigint").alias("selection_book_id"))


def table_counts(dim_books: DataFrame, fact_sales: DataFrame) -> DataFrame:
    return (dim_books.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit("dim_books").alias("table_name"), "row_count")
            .unionByName(fact_sales.agg(F.count(F.lit(1)).alias("row_count"))
                         .select(F.lit("fact_sales").alias("table_name"), "row_count")))


# ---------------------------------------------------------------------------
# Book analytics page
# ---------------------------------------------------------------------------


def book_monthly_sales(fact_sales: DataFrame) -> DataFrame:
    month = F.trunc("sale_date", "MM").alias("month")
    return fact_sales.groupBy("book_id", month).agg(
        F.sum("quantity").alias("total_quantity"),
        exact_sum("total_amount").alias("total_revenue"),
        F.count(F.lit(1)).alias("transactions"),
        exact_avg("unit_price", UNIT).alias("avg_price"),
    )


def book_sales_summary(monthly: DataFrame) -> DataFrame:
    """Totals over a book's months; revenue per unit guarded against 0."""
    units = F.sum("total_quantity")
    revenue = F.sum(F.col("total_revenue").cast("decimal(28,4)")).cast("double")
    return monthly.groupBy("book_id").agg(
        units.alias("total_units"),
        revenue.alias("total_revenue"),
        F.avg("total_quantity").alias("avg_monthly_sales"),
        F.when(units > 0, revenue / units).otherwise(F.lit(0.0)).alias("revenue_per_unit"),
        F.count(F.lit(1)).alias("months"),
    )


def book_detail(dim_books: DataFrame, summary: DataFrame) -> DataFrame:
    """Detail row of every book with its sales summary (NULL when unsold)."""
    s = summary.alias("s")
    return dim_books.alias("b").join(s, F.col("b.book_id") == F.col("s.book_id"), "left").select(
        "b.*", "s.total_units", "s.total_revenue", "s.avg_monthly_sales",
        "s.revenue_per_unit", "s.months")


def book_month_table(monthly: DataFrame) -> DataFrame:
    """Display form: month as 'yyyy-MM', values rounded half-up to 2
    decimals on their decimal value (not on the binary double)."""
    return monthly.select(
        "book_id", F.date_format("month", "yyyy-MM").alias("month"),
        F.col("total_quantity").alias("units_sold"),
        F.round(F.col("total_revenue").cast("decimal(18,4)"), 2).cast("double").alias("revenue"),
        "transactions",
        F.round(F.col("avg_price").cast("decimal(18,6)"), 2).cast("double").alias("avg_price"))


# ---------------------------------------------------------------------------
# Inventory insights page
# ---------------------------------------------------------------------------


def inventory_insights(stg_inventory: DataFrame, dim_books: DataFrame,
                       warehouse: str | None = None) -> DataFrame:
    """Stock and value per (warehouse, genre); the warehouse filter is
    added only when one is chosen. ``unique_books`` counts rows, as the
    source does."""
    inv = stg_inventory
    if warehouse is not None:
        inv = inv.where(F.col("warehouse_location") == warehouse)
    b = dim_books.select("book_id", "genre", "price")
    j = inv.join(b, "book_id")
    value = (F.col("stock_quantity") * F.col("price")).cast("decimal(18,4)")
    return j.groupBy("warehouse_location", "genre").agg(
        F.count(F.lit(1)).alias("unique_books"),
        F.sum("stock_quantity").alias("total_stock"),
        F.avg("stock_quantity").alias("avg_stock_per_book"),
        F.sum(value).cast("double").alias("inventory_value"),
    ).orderBy(F.col("inventory_value").desc_nulls_last(), "warehouse_location", "genre")


def inventory_totals(insights: DataFrame) -> DataFrame:
    return insights.agg(
        F.sum(F.col("inventory_value").cast("decimal(28,4)")).cast("double").alias("total_value"),
        F.sum("unique_books").alias("total_books"),
        F.sum("total_stock").alias("total_stock"),
        F.count_distinct("warehouse_location").alias("warehouses"),
        F.count_distinct("genre").alias("genres"),
    )


def inventory_top_categories(insights: DataFrame, n: int = 5) -> DataFrame:
    return insights.orderBy(F.col("inventory_value").desc_nulls_last(),
                            "warehouse_location", "genre").limit(n)


# ---------------------------------------------------------------------------
# Recommendations without the API
# ---------------------------------------------------------------------------


def book_popularity(dim_books: DataFrame, fact_sales: DataFrame) -> DataFrame:
    """All-time units per book, 0 when unsold (sales pre-aggregated to one
    row per book before the join)."""
    units = fact_sales.groupBy("book_id").agg(F.sum("quantity").alias("_units"))
    return (dim_books.select("book_id", "title", "genre", "price", "price_category")
            .join(units, "book_id", "left")
            .select("book_id", "title", "genre", "price", "price_category",
                    F.coalesce(F.col("_units"), F.lit(0)).cast("bigint").alias("popularity")))


def popular_overall(popularity: DataFrame, n: int = 10) -> DataFrame:
    return popularity.orderBy(F.col("popularity").desc(), F.col("title").asc_nulls_last(),
                              "book_id").limit(n)


def similar_by_genre(popularity: DataFrame, n: int = 5) -> DataFrame:
    """For every book, the n most popular other books of its genre.

    Exact without pairing books: a book's list is its genre's top n+1 minus
    itself, taken from one short list per genre.
    """
    order = [F.col("popularity").desc(), F.col("title").asc_nulls_last(), F.col("book_id")]
    item = F.struct("book_id", "title", "price", "price_category", "popularity")
    rows = with_group_heads(popularity.select(F.col("book_id").alias("source_book_id"), "genre"),
                            popularity, "genre", order, item, n + 1)
    own = F.slice(F.filter("_head", lambda x: x["book_id"] != F.col("source_book_id")), 1, n)
    rows = rows.select("source_book_id", "genre", F.posexplode(own).alias("_p", "x"))
    return rows.select("source_book_id", "x.book_id", "x.title", "genre", "x.price", "x.price_category",
                       "x.popularity", (F.col("_p") + 1).alias("rank"))


# ---------------------------------------------------------------------------
# Genre-average fallback forecast
# ---------------------------------------------------------------------------


def genre_avg_demand(fact_sales: DataFrame, dim_books: DataFrame) -> DataFrame:
    """Mean units per sale of each genre; 5 when that mean is NULL or 0. Sales
    are summed per book before the catalogue joins."""
    sold = fact_sales.groupBy("book_id").agg(F.sum("quantity").alias("q"), F.count("quantity").alias("n"))
    j = sold.join(dim_books.select("book_id", "genre"), "book_id")
    avg = F.try_divide(F.sum("q").cast("double"), F.sum("n"))
    return j.groupBy("genre").agg(
        F.coalesce(F.nullif(avg, F.lit(0.0)), F.lit(5.0)).alias("avg_demand"))


def seasonal_forecast(dim_books: DataFrame, genre_avg: DataFrame, days: int = 7,
                      noise: float = 1.0) -> DataFrame:
    """demand(d) = max(1, int(avg * (1 + 0.1 sin(2 pi d / 7)) * noise)) for
    every book and day 1..days, with bounds max(1, int(0.7 x)) and
    int(1.3 x). The random noise of the source is a fixed parameter here."""
    if not 1 <= days <= 366:
        raise ValueError("days must be in 1..366")
    g = genre_avg.select(F.col("genre").alias("_g"), "avg_demand")
    books = dim_books.select("book_id", "genre").join(g, F.col("genre") == F.col("_g"), "left")
    books = books.select("book_id", F.coalesce("avg_demand", F.lit(5.0)).alias("avg_demand"))
    d = F.col("day")
    per_day = books.select("book_id", "avg_demand", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("day"))
    factor = F.lit(1.0) + F.lit(0.1) * F.sin(F.lit(2 * math.pi) * d / F.lit(7.0))
    demand = F.greatest(F.lit(1), (F.col("avg_demand") * factor * F.lit(float(noise))).cast("int"))
    out = per_day.select("book_id", "day", demand.alias("predicted_demand"))
    return out.select(
        "book_id", "day", "predicted_demand",
        F.greatest(F.lit(1), (F.col("predicted_demand") * F.lit(0.7)).cast("int")).alias("confidence_lower"),
        (F.col("predicted_demand") * F.lit(1.3)).cast("int").alias("confidence_upper"))


def forecast_summary(forecast: DataFrame, value: str = "predicted_demand") -> DataFrame:
    """Mean, total and peak day (first day on a tie) per book."""
    v = F.col(value)
    peak = F.max(F.struct(v.alias("v"), (-F.col("day")).alias("nd")))
    return forecast.groupBy("book_id").agg(
        F.avg(v).alias("avg_demand"),
        F.sum(v).cast("double").alias("total_demand"),
        (-peak.getField("nd")).cast("int").alias("peak_day"))
