"""ML feature tables: book_features and demand_forecasting_features."""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.columns import MONEY, UNIT, as_of_lit, days_between, exact_avg, exact_sum, since, sql_day_of_week


def book_sales_metrics(fact_sales: DataFrame) -> DataFrame:
    """Lifetime metrics per book. Sales are summed per (book, channel, region)
    first: the few groups of a book carry its distinct values, so the distinct
    counts need no copies of the fact rows and a hot book is spread."""
    fact_sales = fact_sales.groupBy("book_id", "channel", "region").agg(
        F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"),
        *[x for c, kind in (("total_amount", MONEY), ("unit_price", UNIT), ("discount_percent", MONEY))
          for x in (F.sum(F.col(c).cast(kind)).alias(c), F.count(c).alias(f"{c}_n"))],
        F.min("sale_date").alias("first_date"), F.max("sale_date").alias("last_date"))

    def mean(c: str) -> Column:
        return F.try_divide(F.sum(c).cast("double"), F.sum(f"{c}_n"))

    return fact_sales.groupBy("book_id").agg(
        F.sum("n").alias("total_transactions"),
        F.sum("quantity").alias("total_quantity_sold"),
        F.sum("total_amount").cast("double").alias("total_revenue"),
        mean("total_amount").alias("avg_transaction_value"),
        mean("unit_price").alias("avg_selling_price"),
        mean("discount_percent").alias("avg_discount"),
        F.size(F.collect_set("channel")).cast("bigint").alias("num_channels"),
        F.size(F.collect_set("region")).cast("bigint").alias("num_regions"),
        F.min("first_date").alias("first_sale_date"),
        F.max("last_date").alias("last_sale_date"),
    )


def recent_performance_30d(fact_sales: DataFrame, as_of: _dt.date | str | None = None,
                           days: int = 30) -> DataFrame:
    recent = since(fact_sales, as_of, days)
    return recent.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("transactions_last_30d"),
        F.sum("quantity").alias("quantity_sold_last_30d"),
        exact_sum("total_amount").alias("revenue_last_30d"),
    )


def book_features(dim_books: DataFrame, dim_publishers: DataFrame, fact_sales: DataFrame,
                  as_of: _dt.date | str | None = None, min_transactions: int | None = None,
                  run_ts: str | None = None) -> DataFrame:
    """One feature row per book: attributes, lifetime and 30-day sales,
    derived ratios, and the load stamp ``run_ts`` if there is one. Both
    sales aggregates are one row per book before joining, so the three
    book_id joins share one partitioning."""
    today = as_of_lit(as_of)
    sm = book_sales_metrics(fact_sales).alias("sm")
    rp = recent_performance_30d(fact_sales, as_of).alias("rp")
    b = dim_books.alias("b")
    p = dim_publishers.select("publisher_id", "publisher_type", "publisher_era", "publisher_size").alias("p")
    joined = (b.join(p, F.col("b.publisher_id") == F.col("p.publisher_id"), "left")
               .join(sm, F.col("b.book_id") == F.col("sm.book_id"), "left")
               .join(rp, F.col("b.book_id") == F.col("rp.book_id"), "left"))
    tt = F.col("sm.total_transactions")
    zero = F.lit(0)
    out = joined.select(
        "b.book_id", "b.isbn", "b.title", "b.genre", "b.publication_year", "b.page_count",
        "b.price", "b.format", "b.language", "b.length_category", "b.price_category",
        "b.recency_category", "b.publisher_id", "p.publisher_type", "p.publisher_era",
        "p.publisher_size",
        F.coalesce(tt, zero).cast("bigint").alias("total_transactions"),
        F.coalesce(F.col("sm.total_quantity_sold"), zero).cast("bigint").alias("total_quantity_sold"),
        F.coalesce(F.col("sm.total_revenue"), F.lit(0.0)).alias("total_revenue"),
        F.coalesce(F.col("sm.avg_transaction_value"), F.lit(0.0)).alias("avg_transaction_value"),
        F.coalesce(F.col("sm.avg_selling_price"), F.col("b.price")).alias("avg_selling_price"),
        F.coalesce(F.col("sm.avg_discount"), F.lit(0.0)).alias("avg_discount"),
        F.coalesce(F.col("sm.num_channels"), zero).cast("bigint").alias("num_channels"),
        F.coalesce(F.col("sm.num_regions"), zero).cast("bigint").alias("num_regions"),
        F.coalesce(F.col("rp.transactions_last_30d"), zero).cast("bigint").alias("transactions_last_30d"),
        F.coalesce(F.col("rp.quantity_sold_last_30d"), zero).cast("bigint").alias("quantity_sold_last_30d"),
        F.coalesce(F.col("rp.revenue_last_30d"), F.lit(0.0)).alias("revenue_last_30d"),
        F.when(tt > 0, F.col("sm.total_quantity_sold").cast("double") / tt)
         .otherwise(F.lit(0.0)).alias("avg_quantity_per_transaction"),
        days_between(today, F.col("sm.first_sale_date")).alias("days_since_first_sale"),
        days_between(today, F.col("sm.last_sale_date")).alias("days_since_last_sale"),
        F.when(F.coalesce(tt, zero) > 0,
               F.coalesce(F.col("rp.transactions_last_30d"), zero) * F.lit(12.0) / tt)
         .otherwise(F.lit(0.0)).alias("velocity_score"),
        F.when(F.col("b.page_count") > 0, F.col("b.price") / F.col("b.page_count"))
         .otherwise(F.lit(0.0)).alias("price_per_page"),
        ((F.year(today) - F.col("b.publication_year")) * 12 + F.month(today)).cast("int")
        .alias("book_age_months"),
        *([] if run_ts is None else [F.lit(run_ts).cast("timestamp_ntz").alias("feature_created_at")]),
    )
    if min_transactions is not None:
        out = out.where(F.col("total_transactions") >= min_transactions)
    return out


def active_book_features(book_features_df: DataFrame) -> DataFrame:
    """Books with at least one sale, projected for exploration."""
    return book_features_df.where(F.col("total_transactions") > 0).select(
        "book_id", "genre", "length_category", "price_category", "recency_category",
        "publisher_type", "avg_selling_price", "total_quantity_sold", "velocity_score")


def daily_demand(fact_sales: DataFrame) -> DataFrame:
    """Demand per (book, day). Grouping on both keys spreads a best-seller
    over its days instead of one task."""
    return fact_sales.groupBy("book_id", "sale_date").agg(
        F.sum("quantity").alias("daily_quantity"),
        exact_sum("total_amount").alias("daily_revenue"),
        F.count(F.lit(1)).alias("daily_transactions"),
    )


def _stddev_of(values: list[Column]) -> Column:
    """Sample stddev of the non-null ``values`` from exact integer sums
    (n*sum(x^2) - sum(x)^2 is computed in BIGINT), NULL below two."""
    def total(x):
        return reduce(lambda a, b: a + b, [F.coalesce(x(v), F.lit(0)).cast("bigint") for v in values])

    n = total(lambda v: v.isNotNull().cast("int"))
    s1, s2 = total(lambda v: v), total(lambda v: v * v)
    var = (n * s2 - s1 * s1).cast("double") / (n * (n - 1)).cast("double")
    return F.when(n > 1, F.sqrt(var))


def demand_forecasting_features(daily: DataFrame, dim_books: DataFrame) -> DataFrame:
    """Calendar, window and growth features per book series, with the book's attributes."""
    return with_book_attributes(demand_windows(daily), dim_books)


def demand_windows(daily: DataFrame) -> DataFrame:
    """Calendar, lag (by rows, not days), moving average, rolling stddev
    and growth features per book series; all windows share one
    partition/order spec, so they run as one sort per partition. A row costs
    the same however long its frames are: a moving average is the difference
    of two running sums, not a sum over the frame of every row again. The
    sort carries only the columns of the series; the parts of the date are
    taken after it."""
    w = Window.partitionBy("book_id").orderBy("sale_date")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    q = F.col("daily_quantity")
    lags = [F.lag(q, i).over(w).alias(f"quantity_lag_{i}") for i in (1, 2, 3, 4, 5, 6, 7, 30)]
    ts = daily.select(
        "book_id", "sale_date", "daily_quantity", "daily_revenue", "daily_transactions", *lags,
        F.coalesce(F.sum(q).over(upto), F.lit(0)).alias("_sum"), F.count(q).over(upto).alias("_n"))
    ts = ts.select("*", *[F.lag(c, rows, 0).over(w).alias(f"{c}_{rows}") for rows in (7, 30) for c in ("_sum", "_n")])

    def mean(rows: int) -> Column:
        n = F.col("_n") - F.col(f"_n_{rows}")
        return F.when(n > 0, (F.col("_sum") - F.col(f"_sum_{rows}")).cast("double") / n)

    d, lag1, lag7 = F.col("sale_date"), F.col("quantity_lag_1"), F.col("quantity_lag_7")
    return ts.select(
        "book_id", "sale_date", "daily_quantity", "daily_revenue", "daily_transactions",
        F.year(d).alias("year"), F.month(d).alias("month"), F.dayofmonth(d).alias("day"),
        sql_day_of_week(d).alias("day_of_week"), F.weekofyear(d).alias("week_of_year"),
        F.quarter(d).alias("quarter"), "quantity_lag_1", "quantity_lag_7", "quantity_lag_30",
        mean(7).alias("quantity_ma_7"), mean(30).alias("quantity_ma_30"),
        _stddev_of([q, *[F.col(f"quantity_lag_{i}") for i in range(1, 7)]]).alias("quantity_std_7"),
        F.when(lag1 > 0, (q - lag1) / lag1 * 100).alias("quantity_growth_rate_1d"),
        F.when(lag7 > 0, (q - lag7) / lag7 * 100).alias("quantity_growth_rate_7d"),
    )


def with_book_attributes(ts: DataFrame, dim_books: DataFrame) -> DataFrame:
    ts = ts.alias("t")
    bc = dim_books.select("book_id", "genre", "format", "price_category", "publication_year").alias("bc")
    return ts.join(bc, F.col("t.book_id") == F.col("bc.book_id"), "left").select(
        "t.*", "bc.genre", "bc.format", "bc.price_category", "bc.publication_year")
