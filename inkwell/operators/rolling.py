"""Rolling windows from day buckets.

A bucket holds what one day adds to the popularity lists: units, priced sales
and prices paid by book and customer type, as exact sums. Any window is the
sum of its days, so lists of many windows and dates read the buckets (at most
one row a day, book and type) instead of the sales. A load rewrites the buckets
of the days it touches. Distinct numbers of books and customers, which do not
add up, have mergeable HLL sketches of each day beside them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions.columns import UNIT
from inkwell.operators.incremental import read_table, touched_partitions

#: log2 of a sketch's registers: the relative standard error is about 1.04 / 2^(LG / 2), 1.6 % at 12.
SKETCH_LG = 12
_MONTH = ("month",)


def day_buckets(fact_sales: DataFrame) -> DataFrame:
    """(month, sale_date, book_id, customer_type, units, priced, paid). Sales
    without a date are in no window and in no bucket."""
    sales = fact_sales.where(F.col("sale_date").isNotNull())
    out = sales.groupBy("sale_date", "book_id", "customer_type").agg(
        F.sum("quantity").cast("long").alias("units"), F.count("unit_price").alias("priced"),
        F.sum(F.col("unit_price").cast(UNIT)).cast("decimal(38,8)").alias("paid"))
    return out.select(F.date_format("sale_date", "yyyy-MM").alias("month"), "*")


def write_days(spark: SparkSession, path: str, fact_sales: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Write the buckets of ``fact_sales`` by month; with ``days`` (sale_date: the
    days that a load touched) only the months of these days are computed and
    written again, from the facts that stand then."""
    if days is not None and read_table(spark, path) is not None:
        months = days.select(F.date_format("sale_date", "yyyy-MM").alias("month")).where("month IS NOT NULL").distinct()
        sales = fact_sales.withColumn("month", F.date_format("sale_date", "yyyy-MM"))
        fact_sales = touched_partitions(sales, months, _MONTH)
    (day_buckets(fact_sales).hint("rebalance", "month").write.mode("overwrite")
     .option("partitionOverwriteMode", "static" if days is None else "dynamic")
     .partitionBy("month").parquet(path))
    return read_days(spark, path)


def read_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("sale_date date, book_id long, customer_type string, units long, priced long, "
                             "paid decimal(38,8), month string").parquet(path)


def popular(days: DataFrame, dim_books: DataFrame, windows: DataFrame, n: int = 100) -> DataFrame:
    """(as_of, days, rank, book_id, total_sales, unique_customers, avg_price): the
    n best-selling catalogue books of each window (as_of, days), a window being the
    ``days`` days before ``as_of``, that day and all later ones, as in the lists
    over the sales. ``windows`` is a short table given by the caller."""
    first = windows.agg(F.min(F.date_sub("as_of", F.col("days")))).first()[0]
    rows = days.where(F.col("sale_date") >= F.lit(first)).where(F.col("month") >= F.date_format(F.lit(first), "yyyy-MM"))
    inside = F.col("sale_date") >= F.date_sub("as_of", F.col("days"))
    per = (rows.join(F.broadcast(windows), inside).groupBy("as_of", "days", "book_id").agg(
        F.sum("units").alias("total_sales"), F.count_distinct("customer_type").alias("unique_customers"),
        (F.sum("paid").cast("double") / F.nullif(F.sum("priced"), F.lit(0))).alias("avg_price"))
        .join(dim_books.select("book_id"), "book_id", "left_semi"))
    order = Window.partitionBy("as_of", "days").orderBy(
        F.col("total_sales").desc(), F.col("unique_customers").desc(), "book_id")
    return per.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def day_sketches(fact_sales: DataFrame) -> DataFrame:
    """(sale_date, sales, books, customers): each day's sales and HLL sketches."""
    return fact_sales.where(F.col("sale_date").isNotNull()).groupBy("sale_date").agg(
        F.count(F.lit(1)).alias("sales"), F.hll_sketch_agg("book_id", F.lit(SKETCH_LG)).alias("books"),
        F.hll_sketch_agg("customer_type", F.lit(SKETCH_LG)).alias("customers"))


def distinct_in(sketches: DataFrame, first, last) -> DataFrame:
    """One row (sales, num_books, num_customers) of the days from ``first`` to
    ``last``: sales are exact, the distinct numbers estimates (see ``SKETCH_LG``)."""
    days = sketches.where(F.col("sale_date").between(F.lit(str(first)).cast("date"), F.lit(str(last)).cast("date")))
    return days.agg(F.coalesce(F.sum("sales"), F.lit(0)).alias("sales"),
                    F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("books")), F.lit(0)).alias("num_books"),
                    F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("customers")), F.lit(0)).alias("num_customers"))
