"""Registered queries of the daily models kept up to date over several loads."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from inkwell.operators import maintenance as MV
from inkwell.plans import oracle as O
from inkwell.plans.registry import register
from inkwell.session import scratch_dir

LATE, WRONG, CANCELLED = 7, 11, 13  # every so many books: sales that come late, with a wrong day, or are cancelled
LATE_DAYS = ("2001-03-01", "2001-06-30")
WRONG_DAYS = ("2000-05-01", "2000-05-31")
MOVED_BY = 45


def _maintained(m, model, dimension=None):
    """The model after three loads. The base lacks the late sales, has some on
    wrong days and some that are later cancelled; load 1 brings the late ones,
    load 2 the corrections, load 3 the cancellations. The facts then are those of
    the fact table."""
    spark, date = m.spark, lambda d: F.lit(d).cast("date")
    book, day = F.col("book_id"), F.col("sale_date")
    late = (book % LATE == 0) & day.between(*map(date, LATE_DAYS))
    wrong = (book % WRONG == 0) & day.between(*map(date, WRONG_DAYS))

    def dated(rows, by):
        rows = rows.withColumn("sale_date", F.date_add("sale_date", by))
        return rows.withColumns({"sale_year": F.year("sale_date"), "sale_month": F.month("sale_date")})

    # Every load and the base read the facts several times; their joins run once.
    path = scratch_dir(spark, f"maintained-{uuid.uuid4().hex}")
    m.fact_sales.drop("transaction_id").write.parquet(f"{path}/facts")
    true = spark.read.parquet(f"{path}/facts")
    mistaken = true.where(~wrong).unionByName(dated(true.where(wrong), MOVED_BY))
    # Sold, and later cancelled: a second copy of sales of the wrong books, ten days on.
    void = dated(true.where((book % CANCELLED == 0) & day.between(*map(date, WRONG_DAYS))), 10)
    MV.start(spark, path, model, mistaken.where(~late).unionByName(void))
    loads = [
        (mistaken.unionByName(void), [true.where(late), mistaken.where(late)]),
        (true.unionByName(void), [true.where(wrong), dated(true.where(wrong), MOVED_BY)]),
        (true, [void]),
    ]
    for load, (facts, sales) in enumerate(loads, 1):
        MV.refresh(spark, path, model, facts, MV.changed_keys(model, *sales), load)
    return MV.current(spark, path, model, dimension)


register("sales_performance_maintained", O.model("sales_performance_daily"))(
    lambda m: _maintained(m, MV.SALES_PERFORMANCE))
register("demand_features_maintained", O.model("demand_forecasting_features"))(
    lambda m: _maintained(m, MV.DEMAND_FEATURES, m.dim_books))
