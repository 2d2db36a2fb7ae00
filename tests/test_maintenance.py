"""Daily models after several loads against a full run over the same facts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from inkwell.operators import features
from inkwell.operators import maintenance as MV

SCHEMA = ("id long, book_id long, genre string, channel string, region string, sale_date date, quantity int, "
          "unit_price double, discount_percent double, total_amount double")


def sales(spark, n=6000, books=60, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        book, q = rng.randrange(books), rng.randrange(1, 5)
        rows.append((i, book, rng.choice(["a", None]), f"c{book % 6}", rng.choice("xy"),
                     dt.date(2001, 1, 1) + dt.timedelta(days=rng.randrange(120)), q, 2.5, 0.0, 2.5 * q))
    rows.append((n, None, None, None, None, None, 1, 1.0, 0.0, 1.0))
    out = spark.createDataFrame(rows, SCHEMA)
    return out.withColumns({"sale_year": F.year("sale_date"), "sale_month": F.month("sale_date")}).checkpoint()


def as_rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


MODELS = [MV.SALES_PERFORMANCE, MV.DEMAND_FEATURES]


@pytest.mark.parametrize("model", MODELS, ids=["performance", "demand"])
def test_loads_end_as_a_full_run(spark, tmp_path, model):
    path, facts = str(tmp_path), sales(spark)
    full = lambda f: model.windows(model.rollup(f))
    late = F.coalesce((F.col("book_id") % 20 == 3) & (F.col("sale_date") > "2001-02-15"), F.lit(False))
    MV.start(spark, path, model, facts.where(~late))
    assert as_rows(MV.current(spark, path, MV.DailyModel(**{**vars(model), "attributes": None}))) == as_rows(
        full(facts.where(~late)))
    plain = MV.DailyModel(**{**vars(model), "attributes": None})
    # Late sales, some of which open new days and series.
    MV.refresh(spark, path, plain, facts, MV.changed_keys(plain, facts.where(late)), 1)
    assert as_rows(MV.current(spark, path, plain)) == as_rows(full(facts))
    # A whole series and the first, middle and last days of others go; one day changes; the null key goes, too.
    gone = F.col("book_id").isNull() | (F.col("book_id") == 5) | (
        (F.col("book_id") % 10 == 1) & F.dayofmonth("sale_date").isin(1, 2, 15, 30))
    extra = F.when((F.col("book_id") == 8) & (F.col("sale_date") == "2001-02-03"), 3).otherwise(0)
    after = facts.where(~gone).withColumn("quantity", (F.col("quantity") + extra).cast("int")).checkpoint()
    changed = MV.changed_keys(plain, facts.where(gone), after.where(extra > 0))
    for _ in range(2):  # repeated after a failure
        MV.refresh(spark, path, plain, after, changed, 2)
        assert as_rows(MV.current(spark, path, plain)) == as_rows(full(after))
    # Nothing changes; older loads stay readable; a compacted table is the same.
    MV.refresh(spark, path, plain, after, changed.limit(0), 3)
    assert as_rows(MV.current(spark, path, plain)) == as_rows(full(after))
    assert as_rows(MV.table(spark, f"{path}/rows", plain, 1)) == as_rows(full(facts))
    MV.compact(spark, path, f"{path}/new", plain)
    assert as_rows(MV.current(spark, f"{path}/new", plain)) == as_rows(full(after))


def test_only_stale_rows_are_written(spark, tmp_path):
    path, facts, model = str(tmp_path), sales(spark, 20_000, 100), MV.DEMAND_FEATURES
    MV.start(spark, path, model, facts)
    one = (F.col("book_id") == 42) & (F.col("sale_date") == "2001-03-01")
    after = facts.withColumn("quantity", (F.col("quantity") + F.when(one, 9).otherwise(0)).cast("int"))
    MV.refresh(spark, path, model, after, MV.changed_keys(model, after.where(one)), 1)
    rows = spark.read.parquet(f"{path}/rows")
    assert rows.where("_load = 0").count() > 7000
    assert 1 <= rows.where("_load = 1").count() <= 1 + model.reach
    assert spark.read.parquet(f"{path}/daily").where("_load = 1").count() <= 1


def test_no_facts_then_some_and_attributes_stay_fresh(spark, tmp_path):
    path, facts, model = str(tmp_path), sales(spark, 300, 5), MV.DEMAND_FEATURES
    books = facts.select("book_id").distinct().withColumns(
        {c: F.lit("old") for c in ("genre", "format", "price_category")} | {"publication_year": F.lit(1990)})
    MV.start(spark, path, model, facts.limit(0))
    assert MV.current(spark, path, model, books).count() == 0
    MV.refresh(spark, path, model, facts, MV.changed_keys(model, facts), 1)
    new = books.withColumn("genre", F.lit("new"))
    assert as_rows(MV.current(spark, path, model, new)) == as_rows(
        features.demand_forecasting_features(features.daily_demand(facts), new))
    with pytest.raises(ValueError):
        MV.refresh(spark, path, model, facts, MV.changed_keys(model, facts), 0)
    with pytest.raises(ValueError):
        MV.table(spark, f"{path}/none", model)
