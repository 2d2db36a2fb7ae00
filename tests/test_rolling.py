"""Windows from day buckets against the sales themselves."""

import datetime as dt
import random

from pyspark.sql import functions as F

from inkwell.operators import recommend as R
from inkwell.operators import rolling as RO


def sales(spark, n=3000, books=400):
    rng = random.Random(3)
    rows = [(rng.randrange(books), rng.choice("abc"), rng.choice([None, 1.5, 2.25]), rng.randrange(1, 5),
             dt.date(2001, 1, 1) + dt.timedelta(days=rng.randrange(200))) for _ in range(n)]
    return spark.createDataFrame([*rows, (1, "a", 1.0, 1, None)],
                                 "book_id long, customer_type string, unit_price double, quantity int, sale_date date")


def test_lists_equal_those_over_the_sales(spark, tmp_path):
    facts = sales(spark).checkpoint()
    books = facts.select("book_id").distinct().where("book_id % 7 <> 0").withColumns(
        {c: F.lit("x") for c in ("title", "author", "genre")} | {"price": F.lit(1.0)})
    path, late = str(tmp_path / "d"), F.col("sale_date") >= "2001-06-10"
    RO.write_days(spark, path, facts.where(~late))
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "d").rglob("*.parquet")}
    days = RO.write_days(spark, path, facts, facts.where(late).select("sale_date"))
    assert all(f.stat().st_mtime_ns == t for f, t in before.items() if f.exists() and "2001-06" not in str(f))
    windows = spark.createDataFrame([(dt.date(2001, 7, 1), 90), (dt.date(2001, 7, 1), 20)], "as_of date, days int")
    got = RO.popular(days, books, windows, 30)
    for d in (90, 20):
        want = R.popular_items(books, facts, dt.date(2001, 7, 1), d, 30).collect()
        mine = got.where(F.col("days") == d).orderBy("rank").collect()
        assert [(r.book_id, r.total_sales, r.unique_customers) for r in mine] == [
            (r.book_id, r.total_sales, r.unique_customers) for r in want]


def test_sketches_merge(spark):
    facts = sales(spark, 20_000, 6000).checkpoint()
    sketches = RO.day_sketches(facts)
    for last in ("2001-02-01", "2001-07-30"):
        part = facts.where(F.col("sale_date").between(F.lit("2001-01-05").cast("date"), F.lit(last).cast("date")))
        books = part.select("book_id").distinct().count()
        got = RO.distinct_in(sketches, "2001-01-05", last).first()
        assert got.sales == part.count() and got.num_customers == 3
        assert abs(got.num_books - books) <= 0.05 * books  # three standard errors
    assert tuple(RO.distinct_in(sketches, "1990-01-01", "1990-01-02").first()) == (0, 0, 0)
