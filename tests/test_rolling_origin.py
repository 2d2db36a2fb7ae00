"""Rolling-origin evaluation: what each split learns from, and its metrics."""

import datetime as dt
import math

import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from inkwell.operators import extras as X
from inkwell.operators import forecast as FC


@pytest.fixture(scope="module")
def frame(spark, models):
    return FC.demand_training_frame(models.daily_demand, models.stg_books).checkpoint()


def test_splits_learn_from_the_past_once(spark, models, frame, tmp_path):
    folds = X.time_series_folds(models.daily_demand, 4)
    rows = FC.by_fold(frame, folds, str(tmp_path / "f"))
    assert rows.count() == FC.complete_rows(frame).count()
    fitted = []

    def fit(train):
        fitted.append(train.agg(F.max("sale_date"), F.max("fold"), F.count(F.lit(1))).first())
        return FC.fit_forest(train, num_trees=3, max_depth=3)

    got = FC.rolling_origin(rows, 4, fit).checkpoint()
    assert sorted(f[1] for f in fitted) == [1, 2, 3]  # no model twice
    last = {f[1]: f[0] for f in fitted}
    per = {r.split: r for r in FC.rolling_origin_metrics(rows, got).collect()}
    size = {r.fold: r["count"] for r in rows.groupBy("fold").count().collect()}
    mine = {}
    for r in got.collect():
        assert r.sale_date > last[r.split]
        mine.setdefault(r.split, []).append(r.label - r.prediction)
    assert sorted(per) == sorted(mine) == [1, 2, 3]
    for s, errors in mine.items():
        assert per[s].mae == pytest.approx(sum(map(abs, errors)) / len(errors))
        assert per[s].rmse == pytest.approx(math.sqrt(sum(e * e for e in errors) / len(errors)))
        assert (per[s].train_samples, per[s].test_samples) == (sum(size[f] for f in range(1, s + 1)), size[s + 1])
        assert len(errors) == size[s + 1]


def test_folds_without_rows(spark, frame, tmp_path):
    days = spark.createDataFrame([(dt.date(1900, 1, 1), 1)], "sale_date date, fold int")
    rows = FC.by_fold(frame, days, str(tmp_path / "f"))
    none = FC.rolling_origin(rows, 3)
    assert none.count() == 0 and FC.rolling_origin_metrics(rows, none).count() == 0


def test_levels_do_not_walk_the_trees_again(spark):
    days = [(b, dt.date(2001, 1, 1) + dt.timedelta(d), (7 * b + d * d) % 11, 10.0 + b, 100 + b)
            for b in range(4) for d in range(30)]
    sold = spark.createDataFrame(days, "book_id long, sale_date date, daily_quantity long, price double, page_count int")
    train = FC.complete_rows(FC.demand_training_frame(sold.drop("price", "page_count"),
                                                      sold.select("book_id", "price", "page_count").distinct()))
    model = FC.fit_forest(train, num_trees=3, max_depth=4)
    assert model.stages[-1].getOrDefault("cacheNodeIds")
    # The forest is the one that walks from the root.
    plain = RandomForestRegressor(labelCol=FC.TARGET, numTrees=3, maxDepth=4, seed=42)
    walked = plain.fit(model.stages[0].transform(train))
    assert model.stages[-1].toDebugString.split("\n")[1:] == walked.toDebugString.split("\n")[1:]
