"""Forests on small frames: what is scored, and how they are fitted."""

import datetime as dt
from types import SimpleNamespace

import pytest

from inkwell.operators import forecast as FC
from inkwell.plans.catalog import REGISTRY


@pytest.fixture(scope="module")
def frame(spark):
    """40 days of three books and 3 days of a fourth, whose rows lack lags and means."""
    day = lambda i: dt.date(2001, 1, 1) + dt.timedelta(days=i)
    rows = [(b, day(i), 1 + (3 * i + b) % 11) for b in range(4) for i in range(3 if b == 3 else 40)]
    daily = spark.createDataFrame(rows, "book_id long, sale_date date, daily_quantity long")
    books = spark.createDataFrame([(b, 10.0 + b, 100 * b + 16) for b in range(4)],
                                  "book_id long, price double, page_count int")
    return FC.split_flag(FC.demand_training_frame(daily, books)).checkpoint()


def test_every_row_is_scored(spark, frame):
    """Rows with missing features are scored, too: what is missing reads as 0."""
    model = FC.fit_forest(FC.complete_rows(frame), num_trees=3, max_depth=3)
    got = REGISTRY["demand_rf_scores"].build(SimpleNamespace(forest=(model, frame, None, None))).collect()
    assert len(got) == 123 == len({(r.book_id, r.sale_date) for r in got})
    assert {r.book_id for r in got} == {0, 1, 2, 3}
    filled = {(r.book_id, r.sale_date): r.prediction
              for r in model.transform(frame.na.fill(0, subset=FC.FEATURES)).collect()}
    assert {(r.book_id, r.sale_date): r.prediction for r in got} == filled


def test_trees_are_fitted_in_parts(spark, frame, tmp_path):
    """A forest too large for one fit has all its trees, from fits of a few, and is scored and stored like any other."""
    train = FC.complete_rows(frame)
    n = train.count()
    assert FC._parts(100, n, FC.FIT_CELLS) == [100]
    assert FC._parts(100, 22_000_000, FC.FIT_CELLS) == [12] + [11] * 8
    assert FC._parts(7, 10 ** 9, 1) == [3, 2, 2] and FC._parts(1, 10 ** 9, 1) == [1]
    seen, fit = [], FC.RandomForestRegressor.fit
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(FC.RandomForestRegressor, "fit", lambda self, rows, own=None: (
            seen.append((own[self.numTrees], own[self.seed])), fit(self, rows, own))[1])
        model = FC.fit_forest(train, num_trees=11, max_depth=4, seed=1, cells=4 * n)
    assert seen == [(4, 1), (4, 1 + FC.SEED_STEP), (3, 1 + 2 * FC.SEED_STEP)]
    forest = model.stages[-1]
    assert forest.getNumTrees == 11 == len(forest.trees)
    assert len({t.toDebugString.split("\n", 1)[1] for t in forest.trees}) > 8  # parts do not repeat each other
    one = train.limit(1)
    x = model.stages[0].transform(one).first().features
    assert model.transform(one).first().prediction == pytest.approx(sum(t.predict(x) for t in forest.trees) / 11)
    assert abs(sum(v for _, v in FC.feature_importance(model)) - 1) < 1e-9
    FC.save_forest(model, str(tmp_path / "forest"))
    rows = lambda m: sorted(map(tuple, FC.score(m, frame).collect()))
    assert rows(FC.load_forest(str(tmp_path / "forest"))) == rows(model)
