"""Request limits, ties in the metric log, empty landings, the entry without optional libraries."""

import datetime as dt
import subprocess
import sys

import pytest

from inkwell.operators import forecast, metrics, recommend
from inkwell.streaming import loaders


@pytest.mark.parametrize("n", [0, -1, 51, 1000])
def test_list_lengths_out_of_range(n):
    with pytest.raises(ValueError):
        recommend.check_n(n)


@pytest.mark.parametrize("n", [1, 50])
def test_list_lengths_in_range(n):
    recommend.check_n(n)


def test_latest_metric_of_equal_times(spark):
    t = dt.datetime(2001, 1, 1)
    rows = [("m", t, "rmse", v) for v in (2.0, 5.0, None, 3.0)] + [("m", None, "rmse", 9.0), ("n", None, "mae", 1.0)]
    log = spark.createDataFrame(rows, "model_name string, ts timestamp, metric string, value double")
    for part in (1, 3):
        got = {(r.model_name, r.metric): r.value for r in metrics.latest_metrics(log.repartition(part)).collect()}
        assert got == {("m", "rmse"): 5.0, ("n", "mae"): 1.0}


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_landing_without_times(spark, tmp_path, rows):
    frame = spark.createDataFrame(rows, "id int, ts timestamp")
    folder = loaders.land_in_time_order(frame, "ts", str(tmp_path / "in"))
    assert spark.read.schema("id int, ts timestamp").parquet(folder).count() == len(rows)


def test_entry_without_a_library_of_the_optional_part():
    code = ("import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; "
            "assert len(e.queries()) > 100 and not any(k.startswith('op') and k[2].isdigit() for k in e.queries())")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/", 2)[0], timeout=120)


@pytest.mark.parametrize("days", [0, -3, forecast.MAX_DAYS + 1])
def test_forecast_days_out_of_range(days):
    with pytest.raises(ValueError):
        forecast.check_days(days)
    assert forecast.check_days(1) == 1 and forecast.check_days(forecast.MAX_DAYS) == forecast.MAX_DAYS


def test_every_list_checks_its_length(spark):
    from inkwell.operators.extras import als_recommendations
    inter = spark.createDataFrame([("u", 1, 1.0)], "user_id string, book_id long, rating double")
    with pytest.raises(ValueError):
        als_recommendations(inter, n=0)
    with pytest.raises(ValueError):
        forecast.demand_forecast_default(inter, inter, days=0)
