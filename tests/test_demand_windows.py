"""The windows of the demand features against sums over the frames, and what they sort."""

import datetime as dt
import math
import random

from inkwell.operators import features as FE
from inkwell.session import JOB_CONF

SCHEMA = "book_id long, sale_date date, daily_quantity long, daily_revenue double, daily_transactions long"


def _rows():
    rnd = random.Random(5)
    first = dt.date(2000, 1, 1)
    return [(book, first + dt.timedelta(days=i * (1 + book % 3)), rnd.choice([None, 0, -2, 1, 5, 40]), 1.5, 1)
            for book in (1, 2, 3) for i in range(70)] + [(4, first, None, 1.0, 1), (5, first, 7, 1.0, 1)]


def test_windows_equal_sums_over_the_frames(spark):
    rows = _rows()
    got = {(r.book_id, r.sale_date): r for r in FE.demand_windows(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    for book in (1, 2, 3, 4, 5):
        mine = [r for r in rows if r[0] == book]
        for i, r in enumerate(mine):
            have = got[(book, r[1])]
            seen = lambda n: [x[2] for x in mine[max(0, i - n + 1):i + 1] if x[2] is not None]
            lag = lambda n: mine[i - n][2] if i >= n else None
            assert [have.quantity_lag_1, have.quantity_lag_7, have.quantity_lag_30] == [lag(1), lag(7), lag(30)]
            for n, value in ((7, have.quantity_ma_7), (30, have.quantity_ma_30)):
                assert value == (sum(seen(n)) / len(seen(n)) if seen(n) else None)
            q = seen(7)
            std = math.sqrt((len(q) * sum(x * x for x in q) - sum(q) ** 2) / (len(q) * (len(q) - 1))) if len(q) > 1 else None
            assert have.quantity_std_7 == std
            assert (have.year, have.month, have.day) == (r[1].year, r[1].month, r[1].day)


def test_windows_sum_no_frame_again_and_sort_only_the_series(spark, capsys):
    df = FE.demand_windows(spark.createDataFrame(_rows(), SCHEMA))
    df.explain()
    plan = capsys.readouterr().out
    assert "-29" not in plan  # no frame of 30 rows is summed for every row
    assert plan.count("Sort [") == plan.count("Exchange hashpartitioning") == 1
    below = plan[plan.index("Sort ["):]
    assert "week" not in below.lower() and "year(" not in below.lower()


def test_partitions_are_merged_to_a_few_megabytes():
    assert JOB_CONF["spark.sql.adaptive.advisoryPartitionSizeInBytes"] == "8m"
