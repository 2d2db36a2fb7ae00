"""Registered queries: key -> (Spark builder over ``Models``, oracle SQL).

A builder takes a ``Models`` (the lazily built DAG over one data folder)
and returns a DataFrame; the oracle is the DuckDB statement of the same
result, or None for results that are checked by rows and invariants only
(model training, randomised or stateful streaming output).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from inkwell.plans import oracle as O
from inkwell.plans.models import Models


@dataclass(frozen=True)
class Query:
    key: str
    build: Callable[[Models], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(key: str, sql: str | None):
    def wrap(fn: Callable[[Models], DataFrame]):
        REGISTRY[key] = Query(key, fn, sql)
        return fn
    return wrap


def _model_query(key: str, attr: str | None = None) -> None:
    attr = attr or key
    register(key, O.model(key))(lambda m, a=attr: getattr(m, a))


# The 14 models and their building blocks, one key each.
for _k in ("stg_books", "stg_publishers", "stg_inventory", "stg_sales",
           "dim_publishers", "dim_books", "fact_sales",
           "sales_performance_daily", "inventory_optimization",
           "book_features", "demand_forecasting_features", "daily_demand",
           "ab_test_base", "ab_test_summary", "ab_test_lift_analysis"):
    _model_query(_k)

from inkwell.operators import analytics as _an, features as _fe  # noqa: E402

register("sales_daily_rollup", O.model("sales_daily_rollup"))(
    lambda m: _an.sales_daily_rollup(m.fact_sales))
register("sales_velocity_30d", O.model("sales_velocity_30d"))(
    lambda m: _an.sales_velocity_30d(m.fact_sales, m.as_of))
register("book_sales_metrics", O.model("book_sales_metrics"))(
    lambda m: _fe.book_sales_metrics(m.fact_sales))
register("recent_performance_30d", O.model("recent_performance_30d"))(
    lambda m: _fe.recent_performance_30d(m.fact_sales, m.as_of))
register("active_book_features", O.build("""
SELECT book_id, genre, length_category, price_category, recency_category, publisher_type,
  avg_selling_price, total_quantity_sold, velocity_score
FROM book_features WHERE total_transactions > 0""", "book_features"))(
    lambda m: _fe.active_book_features(m.book_features))

