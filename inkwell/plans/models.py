"""The model DAG: raw -> staging -> marts -> analytics / features / experiments.

``Models`` exposes each model as a lazily built DataFrame. With
``store`` set, the table models (dims, fact, analytics, features) are
written once as Parquet under that folder and read back by their
consumers, as the reference materialises tables; that also cuts lineage,
so a lost executor only recomputes from the last written table.
"""

from __future__ import annotations

import datetime as _dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from inkwell.functions.columns import DEFAULT_AS_OF
from inkwell.operators import analytics, experiments, features, marts, staging
from inkwell.sources import testdata

# Models stored as tables (views stay lazy), in dependency order.
TABLE_MODELS = ("dim_publishers", "dim_books", "fact_sales", "sales_performance_daily",
                "inventory_optimization", "demand_forecasting_features", "book_features")
# Physical layout of stored tables: (sort columns, partition columns).
LAYOUTS = {"fact_sales": (("sale_date", "transaction_id"), ("sale_year", "sale_month"))}
VIEW_MODELS = ("stg_books", "stg_publishers", "stg_inventory", "stg_sales",
               "ab_test_base", "ab_test_summary", "ab_test_lift_analysis")


class Models:
    """``run_ts`` is the run's load stamp: with it the staging models, the
    fact table (20 columns) and the book features (34) carry it; without it
    results do not depend on when they were made."""

    def __init__(self, spark: SparkSession, sf_dir: str, as_of: _dt.date | str | None = None,
                 store: str | None = None, run_ts: str | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.as_of = as_of or DEFAULT_AS_OF
        self.run_ts = run_ts
        self.store = store.rstrip("/") if store else None
        self._stored: dict[str, DataFrame] = {}

    # -- raw ---------------------------------------------------------------
    def raw(self, name: str) -> DataFrame:
        return testdata.RAW_BUILDERS[name](self.spark, self.sf_dir)

    def source(self, name: str) -> DataFrame:
        return testdata.read_source(self.spark, self.sf_dir, name)

    # -- materialisation ---------------------------------------------------
    def _table(self, name: str, build) -> DataFrame:
        if self.store is None:
            return build()
        if name not in self._stored:
            path = f"{self.store}/{name}"
            df = build()
            layout = LAYOUTS.get(name)
            if layout is None:
                df.write.mode("overwrite").parquet(path)
            else:
                # Rebalanced on the partition columns: each month goes to
                # one writer task (about one file per month folder), and
                # AQE splits a hot month over several tasks, with no
                # sampling pass over the input (as a range partitioning
                # needs). Sorted by date within a task, so row groups are
                # tight on sale_date for min/max skipping.
                order, parts = layout
                (df.hint("rebalance", *parts).sortWithinPartitions(*order)
                 .write.mode("overwrite").partitionBy(*parts).parquet(path))
            self._stored[name] = self.spark.read.parquet(path).select(*df.columns)
        return self._stored[name]

    def run_all(self) -> dict[str, DataFrame]:
        """Build every model (tables written when ``store`` is set)."""
        return {n: getattr(self, n) for n in VIEW_MODELS[:4] + TABLE_MODELS + VIEW_MODELS[4:]}

    # -- staging (views) ---------------------------------------------------
    @cached_property
    def stg_books(self) -> DataFrame:
        return staging.stg_books(self.raw("books"), self.run_ts)

    @cached_property
    def stg_publishers(self) -> DataFrame:
        return staging.stg_publishers(self.raw("publishers"), self.run_ts)

    @cached_property
    def stg_inventory(self) -> DataFrame:
        return staging.stg_inventory(self.raw("inventory"), self.run_ts)

    @cached_property
    def stg_sales(self) -> DataFrame:
        return staging.stg_sales(self.raw("sales"), self.run_ts)

    # -- marts (tables) ----------------------------------------------------
    @cached_property
    def dim_publishers(self) -> DataFrame:
        return self._table("dim_publishers", lambda: marts.dim_publishers(self.stg_publishers))

    @cached_property
    def dim_books(self) -> DataFrame:
        return self._table("dim_books", lambda: marts.dim_books(self.stg_books, self.dim_publishers))

    @cached_property
    def fact_sales(self) -> DataFrame:
        return self._table("fact_sales", lambda: marts.fact_sales(self.stg_sales, self.dim_books))

    # -- analytics ---------------------------------------------------------
    @cached_property
    def sales_performance_daily(self) -> DataFrame:
        return self._table("sales_performance_daily",
                           lambda: analytics.sales_performance_daily(self.fact_sales))

    @cached_property
    def inventory_optimization(self) -> DataFrame:
        return self._table("inventory_optimization", lambda: analytics.inventory_optimization(
            self.stg_inventory, self.fact_sales, self.dim_books, self.as_of))

    # -- features ----------------------------------------------------------
    @cached_property
    def daily_demand(self) -> DataFrame:
        return features.daily_demand(self.fact_sales)

    @cached_property
    def demand_forecasting_features(self) -> DataFrame:
        return self._table("demand_forecasting_features",
                           lambda: features.demand_forecasting_features(self.daily_demand, self.dim_books))

    @cached_property
    def book_features(self) -> DataFrame:
        return self._table("book_features", lambda: features.book_features(
            self.dim_books, self.dim_publishers, self.fact_sales, self.as_of, run_ts=self.run_ts))

    # -- experiments (views) -------------------------------------------------
    @cached_property
    def ab_test_base(self) -> DataFrame:
        return experiments.ab_test_base(self.raw("campaign_events"))

    @cached_property
    def ab_test_summary(self) -> DataFrame:
        return experiments.ab_test_summary(self.ab_test_base)

    @cached_property
    def ab_test_lift_analysis(self) -> DataFrame:
        return experiments.ab_test_lift_analysis(self.ab_test_summary)
