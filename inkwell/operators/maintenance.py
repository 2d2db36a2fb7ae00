"""Daily models kept up to date from the keys that a load changes.

A daily model is a rollup of the sales by (series, day) and windows over each
series. A sale that comes, goes or is corrected changes one day of one series,
and with it the windows of that row and of the ``reach`` rows after it. Only
these are computed again: the changed days from the facts that stand after the
load, the stale rows from the days of the changed series.

Both tables are kept as loads: load 0 holds all rows, every later one the rows
that it changed, and a mark for each day that lost its last sale. The rows of a
table are, for every (series, day), those of the highest load. A load is a
folder named by its number, which the caller counts up: one that is repeated
after a failure replaces its own folder, so ends alike. Nothing already written
is changed, and readers may stay at an older load. ``compact`` starts a table
afresh when its loads outgrow its base.

Null series values and null days are values like any other, equal to null. A
load that changes nothing adds an empty folder; no facts give no rows. The
tables follow the sales: attributes joined to them (``DailyModel.attributes``)
are joined when the table is read, so that they never grow old.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.operators import analytics, features
from inkwell.operators.incremental import PARTITION_COLUMNS, read_table, touched_partitions

DAY = "sale_date"
LOAD, GONE = "_load", "_gone"


@dataclass(frozen=True)
class DailyModel:
    """A rollup by (``series``, day), windows over it, and how many rows after a
    changed one see it (the longest lag or frame)."""

    series: tuple[str, ...]
    rollup: Callable[[DataFrame], DataFrame]
    windows: Callable[[DataFrame], DataFrame]
    reach: int
    attributes: Callable[[DataFrame, DataFrame], DataFrame] | None = None

    @property
    def keys(self) -> tuple[str, ...]:
        return (*self.series, DAY)


SALES_PERFORMANCE = DailyModel(
    ("genre", "channel", "region"), analytics.sales_daily_rollup, analytics.sales_trends, reach=6)
DEMAND_FEATURES = DailyModel(
    ("book_id",), features.daily_demand, features.demand_windows, reach=30, attributes=features.with_book_attributes)


def _matching(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str) -> DataFrame:
    """Rows of ``left`` with (left_semi) or without (left_anti) a row of ``right``
    of equal keys, null equal to null."""
    other = right.select(*[F.col(k).alias(f"_key_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"_key_{k}"]) for k in keys])
    return left.join(other, same, how)


def changed_keys(model: DailyModel, *sales: DataFrame) -> DataFrame:
    """The (series, day) keys of the given fact rows: those a load brought and the
    former versions of those it replaced or removed."""
    rows = [s.select(*model.keys) for s in sales]
    return reduce(DataFrame.unionByName, rows).distinct()


# ---------------------------------------------------------------------------
# Tables as loads
# ---------------------------------------------------------------------------


def _write(rows: DataFrame, path: str, load: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/{LOAD}={load}")


def _loads(spark: SparkSession, path: str) -> DataFrame:
    table = read_table(spark, path)
    if table is None:
        raise ValueError(f"no table at {path}; start writes it")
    return table


def table(spark: SparkSession, path: str, model: DailyModel, upto: int | None = None) -> DataFrame:
    """Rows as load ``upto`` left them (None: the last). The later loads are
    aggregated to one row a key; the base only loses the keys they hold, by a join
    whose small side AQE broadcasts, so it is not shuffled."""
    loads = _loads(spark, path)
    columns = [c for c in loads.columns if c not in (LOAD, GONE)]
    if upto is not None:
        loads = loads.where(F.col(LOAD) <= upto)
    base = loads.where(F.col(LOAD) == 0)
    rest = [c for c in columns if c not in model.keys]
    later = loads.where(F.col(LOAD) > 0).groupBy(*model.keys).agg(
        F.max_by(F.struct(GONE, *rest), LOAD).alias("_row"))
    kept = _matching(base, later, model.keys, "left_anti").select(*columns)
    latest = later.where(~F.col(f"_row.{GONE}")).select(*model.keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
    return kept.unionByName(latest.select(*columns))


def compact(spark: SparkSession, path: str, into: str, model: DailyModel) -> None:
    """Write the rows of both tables in folder ``path`` as the base of new ones."""
    for part in ("daily", "rows"):
        _write(table(spark, f"{path}/{part}", model).withColumn(GONE, F.lit(False)), f"{into}/{part}", 0)


# ---------------------------------------------------------------------------
# Loads
# ---------------------------------------------------------------------------


def start(spark: SparkSession, path: str, model: DailyModel, fact_sales: DataFrame) -> None:
    """Write both tables from all facts, as load 0."""
    _write(model.rollup(fact_sales).withColumn(GONE, F.lit(False)), f"{path}/daily", 0)
    daily = table(spark, f"{path}/daily", model, 0)
    _write(model.windows(daily).withColumn(GONE, F.lit(False)), f"{path}/rows", 0)


def stale_rows(daily: DataFrame, changed: DataFrame, model: DailyModel) -> DataFrame:
    """Rows of the changed series that a changed key lets go stale (``_stale``) and
    those their windows need, the ``reach`` rows before each. A key without a row
    (its last sale went) counts at the place where it was."""
    mine = _matching(daily, changed.select(*model.series).distinct(), model.series, "left_semi")
    marks = changed.select(*model.keys, F.lit(True).alias("_changed"))
    other = marks.select(*[F.col(k).alias(f"_key_{k}") for k in model.keys], "_changed")
    same = reduce(lambda a, b: a & b, [mine[k].eqNullSafe(other[f"_key_{k}"]) for k in model.keys])
    rows = mine.join(other, same, "left").drop(*[f"_key_{k}" for k in model.keys])
    rows = rows.withColumns({"_changed": F.col("_changed").isNotNull(), "_exists": F.lit(True)})
    holes = _matching(marks, daily, model.keys, "left_anti").withColumn("_exists", F.lit(False))
    rows = rows.unionByName(holes, allowMissingColumns=True)
    order = Window.partitionBy(*model.series).orderBy(DAY)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_at", F.count(F.when(F.col("_exists"), True)).over(upto))
    last = F.max(F.when(F.col("_changed"), F.col("_at"))).over(upto)
    rows = rows.withColumn("_stale", F.coalesce(F.col("_at") - last <= model.reach, F.lit(False)))
    rows = rows.where("_exists").withColumn(
        "_needed", F.max("_stale").over(order.rowsBetween(0, model.reach)))
    return rows.where("_needed").drop("_changed", "_exists", "_at", "_needed")


def refresh(spark: SparkSession, path: str, model: DailyModel, fact_sales: DataFrame, changed: DataFrame,
            load: int) -> None:
    """Bring both tables in folder ``path`` from load ``load - 1`` to ``load``.
    ``fact_sales`` are the facts as they stand after the load, of which only the
    months of ``changed`` (see ``changed_keys``) are read."""
    if load < 1:
        raise ValueError(f"loads count from 1, got {load}")
    daily_path, rows_path, aside = f"{path}/daily", f"{path}/rows", f"{path}/changed/{LOAD}={load}"
    changed.select(*model.keys).distinct().write.mode("overwrite").parquet(aside)
    changed = spark.read.schema(changed.select(*model.keys).schema).parquet(aside)
    year, month = PARTITION_COLUMNS
    months = changed.select(F.year(DAY).alias(year), F.month(DAY).alias(month))
    facts = fact_sales
    if {year, month} <= set(fact_sales.columns):
        facts = touched_partitions(fact_sales, months, PARTITION_COLUMNS)
    days = model.rollup(_matching(facts, changed, model.keys, "left_semi")).withColumn(GONE, F.lit(False))
    gone = _matching(changed, days, model.keys, "left_anti").withColumn(GONE, F.lit(True))
    _write(days.unionByName(gone, allowMissingColumns=True), daily_path, load)

    scope = stale_rows(table(spark, daily_path, model, load), changed, model)
    stale = scope.where("_stale").select(*model.keys)
    rows = _matching(model.windows(scope.drop("_stale")), stale, model.keys, "left_semi")
    gone = spark.read.parquet(f"{daily_path}/{LOAD}={load}").where(GONE).select(*model.keys, GONE)
    _write(rows.withColumn(GONE, F.lit(False)).unionByName(gone, allowMissingColumns=True), rows_path, load)


def current(spark: SparkSession, path: str, model: DailyModel, dimension: DataFrame | None = None) -> DataFrame:
    """The model as the last load left it, with its attributes of ``dimension``."""
    rows = table(spark, f"{path}/rows", model)
    return model.attributes(rows, dimension) if model.attributes else rows
