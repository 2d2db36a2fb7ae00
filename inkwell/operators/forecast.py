"""Demand forecaster: training frame, features, split, random forest,
batch scoring and per-book forecasts.

Fixes against the source, stated here on purpose: the training frame is
read from daily demand per book (the source reads a table that lacks
those columns and trains on nothing); price bins use the training
range (the source recomputes them on one book, which always gives 2);
the split is a stable arithmetic hash instead of a random shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators.metrics import regression_metrics
from inkwell.operators.similarity import _with_one_row

FEATURES = ["price", "page_count", "day_of_week", "month", "quarter", "is_weekend",
            "quantity_lag_1", "quantity_lag_7", "quantity_rolling_7", "price_category"]
TARGET = "daily_quantity"
MAX_DAYS = 30
DEFAULT_DEMAND = 5.0
NUM_TREES = 100
# Rows times trees that are fitted at a time at most: a row keeps some 16 bytes for each tree and 130 besides,
# on disk when memory is short. Parts of a forest draw from seeds this far apart.
FIT_CELLS, SEED_STEP = 2 ** 28, 2 ** 20


def price_range(frame: DataFrame) -> DataFrame:
    """One row: min and max price of a frame (the bin edges' basis)."""
    return frame.agg(F.min("price").alias("_pmin"), F.max("price").alias("_pmax"))


def price_bins(frame: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Five equal-width price bins, codes 0..4 (right-closed, the lowest
    edge included); all prices equal -> 2; NULL -> -1."""
    prices = price_range(frame) if prices is None else prices
    x, lo, hi = F.col("price"), F.col("_pmin"), F.col("_pmax")
    width = (hi - lo) / F.lit(5.0)
    code = F.least(F.lit(4), F.greatest(F.lit(0), (F.ceil((x - lo) / width) - 1).cast("int")))
    out = _with_one_row(frame, prices).withColumn(
        "price_category",
        F.when(x.isNull(), F.lit(-1)).when(hi == lo, F.lit(2)).otherwise(code).cast("int"))
    return out.drop("_pmin", "_pmax")


def demand_training_frame(daily: DataFrame, stg_books: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Daily demand per book with calendar, lag, rolling and price-bin
    features. pandas-style weekday (Monday = 0); rolling mean is NULL until
    seven rows exist. Windows are per book and bounded by its sale days."""
    b = stg_books.select("book_id", "price", "page_count")
    j = daily.select("book_id", "sale_date", TARGET).join(b, "book_id")
    w = Window.partitionBy("book_id").orderBy("sale_date")
    w7 = w.rowsBetween(-6, 0)
    q, d = F.col(TARGET), F.col("sale_date")
    dow = F.weekday(d)
    frame = j.select(
        "book_id", "sale_date", TARGET, "price", "page_count",
        dow.alias("day_of_week"), F.month(d).alias("month"), F.quarter(d).alias("quarter"),
        F.when(dow >= 5, 1).otherwise(0).alias("is_weekend"),
        F.lag(q, 1).over(w).alias("quantity_lag_1"),
        F.lag(q, 7).over(w).alias("quantity_lag_7"),
        F.when(F.count(q).over(w7) == 7, F.avg(q).over(w7)).alias("quantity_rolling_7"))
    return price_bins(frame, prices)


def complete_rows(frame: DataFrame) -> DataFrame:
    """Rows with every feature and the target present."""
    return frame.dropna(subset=FEATURES + [TARGET])


def split_flag(frame: DataFrame, test_share_mod: int = 5) -> DataFrame:
    """Stable 80/20 split: a row is test when
    (book_id * 31 + days since 1970-01-01) mod 5 == 0."""
    days = F.datediff(F.col("sale_date"), F.lit("1970-01-01").cast("date"))
    return frame.withColumn("is_test", F.pmod(F.col("book_id") * 31 + days, F.lit(test_share_mod)) == 0)


def recent_rows(frame: DataFrame, n: int = 30) -> DataFrame:
    """Each book's n most recent rows (WindowGroupLimit per book)."""
    w = Window.partitionBy("book_id").orderBy(F.col("sale_date").desc())
    return frame.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def fit_forest(train: DataFrame, num_trees: int = NUM_TREES, max_depth: int = 10, seed: int = 42,
               cells: int = FIT_CELLS) -> PipelineModel:
    """The node that each row has reached in each tree is kept between the levels,
    beside the rows, instead of being found again from the root: the same forest,
    but a level costs a row one step in a tree, not one for every level above it.
    Levels are few, so their lineage is not cut by checkpoints.

    What is kept grows with rows times trees. Beyond ``cells`` the trees are fitted
    in parts, one after the other, each with a seed of its own; the trees of a
    forest are independent, so their union is the forest."""
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestRegressor(featuresCol="features", labelCol=TARGET, numTrees=num_trees,
                                   maxDepth=max_depth, seed=seed, cacheNodeIds=True, checkpointInterval=-1)
    sizes = _parts(num_trees, train.count(), cells)
    if len(sizes) == 1:
        return Pipeline(stages=[assembler, forest]).fit(train)
    rows, models, jvm = assembler.transform(train).select("features", TARGET), [], train.sparkSession._jvm
    for i, trees in enumerate(sizes):
        # A third of the features is what "auto" takes for several trees; rows are drawn by seed + partition.
        own = {forest.numTrees: trees, forest.seed: seed + i * SEED_STEP, forest.featureSubsetStrategy: "onethird"}
        models.append(forest.fit(rows, own))
        jvm.System.gc()  # the cleaner deletes the part's shuffle files
    model = forest._copyValues(_union(models))
    model._transfer_params_to_java()
    return PipelineModel([assembler, model])


def _parts(num_trees: int, rows: int, cells: int) -> list[int]:
    """Trees of each part of a fit, two at least (a forest of one tree takes all features)."""
    most = max(2, cells // max(1, rows))
    parts = max(1, min(num_trees // 2, math.ceil(num_trees / most)))
    return [num_trees // parts + (i < num_trees % parts) for i in range(parts)]


def _union(models: list[RandomForestRegressionModel]) -> RandomForestRegressionModel:
    """The forest of all trees of ``models``."""
    context = SparkContext._active_spark_context
    kinds = context._jvm.org.apache.spark.ml.regression
    trees = [tree for model in models for tree in model._java_obj.trees()]
    array = context._gateway.new_array(kinds.DecisionTreeRegressionModel, len(trees))
    for i, tree in enumerate(trees):
        array[i] = tree
    first = models[0]
    return RandomForestRegressionModel(kinds.RandomForestRegressionModel(first.uid, array, first.numFeatures))


def score(model: PipelineModel, frame: DataFrame) -> DataFrame:
    """Predictions with missing features read as 0."""
    x = frame.na.fill(0, subset=FEATURES)
    return model.transform(x).select("book_id", "sale_date", F.col("prediction"))


def forest_metrics(model: PipelineModel, train: DataFrame, test: DataFrame) -> DataFrame:
    pred = model.transform(test)
    err = F.col("prediction") - F.col(TARGET)
    m = pred.agg(F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
                 F.count(F.lit(1)).alias("test_samples"))
    n_train = train.agg(F.count(F.lit(1)).alias("train_samples"))
    return _with_one_row(m, n_train).select("mae", "rmse", "train_samples", "test_samples")


def by_fold(frame: DataFrame, folds: DataFrame, path: str) -> DataFrame:
    """Complete rows with the ``fold`` of their day (``folds``: sale_date, fold),
    written by fold, so that a split's training reads the folds before it only.
    A feature of a row is made of its day and of earlier ones; days without a fold
    are left out."""
    rows = complete_rows(frame).join(folds.select("sale_date", "fold"), "sale_date")
    rows.hint("rebalance", "fold").write.mode("overwrite").partitionBy("fold").parquet(path)
    return frame.sparkSession.read.schema(rows.schema).parquet(path).select(*rows.columns)


def rolling_origin(rows: DataFrame, n_folds: int, fit: Callable[[DataFrame], PipelineModel] = fit_forest,
                   at_once: int = 4) -> DataFrame:
    """(split, sale_date, book_id, label, prediction) of an expanding window: the
    model of split s is fitted once, on folds 1..s, and predicts fold s + 1. At
    most ``at_once`` splits are fitted at a time, their jobs side by side on the
    executors; fewer if their rows and trees pass ``FIT_CELLS``. A split without
    training rows has no model and no predictions."""
    spark = rows.sparkSession
    at_once = min(at_once, FIT_CELLS // (NUM_TREES * max(1, rows.count())))

    def split(s: int) -> DataFrame | None:
        train = rows.where(F.col("fold") <= s)
        if train.isEmpty():
            return None
        scored = fit(train).transform(rows.where(F.col("fold") == s + 1))
        return scored.select(F.lit(s).alias("split"), "sale_date", "book_id", F.col(TARGET).alias("label"), "prediction")

    with ThreadPool(max(1, min(at_once, n_folds - 1))) as pool:
        made = [df for df in pool.map(inheritable_thread_target(spark)(split), range(1, n_folds)) if df is not None]
    empty = spark.createDataFrame([], "split int, sale_date date, book_id long, label long, prediction double")
    return reduce(DataFrame.unionByName, made) if made else empty


def rolling_origin_metrics(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """mae, rmse and r2 of every split, with the rows it was fitted and tested on."""
    per = regression_metrics(predictions, by=["split"]).select("split", "mae", "rmse", "r2")
    tested = predictions.groupBy("split").agg(F.count(F.lit(1)).alias("test_samples"))
    sizes = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))  # one row a fold
    split = F.col("split")
    trained = F.sum(F.when(F.col("fold") <= split, F.col("n"))).alias("train_samples")
    sizes = tested.join(F.broadcast(sizes), F.col("fold") <= split).groupBy("split", "test_samples").agg(trained)
    return per.join(sizes, "split").select("split", "mae", "rmse", "r2", "train_samples", "test_samples")


def feature_importance(model: PipelineModel) -> list[tuple[str, float]]:
    forest = model.stages[-1]
    imp = forest.featureImportances.toArray()
    return sorted(zip(FEATURES, (float(v) for v in imp)), key=lambda t: -t[1])


def check_days(days: int) -> int:
    if not 1 <= days <= MAX_DAYS:
        raise ValueError(f"days must be in 1..{MAX_DAYS}, got {days}")
    return days


def save_forest(model: PipelineModel, path: str) -> None:
    """Write a fitted model to a shared folder, replacing what is there."""
    model.write().overwrite().save(path)


def load_forest(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def demand_forecast(model: PipelineModel, frame: DataFrame, dim_books: DataFrame, daily: DataFrame,
                    days: int = 7) -> DataFrame:
    """Forecast for every book and day. Books with sales: from the latest
    feature row, the same value for every day (features are not rolled
    forward, as in the source), floored at 0; books without: the default."""
    return _warm_forecast(model, frame, days).unionByName(demand_forecast_default(dim_books, daily, days))


def _warm_forecast(model: PipelineModel, frame: DataFrame, days: int) -> DataFrame:
    check_days(days)
    last = recent_rows(frame, 1)
    pred = score(model, last).select("book_id", F.greatest(F.col("prediction"), F.lit(0.0)).alias("p"))
    return pred.select("book_id", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("day"),
                       F.col("p").alias("predicted_demand"), F.lit("ml_model").alias("method"))


def demand_forecast_default(dim_books: DataFrame, daily: DataFrame, days: int = 7) -> DataFrame:
    """Books with no sales history get the default demand of 5 per day."""
    check_days(days)
    cold = dim_books.select("book_id").join(daily.select("book_id"), "book_id", "left_anti")
    return cold.select("book_id", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("day"),
                       F.lit(DEFAULT_DEMAND).alias("predicted_demand"), F.lit("default").alias("method"))
