"""Registered forecaster and model-metric queries. Forest outputs are
checked by rows and invariants (tests); everything else has an oracle."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from inkwell.operators import extras as X
from inkwell.operators import forecast as FC
from inkwell.operators import metrics as MT
from inkwell.operators.incremental import read_table
from inkwell.plans.oracle import build, cte
from inkwell.plans.registry import register
from inkwell.session import scratch_dir

def training_frame(m):
    return FC.demand_training_frame(m.daily_demand, m.stg_books)


def trained(m):
    """(model, frame, train, test). The frame is checkpointed before fitting;
    the fitted model is saved to the shared folder and loaded from there. It is
    kept under the digest of the rows it was fitted on, so a later query of the
    application loads it and other rows get their own."""
    if not hasattr(m, "forest"):
        frame = FC.split_flag(training_frame(m)).checkpoint()
        whole = FC.complete_rows(frame)
        train, test = whole.where(~F.col("is_test")), whole.where(F.col("is_test"))
        digest = F.xxhash64(*train.columns).cast("decimal(20,0)")
        rows = tuple(train.agg(F.count(F.lit(1)), F.sum(digest)).first())
        name = hashlib.sha1(f"{m.spark.sparkContext.applicationId} {rows}".encode()).hexdigest()
        path = scratch_dir(m.spark, f"forest-{name}")
        if read_table(m.spark, f"{path}-done") is None:
            FC.save_forest(FC.fit_forest(train), path)
            m.spark.range(1).write.mode("overwrite").parquet(f"{path}-done")
        m.forest = (FC.load_forest(path), frame, train, test)
    return m.forest


cte("demand_frame_base", """
SELECT d.book_id, d.sale_date, d.daily_quantity, b.price, b.page_count,
  CAST(isodow(d.sale_date) - 1 AS INTEGER) AS day_of_week,
  CAST(EXTRACT(MONTH FROM d.sale_date) AS INTEGER) AS month,
  CAST(EXTRACT(QUARTER FROM d.sale_date) AS INTEGER) AS quarter,
  CASE WHEN isodow(d.sale_date) - 1 >= 5 THEN 1 ELSE 0 END AS is_weekend,
  LAG(d.daily_quantity, 1) OVER w AS quantity_lag_1,
  LAG(d.daily_quantity, 7) OVER w AS quantity_lag_7,
  CASE WHEN COUNT(d.daily_quantity) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) = 7
       THEN AVG(d.daily_quantity) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END AS quantity_rolling_7
FROM daily_demand d JOIN stg_books b ON d.book_id = b.book_id
WINDOW w AS (PARTITION BY d.book_id ORDER BY d.sale_date)""", "daily_demand", "stg_books")


def _bins_sql(src: str) -> str:
    return f"""
SELECT f.*, CAST(CASE WHEN f.price IS NULL THEN -1 WHEN r.mx = r.mn THEN 2
  ELSE LEAST(4, GREATEST(0, CAST(ceil((f.price - r.mn) / ((r.mx - r.mn) / CAST(5 AS DOUBLE))) AS BIGINT) - 1))
  END AS INTEGER) AS price_category
FROM {src} f CROSS JOIN (SELECT MIN(price) AS mn, MAX(price) AS mx FROM {src}) r"""


cte("demand_training_frame", _bins_sql("demand_frame_base"), "demand_frame_base")
register("demand_training_frame", build("SELECT * FROM demand_training_frame", "demand_training_frame"))(
    training_frame)

register("price_bins", build(_bins_sql("(SELECT book_id, price FROM stg_books)"), "stg_books"))(
    lambda m: FC.price_bins(m.stg_books.select("book_id", "price")))

register("demand_split", build("""
SELECT book_id, sale_date, daily_quantity,
  (book_id * 31 + (sale_date - DATE '1970-01-01')) % 5 = 0 AS is_test
FROM demand_training_frame
WHERE price IS NOT NULL AND page_count IS NOT NULL AND quantity_lag_1 IS NOT NULL
  AND quantity_lag_7 IS NOT NULL AND quantity_rolling_7 IS NOT NULL""", "demand_training_frame"))(
    lambda m: FC.split_flag(FC.complete_rows(training_frame(m))).select(
        "book_id", "sale_date", "daily_quantity", "is_test"))

register("recent_demand_rows", build("""
SELECT * EXCLUDE (r) FROM (
  SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY sale_date DESC) AS r FROM demand_training_frame
) t WHERE r <= 30""", "demand_training_frame"))(lambda m: FC.recent_rows(training_frame(m), 30))

register("demand_forecast_default", build("""
SELECT b.book_id, CAST(d.day AS INTEGER) AS day, CAST(5 AS DOUBLE) AS predicted_demand, 'default' AS method
FROM dim_books b CROSS JOIN range(1, 8) d(day)
WHERE b.book_id NOT IN (SELECT book_id FROM daily_demand)""", "dim_books", "daily_demand"))(
    lambda m: FC.demand_forecast_default(m.dim_books, m.daily_demand, 7))

# Forest (rows-only checks).
register("demand_rf_metrics", None)(lambda m: FC.forest_metrics(trained(m)[0], trained(m)[2], trained(m)[3]))
register("demand_rf_scores", None)(lambda m: FC.score(trained(m)[0], trained(m)[1]))
register("demand_forecast", None)(
    lambda m: FC.demand_forecast(trained(m)[0], trained(m)[1], m.dim_books, m.daily_demand, 7))
register("feature_importance", None)(
    lambda m: m.spark.createDataFrame(FC.feature_importance(trained(m)[0]), "feature string, importance double"))


def _rolling_origin(m, n_folds=5):
    path = scratch_dir(m.spark, f"folds-{uuid.uuid4().hex}")
    rows = FC.by_fold(training_frame(m), X.time_series_folds(m.daily_demand, n_folds), path)
    # The predictions are written: each forest scores its fold once.
    FC.rolling_origin(rows, n_folds).write.parquet(f"{path}-predictions")
    return FC.rolling_origin_metrics(rows, m.spark.read.parquet(f"{path}-predictions"))


register("demand_rolling_origin", None)(_rolling_origin)

# -- metrics over naive forecasts of the feature table -----------------------------
cte("naive_eval", """
SELECT book_id, sale_date, CAST(date_trunc('month', sale_date) AS DATE) AS ts, daily_quantity AS label,
  quantity_lag_1, quantity_lag_7
FROM demand_forecasting_features""", "demand_forecasting_features")


def _naive(m):
    f = m.demand_forecasting_features
    return f.select("book_id", "sale_date", F.trunc("sale_date", "MM").alias("ts"),
                    F.col("daily_quantity").alias("label"), "quantity_lag_1", "quantity_lag_7")


def _reg_sql(pred: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    return f"""
SELECT {g}mae, mse, sqrt(mse) AS rmse,
  CASE WHEN sst <> 0 THEN 1.0 - sse / sst WHEN sse = 0 THEN 1.0 ELSE 0.0 END AS r2, mape
FROM (
  SELECT {g}CAST(SUM(abs(label - {pred})) AS DOUBLE) / COUNT(*) AS mae,
    CAST(SUM((label - {pred}) * (label - {pred})) AS DOUBLE) / COUNT(*) AS mse,
    CAST(SUM((label - {pred}) * (label - {pred})) AS DOUBLE) AS sse,
    CAST(COUNT(*) * SUM(label * label) - SUM(label) * SUM(label) AS DOUBLE) / COUNT(*) AS sst,
    CAST(SUM(CAST(abs(label - {pred}) / CASE WHEN label <> 0 THEN label ELSE 1 END AS DECIMAL(24,12))) AS DOUBLE)
      / COUNT(*) * 100 AS mape
  FROM naive_eval WHERE {pred} IS NOT NULL {"GROUP BY " + by if by else ""}
) a"""


register("regression_metrics", build(_reg_sql("quantity_lag_1"), "naive_eval"))(
    lambda m: MT.regression_metrics(_naive(m).where(F.col("quantity_lag_1").isNotNull()),
                                    "label", "quantity_lag_1", exact=True))

register("classification_metrics", build("""
WITH lab AS (
  SELECT CASE WHEN label > quantity_lag_1 THEN 1 ELSE 0 END AS y,
         CASE WHEN quantity_lag_1 > quantity_lag_7 THEN 1 ELSE 0 END AS p
  FROM naive_eval WHERE quantity_lag_1 IS NOT NULL AND quantity_lag_7 IS NOT NULL),
conf AS (SELECT y, p, COUNT(*) AS c FROM lab GROUP BY y, p),
per AS (
  SELECT s.k, s.support, COALESCE(pr.predicted, 0) AS predicted, COALESCE(t.tp, 0) AS tp
  FROM (SELECT y AS k, SUM(c) AS support FROM conf GROUP BY y) s
  LEFT JOIN (SELECT p AS k, SUM(c) AS predicted FROM conf GROUP BY p) pr ON s.k = pr.k
  LEFT JOIN (SELECT y AS k, c AS tp FROM conf WHERE y = p) t ON s.k = t.k),
pr AS (
  SELECT support, tp, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS prec,
    tp / support AS rec FROM per),
f AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2.0 * prec * rec / (prec + rec) ELSE 0.0 END AS f1 FROM pr)
SELECT SUM(tp) / SUM(support) AS accuracy, SUM(prec * support) / SUM(support) AS precision,
  SUM(rec * support) / SUM(support) AS recall, SUM(f1 * support) / SUM(support) AS f1_score
FROM f""", "naive_eval"))(
    lambda m: MT.classification_metrics(
        _naive(m).where(F.col("quantity_lag_1").isNotNull() & F.col("quantity_lag_7").isNotNull()).select(
            F.when(F.col("label") > F.col("quantity_lag_1"), 1).otherwise(0).alias("label"),
            F.when(F.col("quantity_lag_1") > F.col("quantity_lag_7"), 1).otherwise(0).alias("prediction"))))

NAIVE_MODELS = [("naive_lag_1", "quantity_lag_1"), ("naive_lag_7", "quantity_lag_7")]
METRICS = ["mae", "mse", "rmse", "r2", "mape"]


def metric_log(m):
    """Monthly evaluation log of the naive forecasters."""
    parts = []
    for name, col in NAIVE_MODELS:
        mm = MT.regression_metrics(_naive(m).where(F.col(col).isNotNull()), "label", col, exact=True, by=["ts"])
        parts.append(MT.metric_rows(mm, name, "ts", METRICS))
    return parts[0].unionByName(parts[1])


cte("metric_log", "\nUNION ALL\n".join(
    f"SELECT '{name}' AS model_name, ts, metric, value FROM ("
    f"SELECT ts, unnest(['mae', 'mse', 'rmse', 'r2', 'mape']) AS metric, "
    f"unnest([mae, mse, rmse, r2, mape]) AS value FROM ({_reg_sql(col, 'ts')}) x) y"
    for name, col in NAIVE_MODELS), "naive_eval")
register("metric_log", build("SELECT * FROM metric_log", "metric_log"))(metric_log)
register("latest_metrics", build("""
SELECT model_name, ts, metric, value FROM (
  SELECT *, row_number() OVER (PARTITION BY model_name, metric ORDER BY ts DESC) AS r FROM metric_log
) t WHERE r = 1""", "metric_log"))(lambda m: MT.latest_metrics(metric_log(m)))
register("compare_models", build("""
SELECT model_name AS model, value AS metric_value, ts AS timestamp FROM (
  SELECT *, row_number() OVER (PARTITION BY model_name, metric ORDER BY ts DESC) AS r FROM metric_log
) t WHERE r = 1 AND metric = 'rmse' ORDER BY metric_value, model""", "metric_log"))(
    lambda m: MT.compare_models(metric_log(m), "rmse"))
register("metric_alerts", build("""
SELECT * FROM (
  SELECT model_name, ts, metric, value, prev_value,
    CASE WHEN metric = 'r2' AND value < 0.8 THEN 'r2_below_floor'
         WHEN metric = 'mae' AND prev_value > 0 AND value > prev_value * CAST(1.2 AS DOUBLE) THEN 'mae_increase'
    END AS alert
  FROM (SELECT *, LAG(value) OVER (PARTITION BY model_name, metric ORDER BY ts) AS prev_value
        FROM metric_log WHERE metric IN ('r2', 'mae')) a
) b WHERE alert IS NOT NULL""", "metric_log"))(lambda m: MT.metric_alerts(metric_log(m)))
