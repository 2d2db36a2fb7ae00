"""Model metrics as aggregates over (label, prediction) frames, the metric
log table, latest metrics per model and model comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.columns import exact_avg

RATIO = "decimal(24,12)"


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                       exact: bool = False, by: list[str] | None = None) -> DataFrame:
    """mae, mse, rmse, r2, mape (a zero label divides by 1, in percent),
    overall or per group ``by``. With integer labels and predictions,
    ``exact`` keeps every sum in integer / decimal arithmetic, so the
    result does not depend on the summation order."""
    by = list(by or [])
    y, p = F.col(label), F.col(prediction)
    e = y - p
    n = F.count(F.lit(1))
    ape = F.abs(e) / F.when(y != 0, y).otherwise(F.lit(1))
    sse = F.sum(e * e)
    if exact:
        mae = F.sum(F.abs(e)).cast("double") / n
        mse = sse.cast("double") / n
        # Products of sums pass 2^63 at a few million rows: 38 digits hold them.
        total = lambda x: F.sum(x.cast("decimal(19,0)"))
        sst = (n.cast("decimal(19,0)") * total(y * y) - total(y) * total(y)).cast("double") / n
        mape = exact_avg(ape.cast("double"), RATIO) * 100
    else:
        mae = F.avg(F.abs(e))
        mse = sse / n
        sst = F.sum(y * y) - F.sum(y) * F.sum(y) / n
        mape = F.avg(ape) * 100
    out = df.groupBy(*by).agg(mae.alias("mae"), mse.alias("mse"), sse.cast("double").alias("_sse"),
                              sst.alias("_sst"), mape.alias("mape"))
    r2 = (F.when(F.col("_sst") != 0, F.lit(1.0) - F.col("_sse") / F.col("_sst"))
          .when(F.col("_sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return out.select(*by, "mae", "mse", F.sqrt("mse").alias("rmse"), r2.alias("r2"), "mape")


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """accuracy and support-weighted precision / recall / f1 (a class with
    no predictions has precision 0), from the confusion counts."""
    conf = df.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("c"))
    support = conf.groupBy(F.col("y").alias("k")).agg(F.sum("c").alias("support"))
    predicted = conf.groupBy(F.col("p").alias("k")).agg(F.sum("c").alias("predicted"))
    tp = conf.where(F.col("y") == F.col("p")).select(F.col("y").alias("k"), F.col("c").alias("tp"))
    per = (support.join(predicted, "k", "left").join(tp, "k", "left")
           .select("k", "support", F.coalesce("predicted", F.lit(0)).alias("predicted"),
                   F.coalesce("tp", F.lit(0)).alias("tp")))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    rec = F.col("tp") / F.col("support")
    per = per.select("support", "tp", prec.alias("prec"), rec.alias("rec"))
    f1 = F.when(F.col("prec") + F.col("rec") > 0,
                F.lit(2.0) * F.col("prec") * F.col("rec") / (F.col("prec") + F.col("rec"))).otherwise(F.lit(0.0))
    per = per.select("*", f1.alias("f1"))
    tot = F.sum("support")
    return per.agg(
        (F.sum("tp") / tot).alias("accuracy"),
        (F.sum(F.col("prec") * F.col("support")) / tot).alias("precision"),
        (F.sum(F.col("rec") * F.col("support")) / tot).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1_score"))


def metric_rows(metrics: DataFrame, model_name: str, ts: str, names: list[str]) -> DataFrame:
    """Wide metric rows -> log rows (model_name, ts, metric, value); ``ts``
    names the column holding the evaluation time."""
    stack = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"))
                                for n in names])).alias("m")
    return metrics.select(F.lit(model_name).alias("model_name"), F.col(ts).alias("ts"), stack).select(
        "model_name", "ts", "m.metric", "m.value")


REGRESSION_METRICS = ["mae", "mse", "rmse", "r2", "mape"]
CLASSIFICATION_METRICS = ["accuracy", "precision", "recall", "f1_score"]


def evaluate(predictions: DataFrame, model_type: str, model_name: str, ts: str) -> DataFrame:
    """Log rows (model_name, ts, metric, value) of a model's predictions
    (label, prediction): regression metrics for forecasting and regression
    models, classification metrics for classifiers, none for other types."""
    if model_type in ("forecasting", "regression"):
        wide, names = regression_metrics(predictions), REGRESSION_METRICS
    elif model_type == "classification":
        wide, names = classification_metrics(predictions), CLASSIFICATION_METRICS
    else:
        return predictions.sparkSession.createDataFrame(
            [], "model_name string, ts timestamp_ntz, metric string, value double")
    return metric_rows(wide.withColumn("ts", F.lit(ts).cast("timestamp_ntz")), model_name, "ts", names)


def log_metrics(rows: DataFrame, path: str) -> DataFrame:
    """Append log rows to the metric log and return the whole log."""
    rows.write.mode("append").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def latest_metrics(log: DataFrame) -> DataFrame:
    """Newest value of every (model, metric); of values with one time the
    greatest, then the one with the greatest metadata."""
    ties = [F.col(c).desc_nulls_last() for c in ("value", "metadata") if c in log.columns]
    w = Window.partitionBy("model_name", "metric").orderBy(F.col("ts").desc_nulls_last(), *ties)
    return log.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def compare_models(log: DataFrame, metric: str = "rmse") -> DataFrame:
    """Latest value of one metric per model, best (lowest) first."""
    lm = latest_metrics(log).where(F.col("metric") == metric)
    return lm.select(F.col("model_name").alias("model"), F.col("value").alias("metric_value"),
                     F.col("ts").alias("timestamp")).orderBy("metric_value", "model")


def metric_alerts(log: DataFrame, r2_floor: float = 0.8, mae_growth: float = 0.2) -> DataFrame:
    """Retraining alerts: R2 below the floor, or MAE up more than 20 %
    against the model's previous evaluation."""
    w = Window.partitionBy("model_name", "metric").orderBy("ts")
    prev = F.lag("value").over(w)
    x = log.where(F.col("metric").isin("r2", "mae")).select("*", prev.alias("prev_value"))
    alert = (F.when((F.col("metric") == "r2") & (F.col("value") < r2_floor), F.lit("r2_below_floor"))
             .when((F.col("metric") == "mae") & (F.col("prev_value") > 0)
                   & (F.col("value") > F.col("prev_value") * (1 + mae_growth)), F.lit("mae_increase")))
    return x.select("model_name", "ts", "metric", "value", "prev_value", alert.alias("alert")).where(
        F.col("alert").isNotNull())
