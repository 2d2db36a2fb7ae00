"""A/B-test models over campaign events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ab_test_base(campaign_events: DataFrame) -> DataFrame:
    return campaign_events.where(F.col("experiment_id").isNotNull()).select(
        "campaign_id", "experiment_id", "treatment_group", "impressions", "clicks", "spend",
        (F.col("clicks").cast("double") / F.nullif(F.col("impressions"), F.lit(0))).alias("ctr"),
        (F.col("spend").cast("double") / F.nullif(F.col("clicks"), F.lit(0))).alias("cpc"),
    )


def ab_test_summary(base: DataFrame) -> DataFrame:
    return base.groupBy("experiment_id", "treatment_group").agg(
        F.count(F.lit(1)).alias("num_campaigns"),
        F.avg("ctr").alias("avg_ctr"),
        F.stddev_samp("ctr").alias("std_ctr"),
        F.avg("cpc").alias("avg_cpc"),
        F.stddev_samp("cpc").alias("std_cpc"),
    )


def ab_test_lift_analysis(summary: DataFrame) -> DataFrame:
    """Control vs treatment per experiment. A pivot by conditional
    aggregation (one shuffle on experiment_id) replaces the self-join;
    experiments missing either arm are dropped, as an inner join would."""
    g = F.col("treatment_group")

    def arm(name: str, c: str):
        return F.max(F.when(g == name, F.col(c)))

    piv = summary.groupBy("experiment_id").agg(
        F.max(F.when(g == "control", F.lit(1))).alias("_has_c"),
        F.max(F.when(g == "treatment", F.lit(1))).alias("_has_t"),
        arm("control", "avg_ctr").alias("control_ctr"),
        arm("treatment", "avg_ctr").alias("treatment_ctr"),
        arm("control", "avg_cpc").alias("control_cpc"),
        arm("treatment", "avg_cpc").alias("treatment_cpc"),
    ).where(F.col("_has_c").isNotNull() & F.col("_has_t").isNotNull())
    cc, tc = F.col("control_ctr"), F.col("treatment_ctr")
    cp, tp = F.col("control_cpc"), F.col("treatment_cpc")
    return piv.select(
        "experiment_id", "control_ctr", "treatment_ctr",
        F.coalesce(tc - cc, F.lit(0.0)).alias("ctr_lift"),
        F.when(cc > 0, F.lit(100.0) * (tc - cc) / cc).otherwise(F.lit(0.0)).alias("ctr_lift_pct"),
        "control_cpc", "treatment_cpc",
        F.coalesce(cp - tp, F.lit(0.0)).alias("cpc_reduction"),
        F.when(cp > 0, F.lit(100.0) * (cp - tp) / cp).otherwise(F.lit(0.0)).alias("cpc_reduction_pct"),
    )
