"""Benchmark: the 14-model run plus headline queries.

Runs on local[$BENCH_CPUS] against $BENCH_SF_DIR (default sf0.1) and prints
one JSON line. Model tables are written once to a fresh folder under the
session's checkpoint dir and read back by their consumers (as a model run
materialises them); the other queries are run through the ``noop`` sink,
so every row is computed and nothing is collected to the driver.
"""

from __future__ import annotations

import json
import os
import re
import sys
import uuid
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from inkwell.plans.models import TABLE_MODELS, VIEW_MODELS, Models  # noqa: E402
from inkwell.plans.catalog import REGISTRY  # noqa: E402
from inkwell.session import local_session, scratch_dir  # noqa: E402

# Headline queries beyond the model run (present ones are timed).
HEADLINE = [
    "sales_daily_rollup", "popular_items", "popular_by_user_type", "user_item_interactions",
    "item_similarity_topk", "user_recommendations", "dq_report", "inventory_insights",
    "demand_training_frame", "seasonal_forecast", "fact_sales_incremental", "ad_copy",
    "book_context",
]
# Heavier queries, timed apart from the headline sum.
HEAVY = ["bm25_topk", "hybrid_retrieval", "embedding_topk", "als_recommendations", "hybrid_recommendations",
         "fact_sales_stream", "campaign_window_stream"]


def _noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="inkwell-bench")
    # Stored models go under the session's checkpoint folder (shared on a
    # cluster), one fresh folder per run.
    store = scratch_dir(spark, f"bench-{uuid.uuid4().hex[:12]}")

    # Untimed warm-up on generated rows: JVM / codegen start-up and the
    # Python workers of Arrow UDFs (long-lived on a cluster's executors).
    # It reads none of the data.
    spark.range(1000).selectExpr("sum(id)").collect()
    slots = spark.sparkContext.defaultParallelism
    (spark.range(0, slots, 1, slots).mapInPandas(lambda it: it, "id long")
     .write.format("noop").mode("overwrite").save())
    times: dict[str, float] = {}
    m = Models(spark, sf_dir, store=store)
    t_run = time.time()
    for name in TABLE_MODELS:
        t0 = time.time()
        getattr(m, name)
        times[name] = time.time() - t0
    for name in VIEW_MODELS[4:]:
        t0 = time.time()
        _noop(getattr(m, name))
        times[name] = time.time() - t0
    model_run = time.time() - t_run

    for key in HEADLINE:
        if key not in REGISTRY:
            continue
        t0 = time.time()
        _noop(REGISTRY[key].build(m))
        times[key] = time.time() - t0

    heavy: dict[str, float] = {}
    for key in HEAVY:
        t0 = time.time()
        _noop(REGISTRY[key].build(m))
        heavy[key] = time.time() - t0

    sf = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "model_run_plus_headline_wall",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "model_run_sec": round(model_run, 3),
        "queries": {k: round(v, 3) for k, v in times.items()},
        "heavy_sec": round(sum(heavy.values()), 3),
        "heavy": {k: round(v, 3) for k, v in heavy.items()},
        "sf": float(sf.group(1)) if sf else sf_dir,
        "cpus": cpus,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
