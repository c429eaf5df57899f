"""Time the main jobs on one folder of tables; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the local cores. Every time is
a run to a discarding sink, after one untimed pass over the smallest job to
start the engine.
"""

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.spark_queries import QUERIES, joined, naive  # noqa: E402
from checks.spark_queries import feature_table, training  # noqa: E402
from demandcast.operators import evaluate  # noqa: E402
from demandcast.plans.features import with_features  # noqa: E402
from demandcast.session import build_session, materialize  # noqa: E402


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        sql__shuffle__partitions=cpus,
        ui__enabled="false",
        ui__showConsoleProgress="false",
        driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(QUERIES["scan_inventory"](spark, folder))

    jobs = {
        "scan_sales": lambda: run(QUERIES["scan_sales"](spark, folder)),
        "daily_sales": lambda: run(QUERIES["daily_sales"](spark, folder)),
        "outlier_filter": lambda: run(QUERIES["outlier_filter"](spark, folder)),
        "window_features": lambda: run(with_features(materialize(joined(spark, folder), "joined"))),
        "recent_history": lambda: run(QUERIES["recent_history"](spark, folder)),
        "impute_median": lambda: run(QUERIES["impute_median"](spark, folder)),
        "build_features": lambda: feature_table(spark, folder),
        "encoder_vocab": lambda: run(QUERIES["encoder_vocab"](spark, folder)),
        "feature_matrix": lambda: run(QUERIES["feature_matrix"](spark, folder)),
        "cv_folds": lambda: run(QUERIES["cv_folds"](spark, folder)),
        "model_metrics": lambda: run(
            evaluate.regression_metrics(
                naive(spark, folder), "target", {"lag": "pred_lag", "roll": "pred_roll"}
            )
        ),
        "explain_prompt": lambda: run(QUERIES["explain_prompt"](spark, folder)),
        "train_forecaster": lambda: training(spark, folder),
        "batch_score": lambda: run(QUERIES["batch_score"](spark, folder)),
    }
    times = {}
    for name, job in jobs.items():
        start = time.perf_counter()
        job()
        times[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    result = {
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(scale.group(1)) if scale else None,
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
