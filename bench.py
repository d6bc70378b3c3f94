"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

from panelwatch.plans.catalog import QUERIES
from panelwatch.session import build_session

# the gold table and the predictions are hand-over tables: timed as their own entries, then read by the others
HEADLINE = [
    "pct_change_mom_yoy", "gold_assemble", "predictions_stage", "early_warning", "dm_pairwise", "bootstrap_ci_error", "bootstrap_ci_class",
    "clean_text", "lexicon_score", "roc_auc", "backtest_results", "metrics_by_period", "describe_panel", "index_lasso",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    from panelwatch.plans.q_forecast import predictions
    from panelwatch.plans.stages import clear

    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        df = predictions(spark, sf) if name == "predictions_stage" else QUERIES[name](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    clear(spark)
    spark.stop()
    print(json.dumps({"metric": "total_wall", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
