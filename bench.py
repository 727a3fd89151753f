"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import importlib
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "clean_numeric", "interpolate_rows", "dedup_first", "dedup_lineitem", "describe_prices",
    "group_stats_by_part", "quantile_thresholds", "densify_daily", "zero_fill",
    "network_total", "mode_share", "yoy_mode", "line_ranking", "rolling_std30", "rolling_yoy",
    "corr_matrix_log", "lag_corr", "box_stats", "rolling_zscore", "anomaly_class",
    "anomaly_holiday_map", "event_impact_by_line", "forecast_total", "forecast_lines",
    "baseline_compare", "cv_by_horizon", "line_scorecard", "key_metrics", "graph_summary",
)
REPEATS = int(os.environ.get("BENCH_REPEATS", "2"))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tallyloom.session import local_session

    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    entry = importlib.import_module("__spark_entry__")
    registered = entry.queries()
    wanted = sys.argv[1:] or HEADLINE
    names = list(registered) if wanted == ["all"] else wanted

    def run(name: str) -> float:
        start = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("anomaly_class")                       # start the workers
    seconds = {n: round(min(run(n) for _ in range(REPEATS)), 3) for n in names}
    print(json.dumps({
        "metric": "total seconds of the headline queries, best of repeats",
        "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "median": round(statistics.median(seconds.values()), 3),
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
