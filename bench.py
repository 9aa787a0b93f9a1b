"""Headline queries at one scale; prints one JSON line with seconds per query.

Each query is run to the end: its whole result is written to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from obsframe.plans import catalog
from obsframe.session import get_session

HEADLINE = (
    "src_zip_csv", "src_multi_station", "dom_observation_summary", "agg_multigrain", "dom_clean_observations",
    "dom_baseline_stations", "dom_baselines", "dom_valuations", "dom_anomaly_smoothed", "dom_anomaly_yearly_region",
    "dom_rainfall_instance", "dom_monthly_observations", "dom_rain_baselines", "dom_rain_rating", "dom_rain_regions",
    "dom_region_series", "dom_lag_experiment", "dom_grid_interpolate", "agg_quantile", "agg_near_zero_var",
    "win_percent_rank", "st_loess", "st_lm_simple", "st_mars_trend", "st_density", "ml_split", "val_cv", "val_boot",
    "alg_knn", "pp_knn_impute", "exp_query",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(cpus, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    for name in ("dom_monthly_observations", "dom_grid_interpolate", "val_none"):  # start workers, compile
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
