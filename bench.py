"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

HEADLINE = [
    "daily_bars_from_lines", "panel_interactions", "panel_forward_returns", "pattern_break_of_structure", "pattern_retest", "panel_ic",
    "forward_labels", "ic_by_date", "quantile_returns", "cohort_returns", "indicator_adx", "timing_detectors", "industry_heat",
    "hard_veto", "positive_findings", "fundamental_quality", "screen_universe",
]


def main() -> None:
    from tickloom.plans.catalogue import QUERIES
    from tickloom.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus), {
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["daily_bars_from_lines"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # JVM warm-up
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
