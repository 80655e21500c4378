"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the cores.
Every query builds its plan anew and writes its whole result to a no-op sink, twice; "queries"
holds the second run, "first_runs" the first, which also pays for code generation."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.compare import local_session  # noqa: E402
from checks.queries import QUERIES  # noqa: E402

HEADLINE = [
    "click_features", "activity_types", "score_features", "registration_features", "rank_encode", "master",
    "value_counts", "crosstab_pct", "hierarchy_counts", "daily_unique", "mean_clicks_by_result",
    "mean_score_by_result", "module_performance", "imd_report", "kpi_export", "engagement_bands",
    "withdrawal_timeline", "assessment_performance", "histogram_by_group", "histogram_shared",
    "trim_quantile", "box_stats", "sample_n", "split_fractions", "classification_report", "auc", "roc_points",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    first = {name: run(spark, name, sf_dir) for name in HEADLINE}
    second = {name: run(spark, name, sf_dir) for name in HEADLINE}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries, second run",
                "value": round(sum(second.values()), 3),
                "unit": "sec",
                "queries": second,
                "first_runs": first,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
