"""Headline queries, timed warm: one JSON line for the driver."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tilewright.plans import load_all  # noqa: E402
from tilewright.plans.registry import QUERIES  # noqa: E402
from tilewright.session import local_session  # noqa: E402
from tilewright.shipping import ship  # noqa: E402

KEYS = (
    "parse_patch_filename",
    "consolidate_keep_last",
    "dedup_keep_first",
    "align_sources",
    "round_robin_select",
    "stratified_split",
    "score_linear_heads",
    "ensemble_source_mean",
    "tta_scores",
    "metrics_multiclass",
    "weighted_auroc",
    "fit_ridge_wide",
    "annotate_tiles",
    "surrogate_keys",
    "score_and_evaluate",
)
RUNS = 3


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    load_all()
    budget = float(os.environ.get("BENCH_BUDGET_S", "900"))
    begun = time.time()
    times: dict[str, float] = {}
    for key in KEYS:
        took = []
        for i in range(RUNS + 1):
            t = time.time()
            QUERIES[key](spark, sf).write.format("noop").mode("overwrite").save()
            if i or RUNS == 0:  # the first run warms up
                took.append(time.time() - t)
            if time.time() - begun > budget and took:
                break
        times[key] = round(statistics.median(took), 3)
    ratio = times["tta_scores"] / max(times["ensemble_source_mean"], 1e-9)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")),
                "tta_to_clean_ratio": round(ratio, 2),
            }
        )
    )


if __name__ == "__main__":
    main()
