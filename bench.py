"""Wall-time bench of the headline jobs.

Runs each headline query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
on ``local[$BENCH_CPUS]`` and prints ONE JSON line:

    {"metric": "headline_total_sec", "value": N, "unit": "sec",
     "queries": {"admin_latest": sec, ...}, "sf": "0.1"}

Each timing covers building the plan and executing it to the end through the
``noop`` sink (every row produced, nothing collected to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["admin_latest", "counterfactual", "auc", "scorecard_score", "shap_linear", "sensitivity"]
EXTRA = ["kpi_all", "fuzzy_map", "pillar_scores", "completeness", "ordered_target_enc", "stream_score"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = HEADLINE + ([] if os.environ.get("BENCH_HEADLINE_ONLY") else EXTRA)

    from scorelake.plans import registry
    from scorelake.session import build_session

    spark = build_session(f"local[{cpus}]", int(cpus))
    registry.load_all()
    # warm-up (JIT, file listing cache): not timed
    registry.QUERIES["target_dist"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    timings: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        df = registry.QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
        spark.catalog.clearCache()

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total_sec",
        "value": round(sum(timings[n] for n in HEADLINE), 3),
        "unit": "sec",
        "queries": timings,
        "sf": m.group(1) if m else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
