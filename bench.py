"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) and ``BENCH_CPUS`` (default 8)
choose data and cores; ``BENCH_QUERIES`` may name other queries, or ``all``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from planlines.plans import catalog
from planlines.session import build_session

HEADLINE = [
    "split_summary", "endpoint_pairs", "endpoint_clusters", "polylines", "gt_mask", "nms", "near_line", "positive_tiles",
    "tile_pixels", "stitch_tiles", "image_metrics", "dice", "mask_components", "skeleton", "soft_skeleton", "lovasz_hinge",
    "bce_dice", "missed_candidates", "component_decisions", "roc_auc", "symbol_features", "history_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    asked = os.environ.get("BENCH_QUERIES", "")
    fns = catalog.callables()
    names = list(fns) if asked == "all" else asked.split(",") if asked else HEADLINE
    spark = build_session("planlines-bench", cpus, spark__sql__shuffle__partitions=cpus if cpus.isdigit() else "8")
    fns["image_metrics"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm up
    times: dict[str, float] = {}
    for name in names:
        start = time.time()
        fns[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total query time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": sf_dir.rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
