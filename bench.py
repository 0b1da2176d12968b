"""Time headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from netloom.plans.catalog import QUERIES  # noqa: E402
from netloom.session import build_session  # noqa: E402

HEADLINE = (
    "nbr_bounds_relu", "nbr_bounds_ties", "count_pair", "count_pair_ties", "skeleton_l0", "skeleton_l1", "cell_graph_full", "score_full",
    "log_norm", "top_var_genes", "p95_scale", "avg_rank", "ordinal_rank", "spearman", "tom", "pair_priors",
    "interval_join", "two_tier", "links_topk", "pssm_scan", "triplets_best", "knn",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cores}]", **{
        "spark.sql.shuffle.partitions": cores, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["count_pair"](spark, folder.replace("sf0.1", "sf0.001")).write.format("noop").mode("overwrite").save()  # warm the workers
    took = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(folder).name}))


if __name__ == "__main__":
    main()
