"""Times the headline queries on one machine and prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from corvane import queries
from corvane.session import session

HEADLINE = [
    "lexical_scoped", "lexical_question", "lexical_wide", "vector_topk", "hamming_shortlist", "hybrid_balanced", "knn_edges", "representative_location",
    "scope_union", "longest_root", "gc_levels", "snapshot_diff", "merge_upsert", "chunks", "turn_classes", "appended_turns", "enqueue_fold", "claim_lifo",
    "debounce_settled", "stage_latency_percentiles", "top_tags", "tag_cooc", "messages_asof", "novelty", "asof_orders", "topk_per_customer", "pricing_summary",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = session(f"local[{cpus}]", "bench", shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries.QUERIES["lexical_scoped"](spark, folder).count()  # start-up is not measured
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
