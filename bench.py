"""Runs the headline queries and prints one JSON line with their seconds."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "bm25_topk", "fts_phrase", "fts_near", "vector_topk", "hybrid_search", "tree_rollup", "evolution_top_papers", "co_occurrence_edges",
    "bridge_nodes", "numeric_conflicts", "value_score", "ndcg_at_10", "keep_last_upsert", "query_analytics",
)


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from lodestrata.plans import registry
    from lodestrata.session import build_session

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = registry.queries(), {}
    for name in HEADLINE:  # the first run compiles; the second is what a warm session takes
        for _ in range(2):
            began = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
