"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   table folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_RUNS     timed runs per query after one warm-up (default 3); the median counts
"""

import json
import os
import statistics
import time

from depsignal.checks import catalog
from depsignal.session import local_session

HEADLINE = [
    "src1_read_events",
    "jon1_filter_watchlist",
    "win1_dedup_latest",
    "snk2_merge_insert_only",
    "agg1_commit_activity",
    "agg4_contributor_diversity",
    "agg5_repo_span",
    "agg17_ingest_hour_stats",
    "sco7_health_scores",
    "sco11_scorecard",
    "win3_health_trend",
    "win4_top_items_per_repo",
    "top1_most_at_risk",
    "txt4_parse_pom",
    "txt6_parse_manifests",
    "txt9_resolve_packages",
    "jon6_classify_dependencies",
    "txt13_render_report",
    "txt10_parse_reports",
    "vec1_cosine_topk_all",
    "dq2_check_unique",
]


def timed(query, spark, sf_dir):
    start = time.perf_counter()
    # the noop sink runs the whole plan without moving rows to the driver
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    seconds = {}
    for name in HEADLINE:
        query = catalog.QUERIES[name]
        timed(query, spark, sf_dir)
        seconds[name] = round(
            statistics.median(timed(query, spark, sf_dir) for _ in range(runs)), 3
        )
    print(
        json.dumps(
            {
                "metric": "headline queries, warm, sum of medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
