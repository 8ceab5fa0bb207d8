"""Time the registered queries; prints one JSON line.

BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_REPEATS  timed runs per query after one warm-up (default 1); the median counts
BENCH_ONLY     comma-separated query names, or "all" (default: the headline queries)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

import granary.registry.sink_queries  # noqa: F401  (registers its queries)
import granary.registry.version_queries  # noqa: F401
from granary.registry.queries import QUERIES
from granary.session import get_session

HEADLINE = """
    record_type_counts feed_totals route_product measure_resolve_v1 measure_resolve_v2 provider_deals
    scan_orders_as_of date_types archive_plan export_parts export_totals part_paths file_tags run_detail_plan
    upsert_files delete_survivors delete_reconcile policy_cutoff lifecycle_candidates desired_tier
    lifecycle_summary file_full_view schema_diff template_typed template_rejects validation_by_rule
    binary_columns catalog_type_map strict_date path_date local_to_utc nested_json ordered_listagg json_shape
    json_rename xml_to_json text_search_summary regex_lines regex_rewrite line_filter inner_join_report
    write_parts archive_job archive_job_survivors stream_discovery_job lifecycle_actions ingest_job stream_ingest provider_deals_job staging_job
""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    only = os.environ.get("BENCH_ONLY")
    names = HEADLINE if not only else list(QUERIES) if only == "all" else only.split(",")
    spark = get_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(repeats + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total query time, median per query after one warm-up",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
