"""Time the headline queries. Prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import time

from contract.compare import session
from contract.registry import registered

HEADLINE = [
    "row_counts",
    "profile_orders",
    "profile_lineitem",
    "profile_events",
    "profile_documents",
    "profile_pages",
    "profile_all_tables",
    "top_values_lineitem",
    "relations_inferred",
    "orphaned_keys",
    "quality_composite_key",
    "quality_duplicate_rows",
    "quality_outliers",
    "quality_formats",
    "quality_label_variants",
    "quality_all_findings",
    "enrichment_derivable_columns",
    "enrichment_dependencies",
    "redacted_documents",
    "entity_report",
    "fix_dry_runs",
    "fix_applied",
    "report_history",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    registry, times = registered(), {}
    registry["profile_region"][0](spark, sf_dir).collect()  # start the JVM's pools
    for name in HEADLINE:
        query = registry[name][0]
        started = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
