"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the number of cores. Each query runs in full
into a sink that keeps nothing; one small job starts the engine before the clock does.
"""

from __future__ import annotations

import json
import os
import time

from paylens.session import local_session
from paylens.workloads.catalog import queries

HEADLINE = [
    "extract_survey_cards",
    "extract_page_fields",
    "dedup_keep_first",
    "duplicate_audit",
    "enrich_location",
    "interpolate_gaps",
    "inflation_adjust",
    "compare_growth",
    "median_by_group",
    "profile_by_attribute",
    "pivot_matrices",
    "topn_median_trend",
    "boxplot_stats",
    "histogram_equal_width",
    "density_curve",
    "facet_counts",
    "facet_histogram",
    "suggest_values",
    "rank_grid",
    "hexbin_stats",
    "survey_refresh",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/orders.parquet").selectExpr("sum(o_totalprice)").collect()
    catalogue, took = queries(), {}
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    for name in HEADLINE:
        start = time.perf_counter()
        catalogue[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    total = round(sum(took.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": took,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
