"""Benchmark: headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flt4_classify_funnel", "flt9_bundle", "sco1_flex_score", "sco2_configured_score", "sco4_weighted_score",
    "sco16_classify_file", "srt2_top_candidates", "cln2_clean_numeric_zero", "cln3_detect_numeric", "cln8_impute",
    "win2_dedupe_best", "win6_mark_dups", "set3_aggregate_stats", "pipeline_multi_file", "joi1_enrich_first_match",
    "joi3_cama_join", "agg2_overview", "agg3_by_municipality", "agg6_score_stats", "agg9_percentiles", "agg11_value_counts",
    "agg12_hhi", "agg15_profile", "agg19_coverage", "agg24_histogram_30", "dq1_profile", "dq4_validate",
    "dq5_assess_quality", "dq9_quality4", "dq11_outliers", "ml4_similar", "evt2_event_report", "evt6_lockouts",
    "run1_batch_stats", "agg21_exec_summary", "dq19_processing_report", "run6_full_report",
]


def main() -> None:
    from propspark.plans import catalogue
    from propspark.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cores=cores, shuffle_partitions=int(cores), memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or HEADLINE
    n_rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    catalogue.QUERIES["agg2_overview"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in chosen:
        started = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    total = round(sum(times.values()), 3)
    pipeline = times.get("pipeline_multi_file")
    print(json.dumps({
        "metric": "headline_total", "value": total, "unit": "sec", "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "rows": n_rows,
        "pipeline_properties_per_sec": round(n_rows / pipeline, 1) if pipeline else None,
    }))


if __name__ == "__main__":
    main()
