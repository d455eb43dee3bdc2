"""Registered queries against their SQL on the smallest data set; all of them with PROPSPARK_ALL=1."""

import os

import pytest

from propspark.plans import catalogue
from tests.oracle_compare import compare, duck

SOME = ["flt4_classify_funnel", "flt9_bundle", "sco2_configured_score", "sco4_weighted_score", "sco11_flex_indicators", "sco10_identify", "cln2_clean_numeric_zero",
        "cln5_conversion_report", "cln9_winsorize", "win9_forward_fill", "win2_dedupe_best", "win5_dup_members", "win6_mark_dups", "col5_suggest_mapping",
        "col12_check_required", "joi1_enrich_first_match", "joi3_cama_join", "joi7_group_footprints", "snk5_upsert", "agg6_score_stats", "agg11_value_counts", "agg19_coverage",
        "agg24_histogram_30", "dq4_validate", "dq5_assess_quality", "dq9_quality4", "ml4_similar", "rec5_pipeline", "evt3_verify", "evt6_lockouts", "run3_error_counts",
        "run4_compare_history", "str1_incremental_ingest", "str2_event_windows", "snk2_export_versioned", "pipeline_multi_file", "srt3_page",
        "joi3_spelling_order", "snk5_update_existing", "rec6_quality", "set2_column_sets", "str2_lockouts", "src2_csv_layouts", "evt1_deep_pages",
        "evt3_log_checksum", "evt3_log_verify", "win10_sliced_failures", "dq14_issues", "dq19_processing_report", "cln3_detect_numeric", "cln4_assess"]
NAMES = list(catalogue.QUERIES) if os.environ.get("PROPSPARK_ALL") else SOME


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf, name):
    problem = compare(spark, con, catalogue.QUERIES[name], catalogue.SQL.get(name), sf)
    assert problem is None or problem in ("equal but empty", "no rows"), problem


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
