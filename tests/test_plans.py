"""Shape of the plans: no row-wise Python on hot paths, no cross joins, no whole-table window, pushdown reaches the scan."""

import contextlib
import io
import re

import pytest

from propspark.plans import catalogue
from propspark.plans.props import props
from propspark.operators.filters import filter_building

HOT = ["flt4_classify", "flt9_bundle", "sco1_flex_score", "sco4_weighted_score", "sco16_classify_file", "cln2_clean_numeric_zero", "win2_dedupe_best",
       "win6_mark_dups", "joi1_enrich_first_match", "joi3_cama_join", "agg3_by_municipality", "agg15_profile", "agg19_coverage", "dq1_profile",
       "dq9_quality4", "evt6_lockouts", "pipeline_multi_file", "set3_aggregate_stats", "agg24_histogram_30", "ml4_similar", "cln8_impute"]


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("name", HOT)
def test_hot_path(spark, sf, name):
    text = plan(catalogue.QUERIES[name](spark, sf))
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas", text)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if re.search(r"[+:]- Window \[", line):
            below = "\n".join(lines[i + 1:i + 4])
            assert "SinglePartition" not in below


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(filter_building(props(spark, sf), 20000).select("building_sqft"))
    read = re.search(r"ReadSchema: struct<l_orderkey[^>]*>", text).group(0)
    assert "l_tax" not in read and "l_shipdate" not in read
    assert "o_totalprice" not in text


def test_plain_filter_is_pushed(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").withColumnRenamed("l_extendedprice", "building_sqft")
    assert "GreaterThanOrEqual(l_extendedprice,20000.0)" in plan(filter_building(li, 20000.0))


def test_one_row_per_key_is_combined_before_the_shuffle(spark, sf):
    text = plan(catalogue.QUERIES["win2_dedupe_best"](spark, sf))
    assert "partial_min_by" in text
