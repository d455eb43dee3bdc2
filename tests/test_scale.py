"""Operators that must stay exact and balanced when one key or value dominates."""

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from propspark.functions.ffill import forward_fill
from propspark.functions.quantiles import exact_quantiles
from propspark.functions.skew import hot_buckets, lookup_join, with_group_count
from propspark.operators import dedupe, enrich, events

PROBS = [0.0, 0.1, 0.25, 0.5, 0.8, 1.0]


def check_quantiles(spark, *lists):
    rows = [(i, float(v) if v is not None else None) for i, values in enumerate(lists) for v in values]
    df = spark.createDataFrame(rows, "g int, x double")
    got = {(r["g"], r["prob"]): r["value"] for r in exact_quantiles(df, ["x"], PROBS, ["g"]).collect()}
    for i, values in enumerate(lists):
        known = [v for v in values if v is not None and v == v]
        for p, w in zip(PROBS, np.quantile(np.array(known, dtype=float), PROBS)):
            assert got[(i, p)] == pytest.approx(w, rel=1e-9, abs=1e-300)


def test_quantiles_match_numpy(spark):
    check_quantiles(
        spark, [5.0], [1, 2, 4], [0.0] * 50 + [1.0], [-3, -2.5, 0, 0, 7], [1e-300, 1e300, -1e300, 0], [None, 1.0, float("nan"), 3.0],
        [random.Random(1).lognormvariate(0, 4) for _ in range(3000)], [-random.Random(2).random() for _ in range(2000)] + [0.5] * 2000,
        [1 + i * 1e-12 for i in range(500)])


def test_ungrouped_quantiles(spark):
    rows = [(random.Random(i).gauss(5, 2),) for i in range(300)]
    got = {r["prob"]: r["value"] for r in exact_quantiles(spark.createDataFrame(rows, "x double"), ["x"], PROBS).collect()}
    assert got == pytest.approx(dict(zip(PROBS, np.quantile([r[0] for r in rows], PROBS))))


def test_infinite_values_do_not_break_quantiles(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (float("-inf"),)], "x double")
    assert [r["value"] for r in exact_quantiles(df, ["x"], [0.0, 0.5, 1.0]).orderBy("prob").collect()] == [float("-inf"), 1.0, float("inf")]


FLOATS = st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=1, max_size=40)


@settings(max_examples=2, deadline=None)
@given(st.lists(FLOATS, min_size=5, max_size=10))
def test_quantiles_property(lists):
    from propspark.session import build_session

    check_quantiles(build_session("tests", cores=4, shuffle_partitions=4, memory="6g"), *lists)


def test_grouped_quantiles(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.gauss(0, 10)) for _ in range(500)]
    got = {(r["g"], r["prob"]): r["value"] for r in exact_quantiles(spark.createDataFrame(rows, "g string, x double"), ["x"], [0.5], ["g"]).collect()}
    for g in "ab":
        assert got[(g, 0.5)] == pytest.approx(float(np.median([x for k, x in rows if k == g])))


def test_empty_column_has_no_quantiles(spark):
    assert exact_quantiles(spark.createDataFrame([(None,)], "x double"), ["x"], [0.5]).count() == 0


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_quantiles_neither_sort_rows_nor_read_them_without_need(spark, tmp_path):
    rows = [(float(i % 5), random.Random(i).random() * 1e-9 + 1.0, random.Random(-i).gauss(0, 3)) for i in range(4000)]
    spark.createDataFrame(rows, "few double, near double, many double").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    for cols, scans in ((["few"], 1), (["few", "near", "many"], 3)):
        found = exact_quantiles(df, cols, PROBS)
        plan = final_plan(found)
        assert "SortAggregate" not in plan and plan.count("Scan parquet") <= scans
        got = {(r["column"], r["prob"]): r["value"] for r in found.collect()}
        for c in cols:
            want = np.quantile(np.array([r[["few", "near", "many"].index(c)] for r in rows]), PROBS)
            assert [got[(c, p)] for p in PROBS] == pytest.approx(list(want), rel=1e-15)


def test_quantiles_of_values_too_near_for_slices(spark):
    low = 1.0
    values = [low + k * 2.0 ** -52 for k in range(6)] * 3 + [1.0005] * 2 + [7.0]
    got = {r["prob"]: r["value"] for r in exact_quantiles(spark.createDataFrame([(v,) for v in values], "x double"), ["x"], PROBS).collect()}
    assert [got[p] for p in PROBS] == pytest.approx(list(np.quantile(np.array(values), PROBS)), rel=1e-15)


def skewed(spark, n=3000):
    return spark.range(n).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 700).cast("string"))).alias("k"))


def test_hot_keys_are_found_and_bounded(spark):
    assert len(hot_buckets(skewed(spark), ["k"], min_rows=500).collect()) == 1
    # without a number of rows: a third of all rows is more than a task of 4 should have only if that is under twice the mean
    assert hot_buckets(skewed(spark), ["k"]).count() == 0
    many = spark.range(4000).select(F.concat(F.lit("k"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).cast("string")).alias("k"))
    assert [r[1] for r in hot_buckets(many, ["k"]).collect()] == [2]


def test_no_number_of_heavy_keys_is_too_many(spark):
    left = spark.range(6000).select("id", (F.col("id") % 3000).alias("k"))
    right = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    out = lookup_join(left, right, ["k"], "left", salt_by=["id"], min_rows=2)
    assert sorted(out.select("id", "v").collect()) == sorted(left.join(right, "k").select("id", "v").collect())


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_equals_plain_join(spark, how):
    left = skewed(spark)
    right = left.select("k").distinct().where("k <> 'k5'").withColumn("v", F.length("k"))
    salted = lookup_join(left, right, ["k"], how, salt_by=["id"], min_rows=500)
    assert sorted(salted.collect()) == sorted(left.join(right, "k", how).select(*salted.columns).collect())


def test_hot_key_is_spread(spark):
    left = skewed(spark)
    right = left.select("k").distinct().withColumn("v", F.lit(1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = lookup_join(left, right, ["k"], "left", salt_by=["id"], min_rows=50)
        parts = out.where("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) == 4 and max(r["count"] for r in parts) < 700
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_group_count_treats_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, "x"), (3, "", "x"), (4, "a", None)], "i int, a string, b string")
    got = {r["i"]: r["n"] for r in with_group_count(df, ["a", "b"], "n", salt_by=["i"]).collect()}
    assert got == {1: 2, 2: 2, 3: 1, 4: 1}


def test_forward_fill_over_blocks(spark):
    rng = random.Random(5)
    rows = [(rng.choice("fg"), i, rng.random() if rng.random() < 0.2 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "f string, pos int, x double")
    got = {(r["f"], r["pos"]): r["x"] for r in forward_fill(df, ["x"], "pos", ["f"], block_rows=17).collect()}
    pdf = pd.DataFrame(rows, columns=["f", "pos", "x"]).sort_values("pos")
    pdf["x"] = pdf.groupby("f")["x"].ffill()
    for f, pos, x in pdf.itertuples(index=False):
        assert got[(f, pos)] == (None if pd.isna(x) else x)


def test_lockouts_match_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([1, 1, 1, 2]), rng.randrange(0, 6 * 3600), rng.random() < 0.3) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id int, user_id int, s int, success boolean").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["event_id"]: r["failures"] for r in events.trailing_failures(df, 15, block_factor=2).collect()}
    fails = [r for r in rows if not r[3]]
    assert got == {i: sum(1 for _, v, t, _ in fails if v == u and s - 900 < t <= s) for i, u, s, _ in fails}
    assert events.lockouts(df, 15, 5).count() == sum(v >= 5 for v in got.values())


ROWS = [("456 Oak Avenue", "Tampa", "FL", 7.2, "a"), ("456  oak ave.", "TAMPA ", "fl", 7.8, "b"), ("1 Elm", "X", "FL", None, "c"), ("1 elm", "x", "FL", 1.0, "d"),
        ("", None, "", 3.0, "e"), (None, "", None, 4.0, "f"), ("", None, "", 3.0, "e")]


def listed(spark):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS)], "address string, city string, state string, flex_score double, rid string, row_pos int")


def test_dedupe_keeps_best_and_blank_rows(spark):
    best = sorted(r["rid"] for r in dedupe.dedupe_best(listed(spark)).collect())
    assert best == ["b", "d", "e", "e", "f"]
    assert sorted(r["rid"] for r in dedupe.dedupe_best(listed(spark), strict_reference=True).collect()) == ["b", "d", "f"]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 16, 17, 1000])
def test_every_copy_of_a_blank_row_stays(spark, n):
    rows = spark.range(n).select(F.lit("").alias("address"), F.lit(None).cast("string").alias("city"), F.lit("").alias("state"), F.lit(1.0).alias("flex_score"))
    assert dedupe.dedupe_best(rows).count() == n


def test_dedupe_first_and_idempotent(spark):
    first = dedupe.dedupe_first(listed(spark), ["row_pos"], strict_reference=True)
    assert sorted(r["rid"] for r in first.collect()) == ["a", "c", "e"]
    once = dedupe.dedupe_best(listed(spark))
    assert sorted(once.collect(), key=repr) == sorted(dedupe.dedupe_best(once).collect(), key=repr)


def test_mark_dups_and_summary(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "i int, k string")
    got = {r["i"]: r["is_duplicate"] for r in dedupe.mark_dups(df, ["k"], salt_by=["i"], min_rows=2).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True}
    s = dedupe.dup_summary(listed(spark)).first()
    assert (s["potential_duplicates"], s["duplicate_groups_count"], s["largest_duplicate_group"]) == (2, 2, 2)


def test_large_parcels_are_split_into_parts(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, 1).otherwise(F.col("id")).alias("parcel_id"), F.col("id").alias("building_id"))
    out = enrich.group_footprints(df, fields=["building_id"], id_by=["building_id"], max_list=100, min_rows=500)
    rows = out.collect()
    assert sum(len(r["buildings"]) for r in rows) == 1000
    assert max(len(r["buildings"]) for r in rows) < 200 and sum(r["parcel_id"] == 1 for r in rows) == 9


def test_merge_and_upsert(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "k int, s string, v double")
    b = spark.createDataFrame([(1, None, 9.0)], "k int, s string, v double")
    assert sorted(tuple(r) for r in enrich.merge(a, b, ["k"]).collect()) == [(1, "x", 9.0), (2, "y", 2.0)]
    wins = {r["k"]: (r["s"], r["v"]) for r in enrich.merge(a, b, ["k"], null_wins=True).collect()}
    assert wins == {1: (None, 9.0), 2: ("y", 2.0)}
    up = enrich.upsert(a, spark.createDataFrame([(2, 5.0), (3, 6.0)], "k int, v double"), "k")
    assert {r["k"]: (r["s"], r["v"]) for r in up.collect()} == {1: ("x", 1.0), 2: ("y", 5.0), 3: (None, 6.0)}
