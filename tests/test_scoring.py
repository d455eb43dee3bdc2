import pytest
from pyspark.sql import functions as F

from propspark.operators import filters as flt, scoring as sco

COLS = "property_type string, building_sqft double, lot_size_acres double, year_built int, occupancy double"


def score(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + COLS)
    return [r[0] for r in sco.flex_score(df).orderBy("i").select("flex_score").collect()]


@pytest.mark.parametrize("sqft,want", [(19999, 0), (20000, 3), (49999, 3), (50000, 2), (99999, 2), (100000, 1), (199999, 1), (200000, 0), (None, 0)])
def test_size_borders(spark, sqft, want):
    assert score(spark, (None, float(sqft) if sqft else None, None, None, None)) == [want]


@pytest.mark.parametrize("acres,want", [(0.49, 0), (0.5, 1), (0.99, 1), (1, 2), (5, 2), (5.01, 1.5), (10, 1.5), (10.01, 1), (20, 1), (20.01, 0)])
def test_lot_borders(spark, acres, want):
    assert score(spark, (None, None, float(acres), None, None)) == [want]


@pytest.mark.parametrize("year,want", [(1979, 0), (1980, 0.5), (1989, 0.5), (1990, 1)])
def test_year_borders(spark, year, want):
    assert score(spark, (None, None, None, year, None)) == [want]


@pytest.mark.parametrize("occ,want", [(0.85, 1), (1.0, 0), (85.0, 1), (100.0, 0), (None, 0)])
def test_occupancy(spark, occ, want):
    assert score(spark, (None, None, None, None, occ)) == [want]


@pytest.mark.parametrize("kind,want", [("Flex Warehouse", 3), ("WAREHOUSE", 2.5), ("Light Industrial", 2), ("Industrial Park", 1.5), ("Self Storage", 1), ("Office", 0), (None, 0)])
def test_type_tiers(spark, kind, want):
    assert score(spark, (kind, None, None, None, None)) == [want]


def test_perfect_row_is_ten(spark):
    assert score(spark, ("Flex Industrial", 30000.0, 3.0, 1995, 80.0)) == [10.0]


def test_missing_columns_score_zero(spark):
    assert sco.flex_score(spark.createDataFrame([(1,)], "x int")).first()["flex_score"] == 0.0


def test_text_numbers_are_read(spark):
    df = spark.createDataFrame([("30000", "bad")], "building_sqft string, lot_size_acres string")
    assert sco.flex_score(df).first()["flex_score"] == 3.0


def test_configured_ranges_first_hit_closed(spark):
    df = spark.createDataFrame([(1.0,), (5.0,), (10.0,), (20.0,)], "lot_size_acres double")
    got = [r["lot_size"] for r in sco.flex_score_cfg(df, sco.ScoreConfig()).select("score_breakdown.lot_size").collect()]
    assert got == [2.0, 2.0, 1.5, 1.0]


def test_size_factor_peaks_at_ideal(spark):
    df = spark.createDataFrame([(0.0,), (0.4,), (0.5,), (2.5,), (20.0,), (20.1,), (None,)], "a double")
    assert [r[0] for r in df.select(sco.size_score(F.col("a"))).collect()] == [0.0, 2.0, 5.0, 10.0, 5.0, 3.0, 0.0]


def test_building_and_activity_factors(spark):
    schema = ("building_data struct<total_sqft:double,ceiling_height:double,loading_docks:int,overhead_doors:int,office_area:double,warehouse_area:double>,"
              "permits array<struct<issue_date:string>>, business_licenses array<struct<status:string>>, sale_date string, improvement_value double")
    rows = [((25000.0, 18.0, 1, 0, 25.0, 75.0), [("2024-06-01",), ("2020-01-01",)], [("ACTIVE",), ("ACTIVE",)], "2023-06-01", 0.0),
            (None, None, None, None, 200000.0), (None, [], [("ACTIVE",)], "2010-01-01", 1.0)]
    df = spark.createDataFrame(rows, schema)
    got = df.select(sco.building_score(df).alias("b"), sco.activity_score(df, "2024-12-31").alias("a")).collect()
    assert [tuple(r) for r in got] == [(10.0, 10.0), (3.0, 5.0), (0.0, 6.0)]




def test_class_labels(spark):
    df = spark.createDataFrame([(8.0,), (7.99,), (5.0,), (2.0,), (1.9,)], "s double")
    assert [r[0] for r in df.select(sco.classify_score(F.col("s"))).collect()] == [
        "PRIME_FLEX", "GOOD_FLEX", "POTENTIAL_FLEX", "POSSIBLE_FLEX", "UNLIKELY_FLEX"]


def test_adjustment_is_clamped(spark):
    df = spark.createDataFrame([(9.0, 3.0), (1.0, -4.0), (6.0, None), (None, 1.0)], "b double, a double")
    assert [r["flex_score"] for r in sco.adjust(df, "b", "a").collect()] == [10.0, 0.0, 6.0, 1.0]


def test_unknown_size_is_kept(spark):
    df = spark.createDataFrame([("INDUSTRIAL", 0.0), ("INDUSTRIAL", 0.5), ("STORES", 5.0), ("LIGHT MFG", 3.0)], "property_use string, acres double")
    got = {(r["property_use"], r["acres"]) for r in sco.identify(df).collect()}
    assert got == {("INDUSTRIAL", 0.0), ("LIGHT MFG", 3.0)}


def test_funnel_and_missing_columns(spark):
    df = spark.createDataFrame([("Warehouse", 25000.0), ("Warehouse", 1.0), ("Office", 30000.0)], "property_type string, building_sqft double")
    assert [r["n_rows"] for r in flt.classify_funnel(df).orderBy("step_no").collect()] == [3, 2, 1]
    assert flt.filter_lot(df).count() == 3


def test_range_filter_on_text(spark):
    df = spark.createDataFrame([("$250,000",), ("400000",), ("invalid",), ("500000",), (None,)], "sold_price string")
    assert flt.bound_filter(df, "price", (200000, 400000)).count() == 2
    assert flt.compare(df, "sold_price", "!=", 400000).count() == 2
    with pytest.raises(ValueError):
        flt.compare(df, "sold_price", "~", 1)
