import pytest
from pyspark.sql import functions as F

from propspark.functions import text


def values(spark, rows, expr, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, c {kind}")
    return [r[0] for r in df.select(expr(F.col("c")).alias("v"), "i").orderBy("i").select("v").collect()]


@pytest.mark.parametrize("raw,want", [
    ("$1,234.50", 1234.5), ("85%", 85.0), ("N/A", None), ("", None), ("none", None), (" 7 ", 7.0), ("-5", -5.0), ("5f", None),
    ("inf", None), ("nan", None), (None, None), ("(100)", None), ("1.2.3", None), ("1e3", 1000.0), ("35,000", 35000.0)])
def test_null_policy(spark, raw, want):
    assert values(spark, [raw], text.clean_numeric) == [want]


@pytest.mark.parametrize("raw,want", [
    ("$1,234.50", 1234.5), ("85%", 85.0), ("N/A", 0.0), ("", 0.0), ("-", 0.0), (None, 0.0), ("(100)", -100.0), ("1.2.3", 12.3),
    ("€5", 5.0), ("red", None), ("-5", -5.0), ("NULL", 0.0)])
def test_zero_policy(spark, raw, want):
    assert values(spark, [raw], text.clean_numeric_zero) == [want]


def test_addresses(spark):
    rows = ["123 Main Street", "9 North Lake Avenue, #4", "77 Streeter Road", "5 WEST PARKWAY", "1 Elm"]
    assert values(spark, rows, text.normalize_address) == ["123 Main st", "9 n Lake ave 4", "77 Streeter rd", "5 w pkwy", "1 Elm"]


def test_parcel_spellings_share_a_key(spark):
    rows = ["00434230010030000", "00-43-42-30-01-003-0000", "434230010030000"]
    assert len(set(values(spark, rows, text.parcel_key))) == 1
    assert values(spark, rows[:1], text.dashed_parcel) == [rows[1]]


def test_sale_dates(spark):
    got = values(spark, ["1609459200000", "2021-01-01", "2021-01-01T00:00:00Z", "soon", None], lambda c: text.sale_timestamp(c).cast("string"))
    assert got == ["2021-01-01 00:00:00"] * 3 + [None, None]


def test_text_nulls_stay_null(spark):
    assert values(spark, [" a ", "nan", None, ""], text.clean_text) == ["a", None, None, None]
