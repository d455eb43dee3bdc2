"""Cleaning, typing and imputation of whole tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from propspark.functions.ffill import forward_fill
from propspark.functions.quantiles import quantile_name, quantile_row, with_row
from propspark.functions.store import stored
from propspark.functions.text import (clean_numeric_zero, clean_text, guarded_double, looks_numeric, nan_to_null)
from propspark.operators.schema import clean_names, standardize_columns

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")

# Standard property types and the parts of names that lead to them; later entries win.
TYPE_PARTS = {
    "industrial": ["industrial", "ind", "manufacturing", "mfg"],
    "warehouse": ["warehouse", "wh", "storage", "distribution"],
    "flex": ["flex", "flex space", "flexible"],
    "office": ["office", "off", "commercial office"],
    "retail": ["retail", "store", "shop"],
    "mixed_use": ["mixed", "mixed use", "multi-use"],
}
SANE_RANGES = {"building_sqft": (100, 10000000), "lot_size_acres": (0.01, 1000), "year_built": (1800, 2030),
               "occupancy": (0, 100)}
SHEET_NUMERIC = ["building_sqft", "lot_size_acres", "year_built", "sold_price", "occupancy"]
SQFT_PER_ACRE = 43560


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC or t.startswith("decimal")]


def text_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t == "string"]


def ingest_nulls(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating point column."""
    fix = {c: nan_to_null(F.col(c)) for c, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(fix) if fix else df


def text_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct (column, value, n) rows of text columns; the value counts carry everything a column check needs."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    return df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count("*").alias("n"))


def hash128(*values: Column) -> list[Column]:
    """Two independent 64-bit hashes of the values; NULL is a value of its own."""
    flagged = [x for v in values for x in (v, v.isNull())]
    return [F.xxhash64(*flagged), F.xxhash64(F.lit(1), *flagged)]


def value_keys(df: DataFrame, cols: Sequence[str], **facts: Callable[[Column], Column]) -> DataFrame:
    """(column, known, n, facts…): one row per distinct value of every column, NULL included.

    Values are told apart by 128 bits and their facts are taken along, so the size of a shuffled row does not depend on
    the texts. Two of 10^15 values share their bits with a chance of about 10^-9.
    """
    value = F.col("value")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    first, second = hash128(value)
    rows = df.select(F.inline(pairs)).select("column", first.alias("h1"), second.alias("h2"), value.isNotNull().alias("known"),
                                             *[fact(value).alias(name) for name, fact in facts.items()])
    return rows.groupBy("column", "h1", "h2").agg(
        F.any_value("known").alias("known"), F.count("*").alias("n"), *[F.any_value(name).alias(name) for name in facts]).drop("h1", "h2")


def detect_numeric(df: DataFrame, cols: Sequence[str] | None = None, low: float = 0.8) -> DataFrame:
    """CLN-3: per text column the share of its distinct values that look like numbers, and the target type."""
    def number(value: Column) -> Column:
        t = F.trim(value)
        return ~F.lower(t).isin("nan", "null", "none", "") & looks_numeric(t)

    def fraction(value: Column) -> Column:
        stripped = guarded_double(F.regexp_replace(F.trim(value), "[$,%]", ""))
        return stripped != F.floor(stripped)

    checked = value_keys(df, cols or text_columns(df), number=number, fraction=fraction).where("known")
    out = checked.groupBy("column").agg(
        F.count("*").alias("total_count"), F.count_if("number").alias("numeric_count"),
        F.coalesce(F.bool_or("fraction"), F.lit(False)).alias("fraction"))
    confidence = F.col("numeric_count") / F.col("total_count")
    return out.select(
        "column", "total_count", "numeric_count", confidence.alias("confidence"),
        (confidence >= low).alias("conversion_feasible"),
        F.when(confidence >= low, F.when(F.col("fraction"), "float64").otherwise("int64")).alias("target_type"))


def assess(df: DataFrame, cols: Sequence[str], low: float = 0.8) -> DataFrame:
    """CLN-4: success share of a plain cast over all non-null values and the NULLs to expect."""
    value = lambda c: F.col(c).cast("string")
    parts = [F.struct(F.lit(c).alias("column"), F.count(value(c)).alias("known"), F.count(guarded_double(value(c))).alias("ok"), F.count("*").alias("rows"))
             for c in cols]
    out = df.agg(F.array(*parts).alias("a")).select(F.inline("a")).where("rows > 0")
    confidence = F.coalesce(F.try_divide(F.col("ok").cast("double"), F.col("known")), F.lit(0.0))
    lost = F.floor(F.try_divide((F.col("known") - F.col("ok")).cast("double"), F.col("known")) * F.col("rows"))
    return out.select("column", confidence.alias("confidence"), (confidence >= low).alias("feasible"),
                      F.coalesce(lost, F.lit(0)).cast("bigint").alias("estimated_null_count"))


def convert(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """CLN-5: the columns as numbers under the zero policy; numeric columns stay as they are."""
    todo = {c: clean_numeric_zero(F.col(c)) for c in cols if dict(df.dtypes).get(c) == "string"}
    return df.withColumns(todo) if todo else df


def conversion_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """CLN-5: one row per column; all columns in one aggregate."""
    cols = [c for c in cols if c in df.columns]
    parts = []
    for c in cols:
        new = clean_numeric_zero(F.col(c)) if dict(df.dtypes)[c] == "string" else F.col(c)
        parts.append(F.struct(
            F.lit(c).alias("column"), F.count("*").alias("n_rows"), F.count_if(F.col(c).isNull()).alias("initial_null_count"),
            F.count_if(new.isNull()).alias("final_null_count"),
            F.count_if(new.isNotNull() & F.col(c).isNotNull()).alias("values_converted"),
            F.count_if(new.isNull() & F.col(c).isNotNull()).alias("values_failed")))
    one = df.agg(F.array(*parts).alias("a"))
    rate = F.coalesce(F.try_divide(F.col("values_converted").cast("double"), F.col("n_rows")) * 100, F.lit(0.0))
    return one.select(F.inline("a")).withColumn("success_rate", rate)


def to_numeric(df: DataFrame, cols: Sequence[str] = tuple(SHEET_NUMERIC)) -> DataFrame:
    """CLN-6: guarded cast; anything else becomes NULL."""
    todo = {c: guarded_double(F.col(c)) if dict(df.dtypes)[c] == "string" else F.col(c).cast("double")
            for c in cols if c in df.columns}
    return df.withColumns(todo) if todo else df


FILLED = {"fill_zero": ["building_sqft", "lot_size_acres", "year_built", "occupancy"],
          "fill_median": ["building_sqft", "lot_size_acres", "year_built"]}


def handle_missing(df: DataFrame, how: str = "skip", cols: Sequence[str] | None = None) -> DataFrame:
    """CLN-7: ``skip``, ``fill_zero`` or ``fill_median``; the columns are coerced to numbers first."""
    if how == "skip":
        return df
    if how not in FILLED:
        raise ValueError(f"unknown strategy {how!r}")
    cols = [c for c in (cols or FILLED[how]) if c in df.columns]
    if not cols:
        return df
    typed = to_numeric(df, cols)
    if how == "fill_zero":
        return typed.na.fill(0, subset=cols)
    med = F.col("__row")
    return (with_row(typed, quantile_row(typed, cols, [0.5]))
            .withColumns({c: F.coalesce(F.col(c), med[quantile_name(c, 0.5)]) for c in cols}).drop("__row"))


def modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with the most frequent value per text column; ties go to the smaller value."""
    counts = text_values(df, cols).where(F.col("value").isNotNull())
    best = counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))
    return best.agg(*[F.max(F.when(F.col("column") == c, F.col("mode"))).alias(c) for c in cols])


def impute(df: DataFrame, position: str, by: Sequence[str] = (), tie: Sequence[str] = (), low: float = 0.2,
           cols: Sequence[str] | None = None, block_rows: int = 1_000_000) -> DataFrame:
    """CLN-8: numbers with few gaps get the median, others the last known value and then 0; text with few gaps gets the
    most frequent value, other text 'Unknown'.

    One aggregate row with the gap shares is read first: only columns that need it are sorted for the forward fill.
    """
    df = stored(df, codec="zstd")  # gaps, medians, most frequent values and the fill read it; whole rows, so packed tighter
    cols = [c for c in (cols or df.columns) if c not in (position, *by, *tie)]
    gaps = df.agg(F.count("*").alias("n"), *[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    share = {c: 1 - gaps[f"c{i}"] / gaps["n"] for i, c in enumerate(cols)} if gaps["n"] else {}
    numbers = [c for c in numeric_columns(df) if share.get(c, 0) > 0]
    words = [c for c in text_columns(df) if share.get(c, 0) > 0]
    fill: dict[str, Column] = {}
    by_median = [c for c in numbers if share[c] < low]
    if by_median:
        med = F.col("__medians")
        fill |= {c: F.coalesce(F.col(c).cast("double"), med[quantile_name(c, 0.5)]) for c in by_median}
    by_mode = [c for c in words if share[c] < low]
    if by_mode:
        best = F.col("__modes")
        fill |= {c: F.coalesce(F.col(c), best[c], F.lit("Unknown")) for c in by_mode}
    fill |= {c: F.coalesce(F.col(c), F.lit("Unknown")) for c in words if share[c] >= low}
    carried = [c for c in numbers if share[c] >= low]
    out = forward_fill(df, carried, position, by, tie, block_rows) if carried else df
    fill |= {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in carried}
    if by_median:
        out = with_row(out, quantile_row(df, by_median, [0.5]), "__medians")
    if by_mode:
        out = with_row(out, modes(df, by_mode), "__modes")
    return out.withColumns(fill).drop("__medians", "__modes") if fill else out


def winsorize(df: DataFrame, cols: Sequence[str] | None = None, k: float = 3.0) -> DataFrame:
    """CLN-9: hold numbers within mean ± k sample standard deviations."""
    cols = list(cols or numeric_columns(df))
    if not cols:
        return df
    stats = df.agg(*[e for c in cols for e in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))])

    def capped(c):
        m, s = F.col("__row")[f"m_{c}"], F.col("__row")[f"s_{c}"]
        v = F.col(c).cast("double")
        return F.when((s > 0) & (F.abs(v - m) > s * k), F.greatest(F.least(v, m + s * k), m - s * k)).otherwise(v)

    return with_row(df, stats).withColumns({c: capped(c) for c in cols}).drop("__row")


def clean_text_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """CLN-10: trim, title case for city, state and type names, text spellings of null to NULL."""
    todo = {c: clean_text(F.col(c), title=any(w in c.lower() for w in ("city", "state", "type")))
            for c in (cols or text_columns(df))}
    return df.withColumns(todo) if todo else df


def normalized_type(c: Column) -> Column:
    low = F.lower(F.trim(c))
    out = c
    for target, parts in TYPE_PARTS.items():
        hit = F.lit(False)
        for p in parts:
            hit = hit | low.contains(p)
        out = F.when(hit, target).otherwise(out)
    return out


def normalize_types(df: DataFrame, col: str = "property_type") -> DataFrame:
    """CLN-11: the last matching group decides, as parts are searched in the original text."""
    return df.withColumn(col, normalized_type(F.col(col))) if col in df.columns else df


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """CLN-12."""
    return df.na.drop("all")


def add_fields(df: DataFrame, year: int) -> DataFrame:
    """CLN-13: price per sqft, age and the two efficiencies, as far as their columns exist."""
    have, out = set(df.columns), {}
    if {"sold_price", "building_sqft"} <= have:
        ok = (F.col("building_sqft") > 0) & (F.col("sold_price") > 0)
        out["price_per_sqft"] = F.when(ok, F.try_divide(F.col("sold_price"), F.col("building_sqft")))
    if "year_built" in have:
        out["building_age"] = F.lit(year) - F.col("year_built")
    if {"building_sqft", "lot_size_acres"} <= have:
        lot = F.col("lot_size_acres") * SQFT_PER_ACRE
        out["building_efficiency"] = F.when(F.col("lot_size_acres") > 0, F.try_divide(F.col("building_sqft"), lot))
    if {"building_sqft", "lot_size_sqft"} <= have:
        out["lot_efficiency"] = F.try_divide(F.col("building_sqft"), F.col("lot_size_sqft"))
    return df.withColumns(out) if out else df


def range_check(df: DataFrame, ranges: dict = SANE_RANGES) -> DataFrame:
    """CLN-14: rows (column, n, out_of_range)."""
    parts = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"),
                      F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias("out_of_range"))
             for c, (lo, hi) in ranges.items() if c in df.columns]
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def preprocess(df: DataFrame) -> DataFrame:
    """CLN-15: drop empty rows, standard names, typed numbers, standard types."""
    return normalize_types(to_numeric(standardize_columns(drop_empty_rows(df))))


def clean_and_transform(df: DataFrame, year: int, position: str, by: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """CLN-16: names, gaps, outliers, text, full-row duplicates, calculated fields."""
    named = clean_names(df)
    keep = {position, *by, *tie}
    numbers = [c for c in numeric_columns(named) if c not in keep]
    words = [c for c in text_columns(named) if c not in keep]
    out = clean_text_columns(winsorize(impute(named, position, by, tie), numbers), words)
    return add_fields(out.dropDuplicates(), year)


