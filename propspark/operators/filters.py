"""Row filters. A filter whose column is absent changes nothing; all filters of one call form one predicate."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from propspark.functions.text import clean_numeric, contains_any

# Keywords, uses, zones and default bounds.
INDUSTRIAL_KEYWORDS = ["industrial", "warehouse", "distribution", "flex", "manufacturing", "storage", "logistics",
                       "light industrial"]
CANDIDATE_ZONES = ["IL", "IG", "IP", "IND", "M-1", "MUPD"]
COUNTY_USES = ["HEAVY MFG", "VACANT INDUSTRIAL", "WAREH/DIST TERM", "OPEN STORAGE", "WORKING WATERFRONT",
               "STORES", "SHOPPING CENTER CMMITY", "SMALL DISCOUNT STORE < 25000 SF"]
DASHBOARD_DEFAULTS = {
    "industrial_keywords": ["industrial", "warehouse", "distribution", "flex"],
    "size_range": (20000, 100000),
    "lot_range": (0.5, 20.0),
    "use_price_filter": True,
    "price_range": (150000, 2000000),
    "use_year_filter": False,
    "year_range": (1980, 2024),
    "use_occupancy_filter": False,
    "occupancy_range": (0, 100),
    "selected_counties": [],
    "selected_states": [],
}
BOUND_COLUMNS = {"price": "sold_price", "size": "building_sqft", "year": "year_built", "lot": "lot_size_acres",
                 "occupancy": "occupancy"}
SAMPLE_COLUMNS = ["property_name", "property_type", "building_sqft", "city", "state"]


def typed(df: DataFrame, name: str) -> Column:
    """The column as a number: text goes through the null policy of numeric cleaning."""
    return clean_numeric(F.col(name)) if dict(df.dtypes)[name] == "string" else F.col(name).cast("double")


def in_range(value: Column, low: float | None = None, high: float | None = None) -> Column:
    parts = [value.isNotNull()]
    if low is not None:
        parts.append(value >= F.lit(low))
    if high is not None:
        parts.append(value <= F.lit(high))
    return reduce(lambda a, b: a & b, parts)


def filter_industrial(df: DataFrame, words: Sequence[str] = tuple(INDUSTRIAL_KEYWORDS),
                      col: str = "property_type") -> DataFrame:
    """FLT-1."""
    return df.where(contains_any(F.col(col), words)) if col in df.columns else df


def filter_building(df: DataFrame, low: float = 20000, col: str = "building_sqft") -> DataFrame:
    """FLT-2."""
    return df.where(typed(df, col) >= low) if col in df.columns else df


def filter_lot(df: DataFrame, low: float = 0.5, high: float = 20.0, col: str = "lot_size_acres") -> DataFrame:
    """FLT-3."""
    return df.where(typed(df, col).between(low, high)) if col in df.columns else df


def classify(df: DataFrame, min_sqft: float = 20000, lot: tuple[float, float] = (0.5, 20.0),
             words: Sequence[str] = tuple(INDUSTRIAL_KEYWORDS)) -> DataFrame:
    """FLT-4: the candidate rows (type, then size, then lot)."""
    return filter_lot(filter_building(filter_industrial(df, words), min_sqft), *lot)


def classify_funnel(df: DataFrame, min_sqft: float = 20000, lot: tuple[float, float] = (0.5, 20.0),
                    words: Sequence[str] = tuple(INDUSTRIAL_KEYWORDS)) -> DataFrame:
    """FLT-4: rows left after every step and their share of the input, in one pass."""
    steps = []
    if "property_type" in df.columns:
        steps.append(("industrial", contains_any(F.col("property_type"), words)))
    if "building_sqft" in df.columns:
        steps.append(("building", typed(df, "building_sqft") >= min_sqft))
    if "lot_size_acres" in df.columns:
        steps.append(("lot", typed(df, "lot_size_acres").between(*lot)))
    sofar, aggs = F.lit(True), [F.count(F.lit(1)).alias("original")]
    for name, cond in steps:
        sofar = sofar & F.coalesce(cond, F.lit(False))
        aggs.append(F.count_if(sofar).alias(name))
    counts = df.agg(*aggs)
    names = ["original"] + [n for n, _ in steps]
    rows = F.array(*[F.struct(F.lit(i).alias("step_no"), F.lit(n).alias("step"), F.col(n).alias("n_rows"))
                     for i, n in enumerate(names)])
    return counts.select("original", F.inline(rows)).select(
        "step_no", "step", "n_rows",
        (F.try_divide(F.col("n_rows").cast("double"), F.col("original")) * 100).alias("pct_of_original"))


def range_filter(df: DataFrame, col: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """FLT-5: closed range over cleaned numbers; NULL is excluded."""
    return df.where(in_range(typed(df, col), low, high)) if col in df.columns else df


def compare(df: DataFrame, col: str, op: str, value: float) -> DataFrame:
    """FLT-6: one of ``> >= < <= == !=`` on the cleaned number; NULL never passes, not even ``!=``."""
    if col not in df.columns:
        return df
    v = typed(df, col)
    tests = {">": v > value, ">=": v >= value, "<": v < value, "<=": v <= value, "==": v == value, "!=": v != value}
    if op not in tests:
        raise ValueError(f"unknown comparison {op!r}")
    return df.where(tests[op])


def value_filter(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """FLT-7."""
    return df.where(F.col(col).isin(list(values))) if col in df.columns else df


def bound_filter(df: DataFrame, kind: str, bounds: tuple[float, float]) -> DataFrame:
    """FLT-8: price, size, year, lot or occupancy range."""
    return range_filter(df, BOUND_COLUMNS[kind], *bounds)


def bundle_predicate(df: DataFrame, params: dict) -> Column:
    """FLT-9: the whole filter bundle as one condition."""
    parts = []
    for kind, flag in (("size", None), ("lot", None), ("price", "use_price_filter"), ("year", "use_year_filter"),
                       ("occupancy", "use_occupancy_filter")):
        bounds, col = params.get(f"{kind}_range"), BOUND_COLUMNS[kind]
        if bounds and (flag is None or params.get(flag)) and col in df.columns:
            parts.append(in_range(typed(df, col), *bounds))
    for key, col in (("selected_counties", "county"), ("selected_states", "state")):
        if params.get(key) and col in df.columns:
            parts.append(F.col(col).isin(list(params[key])))
    words = params.get("industrial_keywords")
    if words and "property_type" in df.columns:
        parts.append(F.coalesce(F.col("property_type").rlike("(?i)" + "|".join(words)), F.lit(False)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def apply_filters(df: DataFrame, params: dict | None = None) -> DataFrame:
    return df.where(bundle_predicate(df, DASHBOARD_DEFAULTS if params is None else params))


def map_predicate(df: DataFrame, spec: dict) -> Column:
    """FLT-10: ``{column: {min, max} | list | scalar}``; unknown columns are ignored."""
    parts = []
    for col, want in spec.items():
        if col not in df.columns:
            continue
        if isinstance(want, dict):
            parts.append(in_range(F.col(col), want.get("min"), want.get("max")))
        elif isinstance(want, (list, tuple)):
            parts.append(F.col(col).isin(list(want)))
        else:
            parts.append(F.col(col) == F.lit(want))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def filter_map(df: DataFrame, spec: dict) -> DataFrame:
    return df.where(map_predicate(df, spec))


def filter_map_summary(df: DataFrame, spec: dict) -> DataFrame:
    """One row: rows before and after, reduction in percent and the number of applied conditions."""
    applied = sum(
        sum(want.get(k) is not None for k in ("min", "max")) if isinstance(want, dict) else 1
        for col, want in spec.items() if col in df.columns)
    kept = df.agg(F.count(F.lit(1)).alias("original_count"),
                  F.count_if(map_predicate(df, spec)).alias("filtered_count"))
    gone = (F.col("original_count") - F.col("filtered_count")).cast("double")
    return kept.select("*", F.coalesce(F.try_divide(gone, F.col("original_count")) * 100, F.lit(0.0))
                       .alias("reduction_percentage"), F.lit(applied).cast("bigint").alias("filters_count"))


def find_candidates(df: DataFrame, low: float = 5.0, n: int = 1000, zones: Sequence[str] = tuple(CANDIDATE_ZONES),
                    tie: Sequence[str] = ("parcel_id", "rid")) -> DataFrame:
    """FLT-12: best candidates in the given zones."""
    keep = ["parcel_id", "address", "owner_name", "flex_score", "zoning", "lot_size_acres", "building_sqft", "indicators"]
    order = [c for c in tie if c in df.columns]
    return (df.where((F.col("flex_score") >= low) & F.col("zoning").isin(list(zones)))
            .orderBy(F.desc("flex_score"), *order).limit(n).select(*[c for c in keep if c in df.columns]))


def select_for_enrichment(df: DataFrame, low: float = 500000, n: int = 100,
                          tie: Sequence[str] = ("parcel_id", "rid")) -> DataFrame:
    """FLT-13: the most valuable rows."""
    order = [c for c in tie if c in df.columns]
    return df.where(F.col("market_value") > low).orderBy(F.desc("market_value"), *order).limit(n)


def demo_filter(df: DataFrame) -> DataFrame:
    """FLT-14."""
    cond = (contains_any(F.col("property_type"), ["industrial", "warehouse", "distribution", "flex"])
            & (typed(df, "building_sqft") >= 20000) & F.col("lot_size_acres").between(0.5, 20))
    if "sold_price" in df.columns:
        cond = cond & typed(df, "sold_price").between(150000, 50000000)
    return df.where(cond)


def filter_uses(df: DataFrame, uses: Sequence[str] = tuple(COUNTY_USES), col: str = "property_use") -> DataFrame:
    """FLT-15."""
    return df.where(F.col(col).isin(list(uses)))


def min_score(df: DataFrame, low: float = 4.0, col: str = "flex_score") -> DataFrame:
    """FLT-16."""
    return df.where(F.col(col) >= low)


def industrial_sample(df: DataFrame, n: int = 10, words: Sequence[str] = tuple(INDUSTRIAL_KEYWORDS),
                      tie: Sequence[str] = ("rid",)) -> DataFrame:
    """FLT-17: the first ``n`` industrial rows in the stable order ``tie``, display columns only."""
    shown = [c for c in SAMPLE_COLUMNS if c in df.columns]
    order = [c for c in tie if c in df.columns] or shown
    return filter_industrial(df, words).orderBy(*order).limit(n).select(*shown)


def industrial_types(df: DataFrame, words: Sequence[str] = tuple(INDUSTRIAL_KEYWORDS)) -> DataFrame:
    """FLT-17: the distinct industrial types."""
    return filter_industrial(df, words).select("property_type").distinct()


def keyword_pattern(words: Sequence[str]) -> str:
    """Case-insensitive alternation of literal words."""
    return "(?i)" + "|".join(re.escape(w) for w in words)
