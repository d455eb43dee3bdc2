"""Row scores as rule expressions. Every operator adds columns and never moves rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from propspark.functions.pin import pinned
from propspark.functions.rules import Band, band_points, bonus, first_hit, keyword_points, label
from propspark.functions.text import compact_flags, guarded_double

# Points of the base score.
TYPE_POINTS = {
    "flex": 3.0,
    "warehouse": 2.5,
    "distribution": 2.5,
    "light industrial": 2.0,
    "industrial": 1.5,
    "manufacturing": 1.0,
    "storage": 1.0,
    "logistics": 1.0,
}
SIZE_BANDS = [Band(20000, 50000, 3), Band(50000, 100000, 2), Band(100000, 200000, 1)]
LOT_BANDS = [Band(1, 5, 2, high_closed=True), Band(5, 10, 1.5, low_closed=False, high_closed=True),
             Band(0.5, 1, 1), Band(10, 20, 1, low_closed=False, high_closed=True)]
YEAR_BANDS = [Band(1990, None, 1), Band(1980, None, 0.5)]
MAX_SCORE = 10.0

# Weights, zones and places of the six-factor score.
FACTOR_WEIGHTS = {"zoning": 3.0, "size": 2.0, "building": 2.5, "location": 1.5, "activity": 1.0, "value": 1.0}
ZONE_POINTS = [(["IL", "IP", "PIPD", "M-1"], 10), (["IG", "IND", "M-2"], 8),
               (["MUPD", "MXPD", "AGR/IND"], 6), (["CG", "CH", "CS"], 4)]
PRIME_PLACES = ["BOCA RATON", "DELRAY BEACH", "BOYNTON BEACH", "WEST PALM BEACH"]
GOOD_PLACES = ["LAKE WORTH", "RIVIERA BEACH", "JUPITER", "WELLINGTON"]
CLASS_STEPS = [(8, "PRIME_FLEX"), (6, "GOOD_FLEX"), (4, "POTENTIAL_FLEX"), (2, "POSSIBLE_FLEX")]
COMPONENTS = ["zoning_score", "size_score", "building_score", "location_score", "activity_score", "value_score"]


def _number(df: DataFrame, name: str, default: float | None = None) -> Column:
    """A numeric column, or a typed NULL/default when the table has no such column."""
    if name not in df.columns:
        return F.lit(default).cast("double")
    c = F.col(name)
    c = guarded_double(c) if dict(df.dtypes)[name] == "string" else c.cast("double")
    return c if default is None else F.coalesce(c, F.lit(float(default)))


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def occupancy_fraction(c: Column) -> Column:
    """Values above 1 are percentages; exactly 1 means fully occupied."""
    return F.when(c > 1, c / 100).otherwise(c)


# --- SCO-1, SCO-2, SCO-3 -------------------------------------------------------------------------------------------

def base_components(df: DataFrame) -> dict[str, Column]:
    return {
        "building_size": band_points(_number(df, "building_sqft"), SIZE_BANDS),
        "property_type": keyword_points(_text(df, "property_type"), TYPE_POINTS),
        "lot_size": band_points(_number(df, "lot_size_acres"), LOT_BANDS),
        "age_condition": band_points(_number(df, "year_built"), YEAR_BANDS),
        "occupancy": first_hit([(occupancy_fraction(_number(df, "occupancy")) < 1.0, 1.0)]),
    }


def flex_score(df: DataFrame, name: str = "flex_score") -> DataFrame:
    """SCO-1: size + type + lot + age + occupancy, at most 10."""
    return pinned(df, name, F.least(sum(base_components(df).values()), F.lit(MAX_SCORE)))


@dataclass(frozen=True)
class ScoreConfig:
    """Weights and rules of the configurable score. Ranges are (low, high, points), first hit wins."""

    weights: dict[str, float] = field(default_factory=lambda: dict.fromkeys(
        ["building_size", "property_type", "lot_size", "age_condition", "occupancy"], 1.0))
    size_ranges: tuple = ((20000, 50000, 3.0), (50000, 100000, 2.0), (100000, 200000, 1.0))
    type_points: dict[str, float] = field(default_factory=lambda: dict(TYPE_POINTS))
    lot_ranges: tuple = ((1.0, 5.0, 2.0), (5.0, 10.0, 1.5), (0.5, 1.0, 1.0), (10.0, 20.0, 1.0))
    year_steps: tuple = ((1990, 1.0), (1980, 0.5))
    occupancy_percent: float = 100.0
    occupancy_points: float = 1.0
    max_score: float = MAX_SCORE
    min_building_sqft: float = 20000
    min_lot_acres: float = 0.5
    max_lot_acres: float = 20.0


# The named presets.
PRESETS = {
    "default": ScoreConfig(),
    "conservative": ScoreConfig(
        weights={"building_size": 1.5, "property_type": 2.0, "lot_size": 1.0, "age_condition": 1.0, "occupancy": 1.0},
        min_building_sqft=30000, min_lot_acres=1.0, max_lot_acres=15.0),
    "aggressive": ScoreConfig(
        weights={"building_size": 0.8, "property_type": 1.0, "lot_size": 1.2, "age_condition": 1.0, "occupancy": 1.0},
        min_building_sqft=15000, min_lot_acres=0.3, max_lot_acres=25.0),
}


def config_components(df: DataFrame, cfg: ScoreConfig) -> dict[str, Column]:
    size = [Band(lo, hi, p) for lo, hi, p in cfg.size_ranges]
    lots = [Band(lo, hi, p, high_closed=True) for lo, hi, p in cfg.lot_ranges]
    years = [Band(at, None, p) for at, p in sorted(cfg.year_steps, reverse=True)]
    full = F.lit(cfg.occupancy_percent / 100)
    raw = {
        "building_size": band_points(_number(df, "building_sqft"), size),
        "property_type": keyword_points(_text(df, "property_type"), cfg.type_points),
        "lot_size": band_points(_number(df, "lot_size_acres"), lots),
        "age_condition": band_points(_number(df, "year_built"), years),
        "occupancy": first_hit([(occupancy_fraction(_number(df, "occupancy")) < full, cfg.occupancy_points)]),
    }
    return {k: v * F.lit(float(cfg.weights[k])) for k, v in raw.items()}


def flex_score_cfg(df: DataFrame, cfg: ScoreConfig, name: str = "flex_score",
                   breakdown: str = "score_breakdown") -> DataFrame:
    """SCO-2 and SCO-3: the configured score and a struct of its weighted parts."""
    parts = config_components(df, cfg)
    total = F.least(sum(parts.values()), F.lit(float(cfg.max_score)))
    return pinned(df.withColumn(breakdown, F.struct(*[v.alias(k) for k, v in parts.items()])), name, total)


# --- SCO-4 and its parts -------------------------------------------------------------------------------------------

def zoning_score(zoning: Column) -> Column:
    z = F.upper(zoning)
    return first_hit([(z.isin(codes), p) for codes, p in ZONE_POINTS])


def size_score(acres: Column, low: float = 0.5, ideal: float = 2.5, high: float = 20.0) -> Column:
    a = F.coalesce(acres, F.lit(0.0))
    return (
        F.when(a <= 0, 0.0).when(a < low, 2.0).when(a > high, 3.0)
        .when(a < ideal, 5 + (a - low) / (ideal - low) * 5)
        .otherwise(5 + (high - a) / (high - ideal) * 5)
    )


def building_score(df: DataFrame) -> Column:
    """Uses the ``building_data`` struct (total_sqft, ceiling_height, loading_docks, overhead_doors, office_area,
    warehouse_area) when the table has one; fields that are absent count as zero."""
    improvement = _number(df, "improvement_value", 0)
    without = F.when(improvement > 100000, 3.0).otherwise(0.0)
    if "building_data" not in df.columns:
        return without
    have = {f.name for f in df.schema["building_data"].dataType.fields}

    def part(name):
        return F.coalesce(F.col("building_data")[name].cast("double"), F.lit(0.0)) if name in have else F.lit(0.0)

    sqft, height = part("total_sqft"), part("ceiling_height")
    office, store = part("office_area"), part("warehouse_area")
    ratio = F.try_divide(office, office + store)
    fits = sqft.between(5000, 100000)
    score = F.lit(5.0) + bonus(
        (fits, 2), (fits & sqft.between(15000, 35000), 1), (height.between(14, 24), 2),
        (part("loading_docks") + part("overhead_doors") >= 1, 1),
        ((office > 0) & (store > 0) & ratio.between(0.15, 0.50), 2))
    return F.when(F.col("building_data").isNull(), without).otherwise(F.least(score, F.lit(10.0)))


def location_score(place: Column, near_highway: Column | None = None) -> Column:
    up = F.upper(F.coalesce(place, F.lit("")))

    def any_of(names):
        hit = F.lit(False)
        for n in names:
            hit = hit | up.contains(n)
        return hit

    score = F.lit(5.0) + first_hit([(any_of(PRIME_PLACES), 3), (any_of(GOOD_PLACES), 2)])
    if near_highway is not None:
        score = score + bonus((F.coalesce(near_highway, F.lit(False)), 2))
    return F.least(score, F.lit(10.0))


def days_before(today: str, when: Column) -> Column:
    """Whole days from a timestamp to ``today``, rounded down."""
    seconds = F.unix_timestamp(F.lit(today).cast("timestamp")) - F.unix_timestamp(when.cast("timestamp"))
    return F.floor(seconds / 86400)


def activity_score(df: DataFrame, today: str) -> Column:
    """Uses ``permits`` (issue_date) and ``business_licenses`` (status) arrays when the table has them."""
    score = F.lit(5.0)
    if "permits" in df.columns:
        recent = F.size(F.filter(F.coalesce("permits", F.array().cast(df.schema["permits"].dataType)),
                                 lambda p: days_before(today, p["issue_date"]) <= 365))
        score = score + F.least(recent, F.lit(3)).cast("double")
    if "business_licenses" in df.columns:
        active = F.size(F.filter(F.coalesce("business_licenses",
                                            F.array().cast(df.schema["business_licenses"].dataType)),
                                 lambda x: x["status"] == "ACTIVE"))
        score = score + first_hit([(active.between(2, 10), 3), (active == 1, 1)])
    if "sale_date" in df.columns:
        score = score + bonus((days_before(today, F.col("sale_date")) <= 730, 1))
    return F.least(score, F.lit(10.0))


def value_score(df: DataFrame) -> Column:
    improvement = _number(df, "improvement_value", 0)
    land = _number(df, "land_market_value", 1)
    ratio = F.when(land > 0, improvement / land)
    score = F.lit(5.0) + first_hit([(ratio > 1.5, 2), (ratio > 0.5, 1)]) + first_hit(
        [(improvement.between(500000, 5000000), 2), ((improvement >= 250000) & (improvement < 500000), 1)])
    if "building_data" in df.columns:
        sqft = F.coalesce(F.col("building_data")["total_sqft"].cast("double"), F.lit(0.0))
        per_foot = F.when((sqft > 0) & (improvement > 0), improvement / sqft)
        score = score + bonus((per_foot.between(50, 150), 1))
    return F.least(score, F.lit(10.0))


def weighted_components(df: DataFrame, today: str) -> dict[str, Column]:
    place = "municipality" if "municipality" in df.columns else "city"
    near = F.col("near_highway") if "near_highway" in df.columns else None
    return {
        "zoning_score": zoning_score(_text(df, "zoning")),
        "size_score": size_score(_number(df, "acres" if "acres" in df.columns else "lot_size_acres")),
        "building_score": building_score(df),
        "location_score": location_score(_text(df, place), near),
        "activity_score": activity_score(df, today),
        "value_score": value_score(df),
    }


def weighted_score(df: DataFrame, today: str, name: str = "flex_score") -> DataFrame:
    """SCO-4: six component columns, ``flags`` and the weighted score rounded to two places."""
    out = df.withColumns(weighted_components(df, today))
    weight = {f"{k}_score": w for k, w in FACTOR_WEIGHTS.items()}
    mean = sum(F.col(c) * F.lit(w) for c, w in weight.items()) / F.lit(sum(weight.values()))
    high = (F.col("zoning_score") >= 8) & (F.col("size_score") >= 7)
    good = F.col("building_score") >= 8
    total = F.least(mean + F.when(high, 0.5).otherwise(0.0) + F.when(good, 0.3).otherwise(0.0), F.lit(10.0))
    flagged = out.withColumn("flags", compact_flags((high, "HIGH_POTENTIAL"), (good, "IDEAL_BUILDING")))
    return pinned(flagged, name, F.bround(total, 2))


def classify_score(score: Column) -> Column:
    """SCO-5."""
    return label(score, CLASS_STEPS, "UNLIKELY_FLEX")


def score_report(df: DataFrame, score: str = "flex_score") -> DataFrame:
    """SCO-6: strengths, weaknesses and recommendations as text arrays."""
    c = classify_score(F.col(score))
    zoning, size, building = F.col("zoning_score"), F.col("size_score"), F.col("building_score")
    return df.withColumns({
        "classification": c,
        "strengths": compact_flags((zoning >= 8, "Excellent industrial zoning"),
                                   (size >= 8, "Ideal property size for flex"),
                                   (building >= 8, "Building well-suited for flex use")),
        "weaknesses": compact_flags((zoning < 5, "Zoning may not permit industrial use"),
                                    (size < 5, "Property size not optimal for flex"),
                                    (building < 5, "Building needs modifications for flex use")),
        "recommendations": compact_flags(
            (c.isin("PRIME_FLEX", "GOOD_FLEX"), "High priority for acquisition/development"),
            (c == "POTENTIAL_FLEX", "Investigate further with site visit"),
            (c == "POTENTIAL_FLEX", "Check zoning for conditional use permits")),
    })


# --- SCO-7 … SCO-10 ------------------------------------------------------------------------------------------------

# Property uses treated as industrial.
INDUSTRIAL_USES = ["WAREH/DIST TERM", "VACANT INDUSTRIAL", "HEAVY MFG", "LIGHT MFG", "OPEN STORAGE",
                   "WORKING WATERFRONT", "INDUSTRIAL"]


def derive_sqft(df: DataFrame, name: str = "derived_sqft") -> DataFrame:
    """SCO-8: building area from the building struct, else a quarter of the lot."""
    acres = _number(df, "acres" if "acres" in df.columns else "lot_size_acres", 0)
    from_lot = F.when(acres > 0, F.floor(acres * 43560 * 0.25)).otherwise(F.lit(0)).cast("bigint")
    if "building_data" not in df.columns:
        return df.withColumn(name, from_lot)
    have = {f.name for f in df.schema["building_data"].dataType.fields}

    def part(field_name):
        c = F.col("building_data")[field_name].cast("double") if field_name in have else F.lit(None).cast("double")
        return F.nullif(c, F.lit(0.0))

    area = part("area")
    own = F.coalesce(part("total_area"), part("total_sqft"), F.when(area < 100, area * 43560), F.lit(0.0))
    return df.withColumn(name, F.when(F.col("building_data").isNull(), from_lot).otherwise(own.cast("bigint")))


def simple_score(df: DataFrame, sqft: str = "derived_sqft", name: str = "flex_score") -> DataFrame:
    """SCO-7: use type, size, lot and value points, plus the indicator bonus when ``flex_indicators`` exists."""
    use = F.upper(_text(df, "property_use"))
    size = F.col(sqft)
    acres = _number(df, "acres" if "acres" in df.columns else "lot_size_acres", 0)
    value = _number(df, "market_value", 0)
    score = (
        first_hit([(use.contains("WAREH") | use.contains("DIST"), 4), (use.contains("VACANT INDUSTRIAL"), 3),
                   (use.contains("MFG"), 2), (use.contains("STORAGE"), 2), (use.contains("INDUSTRIAL"), 1)])
        + first_hit([(size.between(20000, 50000), 3), ((size > 50000) & (size <= 100000), 2),
                     ((size > 100000) & (size <= 200000), 1), (size > 200000, 0.5)])
        + first_hit([(acres.between(1, 5), 2), ((acres > 5) & (acres <= 10), 1.5),
                     ((acres >= 0.5) & (acres < 1), 1), ((acres > 10) & (acres <= 20), 0.5)])
        + first_hit([(value.between(500000, 5000000), 2), ((value > 5000000) & (value <= 10000000), 1),
                     ((value >= 250000) & (value < 500000), 1)])
    )
    if "flex_indicators" in df.columns:
        ind = F.col("flex_indicators")
        score = score + bonus((F.coalesce(ind["is_flex_compatible"], F.lit(False)), 1),
                              (F.coalesce(ind["property_type_score"], F.lit(0.0)) > 2, 0.5))
    return pinned(df, name, F.bround(score, 2))


def potential_label(score: Column) -> Column:
    return label(score, [(8, "EXCELLENT"), (6, "VERY GOOD"), (4, "GOOD"), (2, "MODERATE")], "LOW")


def suitability(df: DataFrame, sqft: str = "derived_sqft", score: str = "flex_score") -> DataFrame:
    """SCO-9: potential label and multi-tenant suitability."""
    use = F.upper(_text(df, "property_use"))
    by_type = use.contains("WAREH") | use.contains("DIST") | use.contains("STORAGE") | use.contains("VACANT")
    by_size = F.coalesce(F.col(sqft).between(20000, 100000), F.lit(False))
    by_lot = _number(df, "acres" if "acres" in df.columns else "lot_size_acres", 0).between(1, 10)
    level = (
        F.when(by_size & by_type & by_lot, "HIGHLY SUITABLE").when(by_size & by_type, "SUITABLE")
        .when(by_size | by_type, "POTENTIALLY SUITABLE").otherwise("LIMITED SUITABILITY")
    )
    return df.withColumns({"flex_potential": potential_label(F.col(score)), "multi_tenant_suitable": level})


def identify(df: DataFrame, min_sqft: float = 20000) -> DataFrame:
    """SCO-10: industrial uses of unknown or sufficient size with a positive simple score."""
    sized = derive_sqft(df.where(F.col("property_use").isin(INDUSTRIAL_USES)))
    kept = sized.where((F.col("derived_sqft") <= 0) | (F.col("derived_sqft") >= min_sqft))
    return suitability(simple_score(kept).where(F.col("flex_score") > 0))


# --- SCO-11 … SCO-16 -----------------------------------------------------------------------------------------------

def use_class(df: DataFrame, use: str = "property_use") -> DataFrame:
    """SCO-12: use flags and the derived type."""
    u = F.upper(_text(df, use))
    store_house = u.contains("WAREH") | u.contains("DIST")
    making = u.contains("MFG") | u.contains("MANUFACT")
    industrial = u.contains("INDUSTRIAL")
    kind = (
        F.when(store_house, "WAREHOUSE/DISTRIBUTION").when(making, "MANUFACTURING").when(industrial, "INDUSTRIAL")
        .when(u.contains("STORAGE"), "STORAGE").when(u.contains("STORE") | u.contains("SHOPPING"), "COMMERCIAL")
        .otherwise("UNKNOWN")
    )
    return df.withColumns({
        "use_type": kind, "is_warehouse": store_house, "is_manufacturing": making, "is_industrial": industrial,
        "is_flex_compatible": store_house | industrial | making,
    })


def flex_indicators(df: DataFrame, today: str, name: str = "flex_indicators") -> DataFrame:
    """SCO-11: a struct of appraiser-based indicators and the total adjustment."""
    u = F.upper(_text(df, "property_use"))
    type_points = first_hit([(u.contains("WAREH") | u.contains("DIST"), 3), (u.contains("INDUSTRIAL"), 2.5),
                             (u.contains("MFG"), 2), (u.contains("STORAGE"), 1.5)])
    year = F.floor(_number(df, "year_built"))
    age = F.when(year > 0, F.year(F.lit(today).cast("date")) - year)
    recent = F.coalesce(days_before(today, F.col("sale_date")) <= 730, F.lit(False)) \
        if "sale_date" in df.columns else F.lit(False)
    land = _number(df, "land_market_value", 1)
    ratio = F.when(land > 0, _number(df, "improvement_value", 0) / land)
    acres = _number(df, "acres" if "acres" in df.columns else "lot_size_acres", 0)
    total = (type_points + first_hit([(age <= 10, 2), (age <= 20, 1)]) + bonus((recent, 1))
             + first_hit([(ratio >= 2, 2), (ratio >= 1, 1)]) + bonus((acres.between(0.5, 10), 1)))
    return df.withColumn(name, F.struct(
        total.alias("flex_score_adjustment"), (type_points > 0).alias("is_flex_compatible"),
        F.coalesce(F.greatest(age, F.lit(0)), F.lit(0)).cast("bigint").alias("building_age"),
        recent.alias("recent_sale"),
        F.coalesce(F.greatest(ratio, F.lit(0.0)), F.lit(0.0)).alias("value_ratio"),
        type_points.alias("property_type_score")))


def adjust(df: DataFrame, base: str, adjustment: str, name: str = "flex_score") -> DataFrame:
    """SCO-13: base plus adjustment held within 0 and 10; without an adjustment the base as it is."""
    start = F.coalesce(F.col(base), F.lit(0.0))
    shifted = F.greatest(F.least(start + F.col(adjustment), F.lit(10.0)), F.lit(0.0))
    return df.withColumn(name, F.coalesce(F.when(F.col(adjustment).isNotNull(), shifted), start))


def demo_score(df: DataFrame, name: str = "flex_score") -> DataFrame:
    """SCO-14: the short demonstration score."""
    size, acres = _number(df, "building_sqft"), _number(df, "lot_size_acres")
    kind = keyword_points(_text(df, "property_type"), {"flex": 3.0, "warehouse": 2.5, "industrial": 2.0})
    total = (first_hit([(size.between(20000, 50000), 3), ((size > 50000) & (size <= 100000), 2), (size > 100000, 1)])
             + kind + first_hit([(acres.between(1, 5), 2), ((acres > 5) & (acres <= 10), 1.5)])
             + bonus((_number(df, "year_built") >= 1990, 1)))
    return df.withColumn(name, F.least(total, F.lit(10.0)))


def classify_file(df: DataFrame, today: str, min_score: float = 4.0) -> DataFrame:
    """SCO-16: score conformed rows, keep those at or above ``min_score`` and add the class label."""
    scored = weighted_score(df, today)
    return scored.where(F.col("flex_score") >= min_score).withColumn(
        "flex_classification", classify_score(F.col("flex_score")))
