"""Column naming: rename plans made on the driver from column names, and checks over a schema catalogue.

A catalogue has one row per column per file: source_file, column, position, type.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from propspark.functions.blocks import block_ratio, characters, shared_bound
from propspark.functions.skew import lookup_join
from propspark.functions.text import guarded_double

# Standard names and the spellings accepted for them, by profile.
PIPELINE_ALIASES = {
    "parcel_id": ["parcel_id", "parcel", "id", "property_id", "parcel id"],
    "site_address": ["site_address", "address", "property_address", "street_address", "property address"],
    "city": ["city", "municipality"],
    "state": ["state", "st"],
    "zip_code": ["zip_code", "zip", "postal_code"],
    "acres": ["acres", "lot_size_acres", "land_acres", "lot size acres"],
    "zoning": ["zoning", "zone", "zoning_code", "zoning code"],
    "improvement_value": ["improvement_value", "building_value", "improvements"],
    "land_market_value": ["land_market_value", "land_value", "assessed_land_value"],
    "total_market_value": ["total_market_value", "market_value", "assessed_value"],
}
PIPELINE_NUMERIC = ["acres", "improvement_value", "land_market_value", "total_market_value"]
PIPELINE_REQUIRED = ["site_address", "city"]
SHEET_ALIASES = {
    "property_type": ["property type", "type", "prop type", "property_type"],
    "building_sqft": ["building sqft", "building_sqft", "sqft", "square feet", "building_sf"],
    "lot_size_acres": ["lot size acres", "lot_size_acres", "acres", "lot acres", "land_acres"],
    "year_built": ["year built", "year_built", "built year", "construction_year"],
    "property_name": ["property name", "property_name", "name", "building_name"],
    "address": ["address", "street_address", "location"],
    "city": ["city", "municipality"],
    "state": ["state", "st"],
    "county": ["county"],
    "owner_name": ["owner name", "owner_name", "owner"],
    "sale_date": ["sale date", "sale_date", "sold_date"],
    "sold_price": ["sold price", "sold_price", "sale_price", "price"],
    "occupancy": ["occupancy", "occupancy_rate", "occupied_percent"],
}
DASHBOARD_ALIASES = {
    "Property Name": ["property_name", "prop_name", "name", "property", "building_name"],
    "Property Type": ["property_type", "prop_type", "type", "building_type", "asset_type"],
    "Address": ["address", "street_address", "location", "street"],
    "City": ["city", "municipality", "town"],
    "County": ["county", "parish"],
    "State": ["state", "province", "region"],
    "Building SqFt": ["building_sqft", "bldg_sqft", "sqft", "square_feet", "building_sf", "sf"],
    "Lot Size Acres": ["lot_size_acres", "lot_acres", "acres", "lot_size", "land_acres"],
    "Year Built": ["year_built", "built_year", "construction_year", "year_constructed"],
    "Sold Price": ["sold_price", "sale_price", "price", "purchase_price", "value"],
    "Occupancy": ["occupancy", "occupancy_rate", "occupied", "vacancy_rate"],
}
DASHBOARD_REQUIRED = ["Property Type", "City", "State"]
PROCESSOR_ALIASES = {
    "property_id": ["id", "prop_id", "property_id", "parcel_id", "pin"],
    "name": ["name", "property_name", "building_name", "site_name"],
    "address": ["address", "street_address", "full_address", "location"],
    "city": ["city", "municipality", "town"],
    "state": ["state", "province", "region"],
    "county": ["county", "district", "parish"],
    "zip_code": ["zip", "zipcode", "postal_code", "zip_code"],
    "property_type": ["type", "property_type", "building_type", "use_type"],
    "building_sqft": ["sqft", "square_feet", "building_sqft", "floor_area", "gfa"],
    "lot_size_acres": ["lot_size", "acres", "lot_acres", "land_area"],
    "year_built": ["year_built", "construction_year", "built_year", "year_constructed"],
    "sold_price": ["price", "sale_price", "sold_price", "market_value"],
    "assessed_value": ["assessed_value", "tax_value", "appraised_value"],
    "rent": ["rent", "rental_rate", "monthly_rent"],
    "occupancy_rate": ["occupancy", "occupancy_rate", "occupied_percent"],
    "cap_rate": ["cap_rate", "capitalization_rate", "yield"],
    "noi": ["noi", "net_operating_income", "operating_income"],
}
RECORD_ALIASES = {
    "acres": ["Lot Size Acres", "Acres", "Land Size", "Lot Acres"],
    "building_sqft": ["Building SqFt", "Building Sq Ft", "Building Square Feet", "Sq Ft"],
    "market_value": ["Market Value", "Assessed Value", "Sale Price", "Sold Price", "Value"],
    "assessed_value": ["Assessed Value", "Tax Value", "Appraised Value"],
    "zoning": ["Zoning", "Zoning Code", "Zone"],
    "year_built": ["Year Built", "Built Year", "Construction Year"],
    "municipality": ["City", "Municipality", "Location"],
    "address": ["Address", "Street Address", "Property Address"],
    "owner_name": ["Owner", "Owner Name", "Property Owner"],
}
CLASSIC_NAMES = {
    "Address": "site_address", "City": "property_city", "State": "property_state", "Building SqFt": "building_size",
    "Lot Size Acres": "lot_acres", "Property Type": "property_type", "Flex Score": "flex_score",
}
LEGACY_NAMES = {
    "site_address": "Address", "property_address": "Address", "street_address": "Address",
    "property_city": "City", "property_state": "State", "building_size": "Building SqFt",
    "building_sqft": "Building SqFt", "lot_acres": "Lot Size Acres", "lot_size": "Lot Size Acres",
    "property_type": "Property Type", "year_built": "Year Built", "flex_score": "Flex Score", "score": "Flex Score",
}
PIPELINE_VERSION = "scalable_v1.0"
EXPORT_NAMES = [
    "Property Name", "Property Type", "Address", "City", "State", "County", "Building SqFt", "Lot Size Acres",
    "Year Built", "Zoning Code", "Sale Date", "Sold Price", "Sold Price/SqFt", "Owner Name", "Occupancy",
]
REQUIRED_GROUPS = [["address", "property address", "site address"], ["city"], ["state"],
                   ["property type", "type", "use type"], ["building", "sqft", "square feet", "building size"]]
RECOMMENDED_GROUPS = [["county"], ["acres", "lot size", "lot acres"], ["year built", "built year"],
                      ["zoning", "zone"], ["owner", "owner name"]]
NUMERIC_NAME_PARTS = ["price", "sqft", "size", "year", "rate"]
NUMERIC_TYPES = ["tinyint", "smallint", "int", "bigint", "float", "double", "decimal"]


def find_column(columns: Sequence[str], terms: Sequence[str]) -> str | None:
    """First column whose lower-cased name contains a term, terms in priority order."""
    return next((c for t in terms for c in columns if t.lower() in c.lower()), None)


# --- table renames -------------------------------------------------------------------------------------------------

def normalize_columns(df: DataFrame, aliases: dict = PIPELINE_ALIASES,
                      required: Sequence[str] = tuple(PIPELINE_REQUIRED)) -> DataFrame:
    """COL-2: exact (case and blank insensitive) alias match; absent columns get 0 or empty text."""
    by_name = {}
    for c in df.columns:
        by_name.setdefault(c.lower().strip(), c)
    plan = {}
    for target, names in aliases.items():
        hit = next((by_name[n] for n in names if n in by_name), None)
        if hit is not None:
            plan[hit] = target
    absent = [r for r in required if r not in plan.values()]
    if absent:
        raise ValueError(f"required columns not found: {absent}")
    renamed = df.withColumnsRenamed(plan)
    fill = {t: F.lit(0.0) if t in PIPELINE_NUMERIC else F.lit("") for t in aliases if t not in renamed.columns}
    return renamed.withColumns(fill) if fill else renamed


def standardize_columns(df: DataFrame, aliases: dict = SHEET_ALIASES) -> DataFrame:
    """COL-3: first spelling found as a part of a column name decides; later targets see earlier renames."""
    names = list(df.columns)
    for target, parts in aliases.items():
        hit = find_column(names, parts)
        if hit is not None and target not in names:
            names[names.index(hit)] = target
    return df.toDF(*names)


def to_legacy(df: DataFrame, fmt: str = "classic", processing_date: str | None = None) -> DataFrame:
    """COL-4: classic (7 renamed columns), enhanced (3 added columns) or minimal (4 columns)."""
    if fmt == "classic":
        return df.select(*[F.col(f"`{k}`").alias(v) for k, v in CLASSIC_NAMES.items() if k in df.columns])
    if fmt == "enhanced":
        day = F.lit(processing_date) if processing_date else F.date_format(F.current_date(), "yyyy-MM-dd")
        return df.withColumns({"processing_date": day, "pipeline_version": F.lit(PIPELINE_VERSION),
                               "data_quality_score": F.lit("high")})
    if fmt == "minimal":
        return df.select(*[c for c in ("Address", "City", "State", "Flex Score") if c in df.columns])
    raise ValueError(f"unknown format {fmt!r}")


def from_legacy(df: DataFrame) -> DataFrame:
    """COL-4: back to the display names; the first of several spellings of one name wins."""
    plan = {}
    for old, new in LEGACY_NAMES.items():
        if old in df.columns and new not in df.columns and new not in plan.values():
            plan[old] = new
    return df.withColumnsRenamed(plan)


def apply_mapping(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """COL-6."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def cleaned_name(name: str, position: int) -> str:
    text = re.sub(r"[^\w\s]", "", name.lower())
    return re.sub(r"\s+", "_", text.strip()).strip("_") or f"column_{position}"


def clean_names(df: DataFrame) -> DataFrame:
    """COL-7."""
    return df.toDF(*[cleaned_name(c, i) for i, c in enumerate(df.columns)])


def _bidirectional(columns: Sequence[str], wanted: str) -> str | None:
    w = wanted.lower()
    return next((c for c in columns if w in c.lower() or c.lower() in w), None)


def to_pipeline_record(df: DataFrame, aliases: dict = RECORD_ALIASES) -> DataFrame:
    """COL-9: scoring record with typed fields; the first alias with a value in the row wins.

    Names match when either contains the other. Years up to 1800 are unknown.
    """
    def values(target, convert):
        hits = [h for h in (_bidirectional(df.columns, a) for a in aliases[target]) if h]
        return [convert(F.col(f"`{h}`")) for h in hits]

    def money(c: Column) -> Column:
        cleaned = guarded_double(F.regexp_replace(c.cast("string"), "[,$ ]", ""))
        return F.when(c.isNotNull(), F.coalesce(cleaned, F.lit(0.0)))

    def text(c: Column) -> Column:
        return c.cast("string")

    def exact(name: str) -> Column:
        return F.col(f"`{name}`").cast("string") if name in df.columns else F.lit(None).cast("string")

    out = {}
    for target in aliases:
        if target in ("acres", "building_sqft", "market_value", "assessed_value"):
            out[target] = F.coalesce(*values(target, money), F.lit(0.0))
        elif target == "year_built":
            known = values(target, lambda c: F.struct(guarded_double(c.cast("string")).cast("int").alias("y"), c.isNotNull().alias("is")))
            first = F.lit(None).cast("int")
            for k in reversed(known):
                first = F.when(k["is"], k["y"]).otherwise(first)
            out[target] = F.when(first > 1800, first)
        else:
            out[target] = F.coalesce(*values(target, text), F.lit(""))
    if "Property Name" in df.columns and not values("address", text):
        out["address"] = F.coalesce(F.nullif(exact("Property Name"), F.lit("")), F.lit(""))
    out["parcel_id"] = exact("Parcel ID")
    out["property_use"] = F.coalesce(exact("Property Type"), F.lit(""))
    kept = [F.col(f"`{c}`") for c in df.columns if c in ("rid",)]
    return df.select(*kept, *[v.alias(k) for k, v in out.items()])


def project_export(df: DataFrame) -> DataFrame:
    """COL-10: the display columns that exist, plus the score."""
    picked, used = [], set()
    for want in EXPORT_NAMES:
        hit = find_column(df.columns, [want.lower()]) or find_column(df.columns, [want.lower().replace(" ", "_")])
        if hit and hit not in used and hit != "flex_score":
            used.add(hit)
            picked.append(F.col(f"`{hit}`").alias(want))
    return df.select(*picked, F.col("flex_score").alias("Flex Score"))


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """COL-13: one pass over the data decides; its one-row result is read on the driver because a schema must be known
    before a plan can be built."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if counts[i] > 0])


# --- catalogue checks ----------------------------------------------------------------------------------------------

def schema_catalog(spark: SparkSession, files: dict[str, DataFrame]) -> DataFrame:
    """Catalogue of the given frames: metadata only, no data is read."""
    rows = [(name, f.name, i, f.dataType.simpleString())
            for name, df in files.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "source_file string, column string, position int, type string")


def csv_catalog(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Catalogue of CSV files by their header lines, all read in one job."""
    from propspark.sources.io import csv_headers

    heads = csv_headers(spark, paths)
    return heads.select(F.element_at(F.split("path", "/"), -1).alias("source_file"), F.posexplode("columns").alias("position", "column")).select(
        "source_file", "column", "position", F.lit("string").alias("type"))


def suggest_mapping(catalog: DataFrame, aliases: dict = PROCESSOR_ALIASES, low: float = 0.6) -> DataFrame:
    """COL-5: best standard name per catalogue row: an exact alias, else the most similar one above ``low``, by the share of
    characters in longest matching blocks.

    Every distinct spelling is compared once with the constant alias table, and block by block only with aliases whose letters
    could reach ``low``; the answers are then looked up per row.
    """
    name = F.lower(F.trim("spelling"))
    pairs = [(std, a.lower()) for std, names in aliases.items() for a in names]
    table = F.array(*[F.struct(F.lit(-i).alias("i"), F.lit(std).alias("std"), F.lit(a).alias("alias"), F.array(*map(F.lit, a)).alias("chars"))
                      for i, (std, a) in enumerate(pairs)])
    own = F.col("chars")
    # An exact spelling scores 2, so that it beats any similarity; ties go to the earlier alias.
    scored = F.transform(table, lambda t: F.struct(
        F.when(F.col("name") == t["alias"], F.lit(2.0)).when(shared_bound(own, t["chars"]) > low, block_ratio(own, t["chars"])).otherwise(F.lit(0.0)).alias("s"),
        t["i"].alias("i"), t["std"].alias("std")))
    # Working on an aggregate result keeps the comparison from being pushed below the aggregate, onto every row.
    spellings = (catalog.groupBy("column").agg(F.max("column").alias("spelling"))
                 .withColumn("name", name).withColumn("chars", characters(F.col("name")))
                 .withColumn("best", F.array_max(scored)).where(F.col("best.s") > low))
    exact = F.col("best.s") == 2.0
    answers = spellings.select(
        "column", F.col("best.std").alias("suggested"), F.when(exact, 1.0).otherwise(F.col("best.s")).alias("confidence"),
        F.when(exact, "exact").otherwise("fuzzy").alias("mapping_type"))
    return lookup_join(catalog, answers, ["column"], "inner", salt_by=["source_file", "position"])


def unmapped_required(catalog: DataFrame, mapping: DataFrame, required: Sequence[str]) -> DataFrame:
    """COL-5: (source_file, suggested) pairs of required names no column of the file maps to."""
    files = catalog.select("source_file").distinct()
    want = files.select("source_file", F.explode(F.array(*[F.lit(r) for r in required])).alias("suggested"))
    return want.join(mapping.select("source_file", "suggested").distinct(), ["source_file", "suggested"], "left_anti")


def validate_names(catalog: DataFrame) -> DataFrame:
    """COL-8: rows (source_file, column, issue)."""
    c = F.col("column")
    per_row = F.array_compact(F.array(
        F.when(c.rlike(r"[^\w\s-]"), F.lit("special_characters")), F.when(F.length(c) > 50, F.lit("long_name")),
        F.when(c.rlike(r"^\d+$"), F.lit("numeric_only"))))
    rows = catalog.select("source_file", "column", F.explode(per_row).alias("issue"))
    repeated = (catalog.groupBy("source_file", "column").agg(F.count("*").alias("n")).where("n > 1")
                .select("source_file", "column", F.lit("duplicate").alias("issue")))
    few = (catalog.groupBy("source_file").agg(F.count("*").alias("n")).where("n < 3")
           .select("source_file", F.lit(None).cast("string").alias("column"), F.lit("few_columns").alias("issue")))
    return rows.unionByName(repeated).unionByName(few)


def column_usage(catalog: DataFrame) -> DataFrame:
    """COL-11: files per column and whether every file has it."""
    c = catalog.select("source_file", F.lower(F.trim("column")).alias("column"))
    total = c.agg(F.count_distinct("source_file").alias("n")).scalar()
    return (c.distinct().groupBy("column").agg(F.count("*").alias("n_files"))
            .withColumn("is_common", F.col("n_files") == total))


def schema_diff(catalog: DataFrame) -> DataFrame:
    """COL-11: rows (source_file, missing_column) against the union of all columns.

    The list of distinct column names is metadata; per file only its own distinct names are gathered.
    """
    c = catalog.select("source_file", F.lower(F.trim("column")).alias("column")).distinct()
    everything = c.agg(F.collect_set("column").alias("a")).scalar()
    own = c.groupBy("source_file").agg(F.collect_set("column").alias("own"))
    return own.select("source_file", F.explode(F.array_except(everything, F.col("own"))).alias("missing_column"))


def check_required(catalog: DataFrame, required: Sequence = tuple(REQUIRED_GROUPS),
                   recommended: Sequence = tuple(RECOMMENDED_GROUPS)) -> DataFrame:
    """COL-12: per file the missing required and recommended groups (named by their first pattern), as flat columns."""
    name = F.lower("column")

    def hit(patterns):
        cond = F.lit(False)
        for p in patterns:
            cond = cond | name.contains(p)
        return F.bool_or(cond)

    groups = [(g[0], hit(g), True) for g in required] + [(g[0], hit(g), False) for g in recommended]
    found = catalog.groupBy("source_file").agg(*[agg.alias(f"g{i}") for i, (_, agg, _) in enumerate(groups)])

    def missing(kind):
        return F.array_compact(F.array(*[F.when(~F.col(f"g{i}"), F.lit(n)) for i, (n, _, k) in enumerate(groups) if k == kind]))

    return found.select("source_file", missing(True).alias("missing_required"),
                        missing(False).alias("missing_recommended"),
                        (F.size(missing(True)) == 0).alias("is_valid"))


def check_types(catalog: DataFrame, expected: dict[str, str] | None = None) -> DataFrame:
    """DQ-17: catalogue rows whose type is not numeric although the name (or ``expected``) says it should be."""
    name = F.lower("column")
    should = F.lit(False)
    for part in NUMERIC_NAME_PARTS:
        should = should | name.contains(part)
    for col, kind in (expected or {}).items():
        should = F.when(F.col("column") == col, F.lit(kind == "numeric")).otherwise(should)
    base = F.regexp_extract("type", r"^([a-z]+)", 1)
    return catalog.where(should & ~base.isin(NUMERIC_TYPES))
