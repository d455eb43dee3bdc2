"""Data quality: profiles, validation against a declared schema, scores and issue lists."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from propspark.functions.quantiles import exact_quantiles, quantile_name, quantile_row, with_row
from propspark.functions.store import stored
from propspark.functions.text import clean_numeric, guarded_double
from propspark.operators.analytics import profile, value_counts
from propspark.operators.clean import hash128, numeric_columns, text_columns, value_keys
from propspark.operators.schema import DASHBOARD_REQUIRED, find_column

# Fields, bounds and penalties of the quality rules.
KEY_FIELDS = ["building_sqft", "property_type", "sale_date", "sold_price", "year_built", "lot_size_acres", "zoning", "county"]
REPORT_FIELDS = ["address", "city", "state", "flex_score", "lot_size_acres", "zoning"]
READINESS_COLUMNS = {
    "property_type": ["property type", "type", "property_type"],
    "building_size": ["building sqft", "building_sqft", "sqft", "square_feet"],
    "lot_size": ["lot size acres", "lot_size_acres", "acres", "lot_acres"],
}
DASH_NUMERIC = ["Building SqFt", "Sold Price", "Lot Size Acres", "Year Built", "Occupancy"]
DASH_RECOMMENDED = ["Property Name", "Building SqFt", "Lot Size Acres", "County"]
DASH_OPTIONAL = ["Address", "Year Built", "Sold Price", "Loan Amount", "Interest Rate", "Number of Units",
                 "Lot Size SqFt", "Occupancy"]
NEVER_NEGATIVE = ["price", "sqft", "acres", "year_built"]


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b)


def q(name: str) -> Column:
    return F.col(f"`{name}`")


# --- profiles ------------------------------------------------------------------------------------------------------

def profile_columns(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """DQ-1: one row per column: counts, distinct values, text lengths, and moments and quartiles of numbers.

    With ``exact=False`` distinct values are estimated in one pass and never shuffled.
    """
    cols = list(cols or df.columns)
    types = dict(df.dtypes)
    length = F.length("value")
    sizes = [F.avg(length).alias("avg_length"), F.max(length).alias("max_length"), F.min(length).alias("min_length")]
    total = F.sum("n")
    if exact:
        known, size = F.col("known"), F.col("length")
        stats = value_keys(df, cols, length=F.length).groupBy("column").agg(
            total.alias("n_rows"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("non_null_count"), F.count_if(known).alias("unique_count"),
            (F.sum(size * F.col("n")) / F.sum(F.when(known, F.col("n")))).alias("avg_length"), F.max(size).alias("max_length"), F.min(size).alias("min_length"))
    else:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
        stats = df.select(F.inline(pairs)).groupBy("column").agg(
            F.count("*").alias("n_rows"), F.count("value").alias("non_null_count"),
            F.approx_count_distinct("value").alias("unique_count"), *sizes)
    numbers = [c for c in numeric_columns(df) if c in cols]
    is_text = F.col("column").isin([c for c in cols if types[c] == "string"])
    out = stats.withColumns({
        "null_count": F.col("n_rows") - F.col("non_null_count"),
        "null_percentage": ratio(F.col("n_rows") - F.col("non_null_count"), F.col("n_rows")) * 100,
        "unique_percentage": ratio(F.col("unique_count"), F.col("n_rows")) * 100,
        **{c: F.when(is_text, F.col(c)) for c in ("avg_length", "max_length", "min_length")}})
    if numbers:
        moments = profile(df, numbers).drop("n").withColumnsRenamed({"q50": "median"})
        out = out.join(F.broadcast(moments), "column", "left")
    return out


def top_values(df: DataFrame, n: int = 5) -> DataFrame:
    """DQ-1: most frequent values of every text column."""
    return value_counts(df, text_columns(df), n)


def completeness(df: DataFrame, fields: Sequence[str] = tuple(KEY_FIELDS)) -> DataFrame:
    """DQ-2: rows (field, complete_records, missing_records, completeness) for the fields that exist."""
    parts = [F.struct(F.lit(f).alias("field"), F.count(q(f)).alias("complete_records"),
                      F.count_if(q(f).isNull()).alias("missing_records"),
                      (ratio(F.count(q(f)), F.count("*")) * 100).alias("completeness"))
             for f in fields if f in df.columns]
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def completeness_summary(df: DataFrame, fields: Sequence[str] = tuple(KEY_FIELDS)) -> DataFrame:
    """DQ-2: average, minimum, maximum and the number of complete fields."""
    c = F.col("completeness")
    return completeness(df, fields).agg(
        F.avg(c).alias("average_completeness"), F.min(c).alias("min_completeness"), F.max(c).alias("max_completeness"),
        F.count("*").alias("fields_analyzed"), F.count_if(c == 100).alias("complete_fields"),
        F.count_if(c < 100).alias("incomplete_fields"))


def cell_completeness(df: DataFrame) -> DataFrame:
    """DQ-3: one row: cells that hold a value, columns with gaps, columns by kind."""
    counts = [F.count(q(c)) for c in df.columns]
    gaps = [F.when(n < F.count("*"), 1).otherwise(0) for n in counts]
    cells = F.count("*") * len(df.columns)
    dates = sum(t in ("date", "timestamp", "timestamp_ntz") for _, t in df.dtypes)
    return df.agg(
        F.count("*").alias("total_rows"), F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
        F.lit(len(numeric_columns(df))).cast("bigint").alias("numeric_columns"),
        F.lit(len(text_columns(df))).cast("bigint").alias("text_columns"), F.lit(dates).cast("bigint").alias("datetime_columns"),
        sum(gaps).cast("bigint").alias("columns_with_nulls"), (cells - sum(counts)).alias("total_missing_values"),
        (ratio(sum(counts), cells) * 100).alias("overall_completeness"))


# --- validation ----------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class TableSchema:
    """Declared layout of a file."""

    required: tuple = ("Property Name", "Address", "City", "State", "Property Type", "Building SqFt")
    optional: tuple = ("Lot Size Acres", "Year Built", "Occupancy Rate", "County", "Zip Code", "Owner Name", "Flex Score")
    types: dict = field(default_factory=lambda: {
        "Property Name": "string", "Address": "string", "City": "string", "State": "string", "Property Type": "string",
        "Building SqFt": "numeric", "Lot Size Acres": "numeric", "Year Built": "numeric", "Occupancy Rate": "numeric",
        "Flex Score": "numeric"})
    nullable: tuple = ("Lot Size Acres", "Year Built", "Occupancy Rate", "County", "Zip Code", "Owner Name", "Flex Score")
    min_records: int = 1
    max_null_pct: float = 80.0


def _as_number(df: DataFrame, c: str) -> Column:
    return guarded_double(q(c)) if dict(df.dtypes)[c] == "string" else q(c).cast("double")


def _file_stats(df: DataFrame, schema: TableSchema, file: str):
    cols = [c for c in df.columns if c != file]
    typed = [c for c, t in schema.types.items() if c in cols]
    bad = [c for c in typed if schema.types[c] == "numeric"]
    aggs = [F.count("*").alias("n")]
    aggs += [(F.count_if(q(c).isNull()) / F.count("*") * 100).alias(f"null_{i}") for i, c in enumerate(cols)]
    aggs += [F.count_if(_as_number(df, c).isNull() & q(c).isNotNull()).alias(f"bad_{i}") for i, c in enumerate(bad)]
    return df.groupBy(file).agg(*aggs), cols, typed, bad


def validate(df: DataFrame, schema: TableSchema = TableSchema(), file: str = "source_file") -> DataFrame:
    """DQ-4: one row per file: validity, record count, column differences, issue counts and a 0-100 score.

    Column names are checked on the plan; everything about the rows is one aggregate over the files.
    """
    stats, cols, typed, bad = _file_stats(df, schema, file)
    missing = sorted(set(schema.required) - set(cols))
    extra = sorted(set(cols) - set(schema.required) - set(schema.optional))
    nulls = {c: F.col(f"null_{i}") for i, c in enumerate(cols)}
    type_issues = sum([F.when(F.col(f"bad_{i}") > 0, 1).otherwise(0) for i in range(len(bad))], F.lit(0))
    null_warnings = sum([F.when(v > 0, 1).otherwise(0) for c, v in nulls.items() if c not in schema.nullable], F.lit(0))
    null_warnings = null_warnings + sum([F.when(v > schema.max_null_pct, 1).otherwise(0) for v in nulls.values()], F.lit(0))
    scores = [F.lit((len(schema.required) - len(missing)) / len(schema.required) * 100)]
    if cols:
        scores.append(F.greatest(F.lit(0.0), 100 - sum(nulls.values()) / len(cols)))
    if typed:
        scores.append((len(typed) - type_issues) / len(typed) * 100)
    scores.append(F.when(F.col("n") >= 100, 100).when(F.col("n") >= 10, 80).when(F.col("n") >= 1, 60).otherwise(0))
    enough = F.col("n") >= schema.min_records
    return stats.select(
        file, (enough & F.lit(not missing)).alias("is_valid"), F.col("n").alias("record_count"),
        F.lit(", ".join(missing)).alias("missing_columns"), F.lit(", ".join(extra)).alias("extra_columns"),
        F.when(enough, 0).otherwise(1).cast("bigint").alias("error_count"),
        (type_issues + null_warnings + (1 if extra else 0)).cast("bigint").alias("warning_count"),
        F.lit(1 if missing else 0).cast("bigint").alias("schema_issue_count"),
        (sum(scores) / len(scores)).alias("quality_score"))


def validation_issues(df: DataFrame, schema: TableSchema = TableSchema(), file: str = "source_file") -> DataFrame:
    """DQ-4: rows (file, column, issue, pct): types, unexpected nulls, too many nulls."""
    stats, cols, _, bad = _file_stats(df, schema, file)
    item = lambda c, kind, cond, pct: F.when(cond, F.struct(F.lit(c).alias("column"), F.lit(kind).alias("issue"), pct.alias("pct")))
    items = [item(c, "not_numeric", F.col(f"bad_{i}") > 0, F.col(f"bad_{i}") / F.col("n") * 100) for i, c in enumerate(bad)]
    for i, c in enumerate(cols):
        v = F.col(f"null_{i}")
        if c not in schema.nullable:
            items.append(item(c, "null_not_allowed", v > 0, v))
        items.append(item(c, "too_many_nulls", v > schema.max_null_pct, v))
    return stats.select(file, F.inline(F.array_compact(F.array(*items))))


def rollup(validations: DataFrame) -> DataFrame:
    """DQ-7: one row over all validated files."""
    s, n = F.col("quality_score"), F.count("*")
    ok = F.count_if("is_valid")
    return validations.agg(
        n.alias("total_files"), ok.alias("valid_files"), (n - ok).alias("invalid_files"),
        (ratio(ok, n) * 100).alias("success_rate"), F.sum("record_count").alias("total_records"),
        F.avg(s).alias("average_quality_score"), F.min(s).alias("min_quality_score"), F.max(s).alias("max_quality_score"),
        F.count_if(s >= 80).alias("files_above_80_percent"), F.count_if(s < 50).alias("files_below_50_percent"),
        F.sum("error_count").alias("total_errors"), F.sum("warning_count").alias("total_warnings"))


def common_issues(issues: DataFrame, n: int = 5) -> DataFrame:
    """DQ-7: most frequent issues over all files."""
    label = F.concat_ws(": ", "issue", "column")
    return (issues.groupBy(label.alias("issue")).agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "issue").limit(n))


# --- whole-table scores --------------------------------------------------------------------------------------------

def _members(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows that share their key with another row, and the number of such keys."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("members"), F.count("*").alias("keys"))


def assess_quality(df: DataFrame, keys: Sequence[str] = ("address", "city", "state"),
                   numeric: Sequence[str] = ("building_sqft", "lot_size_acres", "year_built", "occupancy", "flex_score")) -> DataFrame:
    """DQ-5: duplicates (all members), completeness, numeric consistency and the mean of the scores above zero."""
    shares = [ratio(F.count(q(c)), F.count("*")) * 100 for c in df.columns]
    numbers = [ratio(F.count(_as_number(df, c)), F.count(q(c))) * 100 for c in numeric if c in df.columns]
    known = F.array_compact(F.array(*numbers)) if numbers else F.array().cast("array<double>")
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known))
    have = all(k in df.columns for k in keys)
    dup = _members(df, keys).select("members").scalar() if have else F.lit(0).cast("bigint")
    out = df.agg(F.count("*").alias("total_records"), (sum(shares) / len(shares)).alias("completeness_score"),
                 F.coalesce(mean, F.lit(0.0)).alias("consistency_score")).withColumn("duplicate_records", dup)
    pct = F.coalesce(ratio(F.col("duplicate_records"), F.col("total_records")) * 100, F.lit(0.0))
    scores = F.filter(F.array(F.col("completeness_score"), F.col("consistency_score"), 100 - F.least(pct, F.lit(50.0))), lambda x: x > 0)
    return out.withColumns({
        "unique_records": F.col("total_records") - F.col("duplicate_records"), "duplicate_percentage": pct,
        "overall_quality_score": F.try_divide(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x), F.size(scores))})


def consistency(df: DataFrame, year: int, keys: Sequence[str] = ("address", "city", "state"), sqft: str = "building_sqft",
                lot: str = "lot_size_acres", built: str = "year_built", state: str = "state") -> DataFrame:
    """DQ-6: rows (rule, n) of the rules that some rows break; duplicates also give the number of shared keys."""
    rules = [(sqft, 1000, 10000000), (lot, 0.1, 1000), (built, 1800, year + 2)]
    items = []
    for c, lo, hi in rules:
        if c in df.columns:
            v = _as_number(df, c)
            items.append(F.struct(F.lit(f"{c}_out_of_range").alias("rule"), F.count_if((v < lo) | (v > hi)).alias("n")))
    if state in df.columns:
        items.append(F.struct(F.lit("invalid_state").alias("rule"), F.count_if(F.length(q(state)) != 2).alias("n")))
    rows = df.agg(F.array(*items).alias("a")).select(F.inline("a"))
    if all(k in df.columns for k in keys):
        dup = _members(df, keys).select(F.inline(F.array(
            F.struct(F.lit("duplicate_records").alias("rule"), F.col("members").alias("n")),
            F.struct(F.lit("duplicate_keys").alias("rule"), F.col("keys").alias("n")))))
        rows = rows.unionByName(dup)
    return rows.where(F.col("n") > 0)


def readiness(df: DataFrame) -> DataFrame:
    """DQ-8: 0-10 score: 2 off per missing column, up to 2 off per column for nulls and 1.5 for failed casts."""
    score, parts = F.lit(10.0), []
    for name, terms in READINESS_COLUMNS.items():
        col = find_column(df.columns, terms)
        if col is None:
            score = score - 2.0
            continue
        nulls = F.count_if(q(col).isNull()) / F.count("*") * 100
        parts.append(nulls.alias(f"{name}_null_pct"))
        score = score - F.when(nulls > 50, 2.0).when(nulls > 25, 1.0).when(nulls > 10, 0.5).otherwise(0.0)
        if name != "property_type":
            failed = F.count_if(_as_number(df, col).isNull() & q(col).isNotNull()) / F.count("*") * 100
            parts.append(failed.alias(f"{name}_failed_pct"))
            score = score - F.when(failed > 10, 1.5).when(failed > 5, 1.0).when(failed > 1, 0.5).otherwise(0.0)
    return df.agg(F.count("*").alias("total_properties"), *parts,
                  F.greatest(F.least(score, F.lit(10.0)), F.lit(0.0)).alias("quality_score"))


def outlier_bounds(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """One row per column: quartiles and the bounds k·IQR beyond them."""
    at = lambda p: F.max(F.when(F.col("prob") == p, F.col("value")))
    quartiles = exact_quantiles(df, cols, [0.25, 0.75]).groupBy("column").agg(at(0.25).alias("q1"), at(0.75).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    return quartiles.withColumns({"lower_bound": F.col("q1") - k * iqr, "upper_bound": F.col("q3") + k * iqr})


def _bounds_row(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """One row with the fields lo_i and hi_i of the i-th column."""
    quartiles = quantile_row(df, cols, [0.25, 0.75])
    out = []
    for i, c in enumerate(cols):
        q1, q3 = F.col(quantile_name(c, 0.25)), F.col(quantile_name(c, 0.75))
        out += [(q1 - k * (q3 - q1)).alias(f"lo_{i}"), (q3 + k * (q3 - q1)).alias(f"hi_{i}")]
    return quartiles.select(*out)


def mark_outliers(df: DataFrame, cols: Sequence[str], prefix: str = "__o") -> DataFrame:
    """``df`` with a boolean column per given column: whether the value lies beyond the bounds."""
    bounded = with_row(df, _bounds_row(df, cols), "__b")
    b = F.col("__b")
    flags = {f"{prefix}{i}": F.coalesce((q(c).cast("double") < b[f"lo_{i}"]) | (q(c).cast("double") > b[f"hi_{i}"]), F.lit(False))
             for i, c in enumerate(cols)}
    return bounded.withColumns(flags).drop("__b")


def outliers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """DQ-11: rows (column, n_outliers, pct)."""
    marked = mark_outliers(stored(df.select(*cols)), cols)  # three passes for the bounds, one for the counts
    parts = [F.struct(F.lit(c).alias("column"), F.count_if(f"__o{i}").alias("n_outliers"),
                      (ratio(F.count_if(f"__o{i}"), F.count("*")) * 100).alias("pct")) for i, c in enumerate(cols)]
    return marked.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def outlier_rows(df: DataFrame, col: str) -> DataFrame:
    """DQ-11: the rows outside the bounds."""
    return mark_outliers(df, [col]).where("__o0").drop("__o0")


def case_variants(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per text column: distinct values, distinct lower-cased values, and whether they differ."""
    fold = lambda v: F.struct(*[h.alias(n) for h, n in zip(hash128(F.lower(v)), "ab")])
    folded = value_keys(df, cols, fold=fold).where("known").groupBy("column", "fold").agg(F.count("*").alias("n"))
    return folded.groupBy("column").agg(F.sum("n").alias("n_values"), F.count("*").alias("n_folded"),
                                        (F.sum("n") > F.count("*")).alias("inconsistent"))


def quality4(df: DataFrame) -> DataFrame:
    """DQ-9: one row: completeness, consistency, validity, uniqueness, their mean and validity (mean above .3)."""
    return quality4_of(stored(df))  # five passes follow


def quality4_of(df: DataFrame) -> DataFrame:
    """DQ-9 of rows that are stored already."""
    numbers, words, n_cols = numeric_columns(df), text_columns(df), len(df.columns)
    cells = sum([F.count(q(c)) for c in df.columns])
    negative = {c: q(c) < 0 for c in numbers if c.lower() in NEVER_NEGATIVE}
    marked = mark_outliers(df, numbers) if numbers else df
    validity = F.lit(float(n_cols - len(numbers)))
    for i, c in enumerate(numbers):
        share = F.count_if(f"__o{i}") / F.count("*") * 100
        score = F.when(share > 5, F.greatest(F.lit(0.5), 1 - share / 100)).otherwise(1.0)
        if c in negative:
            score = F.when(F.count_if(negative[c]) > 0, F.least(score, F.lit(0.8))).otherwise(score)
        validity = validity + score
    bad_case = case_variants(df, words).agg(F.count_if("inconsistent").alias("n")).scalar() if words else F.lit(0)
    first, second = hash128(*[q(c) for c in df.columns])  # rows are told apart by 128 bits
    unique = df.select(first.alias("a"), second.alias("b")).distinct().agg(F.count("*").alias("n")).scalar()
    out = marked.agg(F.count("*").alias("n_rows"), ratio(cells, F.count("*") * n_cols).alias("completeness"),
                     (validity / n_cols).alias("validity"))
    scores = ["completeness", "consistency", "validity", "uniqueness"]
    out = out.withColumns({"consistency": (n_cols - 0.3 * bad_case) / n_cols, "uniqueness": ratio(unique, F.col("n_rows"))})
    mean = sum(F.col(s) for s in scores) / 4
    return out.withColumns({"quality_score": mean, "is_valid": mean > 0.3})


def quality_dash(df: DataFrame) -> DataFrame:
    """DQ-10: completeness 40, consistency 25, validity 20, accuracy 15, and the structure score 40/30/30."""
    types = dict(df.dtypes)
    cells = ratio(sum([F.count(q(c)) for c in df.columns]), F.count("*") * len(df.columns))
    numeric = [c for c in DASH_NUMERIC if c in df.columns and types[c] != "string"]
    present = [c for c in DASH_NUMERIC if c in df.columns]
    checks = []
    if "Year Built" in df.columns:
        v = _as_number(df, "Year Built")
        checks.append(F.coalesce(ratio(F.count_if(v.between(1800, 2025)), F.count(v)), F.lit(0.0)))
    if "Building SqFt" in df.columns:
        v = _as_number(df, "Building SqFt")
        checks.append(F.coalesce(ratio(F.count_if((v > 0) & (v < 10000000)), F.count(v)), F.lit(0.0)))
    accuracy = sum(checks) / len(checks) * 15 if checks else F.lit(0.0)
    known = DASHBOARD_REQUIRED + DASH_RECOMMENDED + DASH_OPTIONAL
    structure = (F.lit(sum(c in df.columns for c in known) / len(known) * 40) + cells * 30
                 + F.lit(len(present) / len(DASH_NUMERIC) * 30))
    out = df.agg((cells * 40).alias("completeness"), accuracy.alias("accuracy"),
                 F.least(structure, F.lit(100.0)).alias("structure_score"))
    return out.withColumns({
        "consistency": F.lit(len(numeric) / len(DASH_NUMERIC) * 25),
        "validity": F.lit(sum(c in df.columns for c in DASHBOARD_REQUIRED) / len(DASHBOARD_REQUIRED) * 20),
    }).withColumn("total_score", F.col("completeness") + F.col("consistency") + F.col("validity") + F.col("accuracy"))


def cleaning_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """DQ-12: per column the NULLs before and after numeric cleaning, recovered and lost values, and outliers after it."""
    cols = [c for c in cols if c in df.columns]
    types = dict(df.dtypes)
    after = df.select(*[F.struct(q(c).isNull().alias("was"), (clean_numeric(q(c)) if types[c] == "string" else q(c).cast("double")).alias("v")).alias(f"c{i}")
                        for i, c in enumerate(cols)])
    flat = after.select(*[F.col(f"c{i}.v").alias(f"v{i}") for i in range(len(cols))], *[F.col(f"c{i}.was").alias(f"w{i}") for i in range(len(cols))])
    marked = mark_outliers(flat, [f"v{i}" for i in range(len(cols))], "o")
    parts = []
    for i, c in enumerate(cols):
        before, now = F.count_if(f"w{i}"), F.count_if(F.col(f"v{i}").isNull())
        parts.append(F.struct(F.lit(c).alias("column"), before.alias("nulls_before"), now.alias("nulls_after"),
                              F.greatest(before - now, F.lit(0)).alias("recovered"), F.greatest(now - before, F.lit(0)).alias("lost"),
                              F.count_if(f"o{i}").alias("n_outliers"), F.lit(types[c] == "string").alias("type_changed")))
    return marked.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def report_quality(df: DataFrame, fields: Sequence[str] = tuple(REPORT_FIELDS), score: str = "flex_score",
                   non_negative: Sequence[str] = ("lot_size_acres", "improvement_value", "land_market_value")) -> DataFrame:
    """DQ-13: one row: anomaly counts and completeness * 100 less 5 per kind of anomaly (30 at most)."""
    anomalies = {}
    if score in df.columns:
        anomalies["invalid_scores"] = F.count_if((q(score) < 0) | (q(score) > 10))
    anomalies |= {f"negative_{c}": F.count_if(q(c) < 0) for c in non_negative if c in df.columns}
    rates = [F.bround(ratio(F.count(q(f)), F.count("*")), 3) for f in fields if f in df.columns]
    kinds = sum([F.when(a > 0, 1).otherwise(0) for a in anomalies.values()], F.lit(0))
    total = sum(rates) / len(rates) * 100 - F.least(kinds * 5, F.lit(30))
    return df.agg(F.count("*").alias("total_records"), *[a.alias(n) for n, a in anomalies.items()],
                  F.greatest(F.least(total, F.lit(100.0)), F.lit(0.0)).alias("overall_quality_score"))


def issues(df: DataFrame, max_null: float = 50.0, min_unique: float = 5.0) -> DataFrame:
    """DQ-14: rows (column, issue, pct): columns that are mostly empty and text columns with few distinct values."""
    words = text_columns(df)
    counts = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.count("*").alias("n"), F.count_if(q(c).isNull()).alias("nulls")) for c in df.columns]).alias("a"))
    base = counts.select(F.inline("a"))
    if words:
        distinct = value_keys(df, words).groupBy("column").agg(F.count_if("known").alias("u"))
        base = base.join(F.broadcast(distinct), "column", "left")  # one row a column
    else:
        base = base.withColumn("u", F.lit(None).cast("bigint"))
    nulls, unique = ratio(F.col("nulls"), F.col("n")) * 100, ratio(F.col("u"), F.col("n")) * 100
    text = F.col("column").isin(words)
    found = F.array_compact(F.array(
        F.when(nulls > max_null, F.struct(F.lit("high_missing").alias("issue"), nulls.alias("pct"))),
        F.when(text & (unique < min_unique) & (F.col("u") > 1), F.struct(F.lit("low_diversity").alias("issue"), unique.alias("pct")))))
    return base.select("column", F.inline(found))


def plausibility(df: DataFrame, zoning: str, tax: str, market: str, fail: bool = False) -> DataFrame:
    """DQ-15: one row: distinct zones, spread of the tax rate and whether the data looks made up; ``fail`` raises then."""
    rate = F.try_divide(q(tax), q(market))
    zones, spread = F.count_distinct(q(zoning)), F.stddev_samp(rate)
    out = df.agg(zones.alias("zoning_codes"), spread.alias("tax_rate_std"), F.min(rate).alias("min_rate"), F.max(rate).alias("max_rate"))
    out = out.withColumns({"single_zoning": F.col("zoning_codes") == 1, "constant_tax_rate": F.coalesce(F.col("tax_rate_std") < 0.001, F.lit(False))})
    if not fail:
        return out
    suspicious = F.col("single_zoning") | F.col("constant_tax_rate")
    return out.withColumn("checked", F.when(suspicious, F.raise_error(F.lit("implausible data: single zoning or constant tax rate")).cast("boolean"))
                          .otherwise(F.lit(True)))


def fingerprint(df: DataFrame) -> DataFrame:
    """DQ-16: layout hash, shape and an order-free hash of the rows."""
    import hashlib

    layout = hashlib.md5(repr(df.dtypes).encode()).hexdigest()
    row = F.xxhash64(*[q(c) for c in df.columns]).cast("decimal(20,0)")
    return df.agg(F.lit(layout).alias("schema_hash"), F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
                  F.count("*").alias("n_rows"), F.sum(row).cast("string").alias("content_hash"))


def quarantine(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """DQ-18: ``scoring_errors`` names the fields whose text is not a number; NULL means the row can be scored."""
    types = dict(df.dtypes)
    bad = [F.when(clean_numeric(q(c)).isNull() & q(c).isNotNull(), F.lit(f"{c}: not a number"))
           for c in numeric if types.get(c) == "string"]
    if not bad:
        return df.withColumn("scoring_errors", F.lit(None).cast("string"))
    return df.withColumn("scoring_errors", F.nullif(F.concat_ws("; ", *bad), F.lit("")))


def split_quarantine(df: DataFrame, numeric: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """DQ-18: (good rows, quarantined rows)."""
    marked = quarantine(df, numeric)
    return marked.where(F.col("scoring_errors").isNull()).drop("scoring_errors"), marked.where(F.col("scoring_errors").isNotNull())


def processing_report(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """DQ-19: rows (section, key, value): nulls per column, outliers, type changes, score parts, recommendations.

    The input is computed once; every part reads the columns it needs of the stored rows.
    """
    df = stored(df)
    n = F.count("*")
    null_items = F.array(*[F.struct(F.lit("null_handling").alias("section"), F.lit(c).alias("key"), F.count_if(q(c).isNull()).cast("double").alias("value"),
                                    (F.count_if(q(c).isNull()) / n > 0.3).alias("alarm")) for c in df.columns])
    nulls = df.agg(null_items.alias("a")).select(F.inline("a")).where(F.col("value") > 0)
    cleaned = cleaning_report(df, numeric).select("column", F.col("n_outliers").cast("double").alias("o"), "type_changed")
    found = cleaned.where(F.col("o") > 0).select(F.lit("outliers_detected").alias("section"), F.col("column").alias("key"), F.col("o").alias("value"))
    changed = cleaned.where("type_changed").select(F.lit("type_conversions").alias("section"), F.col("column").alias("key"), F.lit(1.0).alias("value"))
    dash = quality_dash(df)
    parts = ["completeness", "consistency", "validity", "accuracy", "total_score"]
    tip = lambda key, cond, value: F.when(cond, F.struct(F.lit("recommendation").alias("section"), F.lit(key).alias("key"), value.alias("value")))
    score = dash.select(F.inline(F.array_compact(F.array(
        *[F.struct(F.lit("quality_breakdown").alias("section"), F.lit(p).alias("key"), F.col(p).alias("value")) for p in parts],
        tip("low_quality_score", F.col("total_score") < 70, F.col("total_score")),
        tip("low_completeness", F.col("completeness") < 30, F.col("completeness")),
        tip("type_inconsistencies", F.col("consistency") < 15, F.col("consistency"))))))
    tips = (nulls.where("alarm").groupBy(F.lit("recommendation").alias("section"), F.lit("high_missing_data").alias("key"))
            .agg(F.count("*").cast("double").alias("value")))
    review = (found.groupBy(F.lit("recommendation").alias("section"), F.lit("review_outliers").alias("key"))
              .agg(F.sum("value").alias("value")))
    return nulls.drop("alarm").unionByName(found).unionByName(changed).unionByName(score).unionByName(tips).unionByName(review)
