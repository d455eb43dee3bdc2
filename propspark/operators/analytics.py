"""Aggregations and rankings. Each report is one aggregate pass; medians come from exact distributed quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from propspark.functions.quantiles import (exact_quantiles, long_values, quantile_name, quantile_row, scalar_row, with_row)
from propspark.functions.store import stored
from propspark.functions.text import clean_numeric_zero, contains_any
from propspark.operators.filters import INDUSTRIAL_KEYWORDS, typed
from propspark.operators.scoring import COMPONENTS

TYPE_KEYWORDS = [w for w in INDUSTRIAL_KEYWORDS if w != "light industrial"]


def _present(df: DataFrame, cols: Sequence[str]) -> list[str]:
    return [c for c in cols if c in df.columns]


def _count_between(c: Column, low=None, high=None, high_closed=False) -> Column:
    cond = c.isNotNull()
    if low is not None:
        cond = cond & (c >= low)
    if high is not None:
        cond = cond & ((c <= high) if high_closed else (c < high))
    return F.count_if(cond)


# --- sorting and ranking -------------------------------------------------------------------------------------------

def sort_score(df: DataFrame, score: str = "flex_score", tie: Sequence[str] = ("parcel_id", "rid")) -> DataFrame:
    """SRT-1: best first; NULL scores last; ties in a stable order."""
    return df.orderBy(F.desc_nulls_last(score), *_present(df, tie))


def top_n(df: DataFrame, n: int = 100, score: str = "flex_score",
          tie: Sequence[str] = ("parcel_id", "rid")) -> DataFrame:
    """SRT-2: every task keeps its own ``n`` best rows before they are merged."""
    return sort_score(df, score, tie).limit(n)


# Rows up to which a page is taken from a plain sort, whose offset passes through one task.
SHALLOW = 100_000


class Pages:
    """SRT-3: the rows in their final order, stored once in range partitions whose sizes are known, for pages at any depth.

    ``at`` is a row's place in its partition. A page looks its first and last place up in the list of sizes and reads only
    the partitions that hold it, and of those, as they are sorted by place, only the row groups it needs.
    """

    def __init__(self, df: DataFrame, order: Sequence[Column], parts: int | None = None):
        spark = df.sparkSession
        parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
        numbered = (df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                    .withColumn("__no", F.monotonically_increasing_id()))  # the partition in the upper bits, the place in the lower 33
        self.columns = df.columns
        self.rows = stored(numbered.withColumns({"__part": F.shiftright("__no", 33).cast("int"), "__at": F.col("__no").bitwiseAND((1 << 33) - 1)}).drop("__no"),
                           by=["__part"])
        sizes = self.rows.groupBy("__part").agg(F.count("*").alias("n")).orderBy("__part").collect()  # one row a partition
        self.begin, held = {}, 0
        for r in sizes:
            self.begin[r["__part"]] = (held, r["n"])
            held += r["n"]
        self.total = held

    def page(self, offset: int, n: int) -> DataFrame:
        """``n`` rows after ``offset``, in order."""
        wanted = F.lit(False)
        for part, (first, size) in self.begin.items():
            low, high = max(offset - first, 0), min(offset + n - first, size)
            if low < high:
                wanted = wanted | ((F.col("__part") == part) & (F.col("__at") >= low) & (F.col("__at") < high))
        return self.rows.where(wanted).orderBy("__part", "__at").select(*self.columns)


def page(df: DataFrame, newest: str, offset: int, n: int, tie: Sequence[str] = (), shallow: int = SHALLOW) -> DataFrame:
    """SRT-3: newest first, ``n`` rows after ``offset``. Beyond ``shallow`` rows the pages are built (:class:`Pages`) and the
    one asked for is read; whoever turns many pages keeps the :class:`Pages`."""
    order = [F.desc(newest), *map(F.asc, tie)]
    if offset + n > shallow:
        return Pages(df, order).page(offset, n)
    return df.orderBy(*order).offset(offset).limit(n)


def ranked(df: DataFrame, n: int = 10, score: str = "flex_score",
           tie: Sequence[str] = ("parcel_id", "rid")) -> DataFrame:
    """WIN-8: the ``n`` best rows with their rank. The window sees only those ``n`` rows."""
    best = top_n(df, n, score, tie)
    w = Window.orderBy(F.desc_nulls_last(score), *_present(df, tie))
    return best.withColumn("rank", F.row_number().over(w))


# --- AGG-1 … AGG-6 -------------------------------------------------------------------------------------------------

def safe_aggregates(df: DataFrame, col: str, policy: str = "null") -> DataFrame:
    """AGG-1: mean, sum, count, min, max, std and median of a number or of numeric text; empty input gives NULLs."""
    v = clean_numeric_zero(F.col(col)) if policy == "zero" else typed(df, col)
    n = df.select(v.alias("v"))
    med = scalar_row(quantile_row(n, ["v"], [0.5]))
    return n.agg(
        F.avg("v").alias("mean"), F.sum("v").alias("sum"), F.count("v").alias("count"), F.min("v").alias("min"),
        F.max("v").alias("max"), F.stddev_samp("v").alias("std"),
    ).withColumn("median", med[quantile_name("v", 0.5)])


def summary(df: DataFrame) -> DataFrame:
    """AGG-2."""
    s = F.col("flex_score")
    return df.agg(
        F.count("*").alias("total_properties"), F.count_if(s >= 5).alias("flex_candidates"),
        F.count_if(s >= 8).alias("prime_flex"), F.avg(s).alias("average_flex_score"),
        F.sum("market_value").alias("total_market_value"), F.avg("market_value").alias("average_market_value"),
        F.sum("lot_size_acres").alias("total_acres"))


def by_municipality(df: DataFrame, place: str = "city") -> DataFrame:
    """AGG-3."""
    return df.where(F.col(place).isNotNull()).groupBy(place).agg(
        F.count("flex_score").alias("n"), F.avg("flex_score").alias("avg_score"),
        F.max("flex_score").alias("max_score"), F.avg("market_value").alias("avg_value"),
        F.sum("lot_size_acres").alias("total_acres"))


def by_use(df: DataFrame, use: str = "property_use") -> DataFrame:
    """AGG-4."""
    return df.where(F.col(use).isNotNull()).groupBy(use).agg(
        F.count("flex_score").alias("n"), F.avg("flex_score").alias("avg_score"),
        F.avg("market_value").alias("avg_value"))


def value_bands(df: DataFrame) -> DataFrame:
    """AGG-5."""
    v = F.col("market_value")
    return df.agg(
        F.count_if(v < 500000).alias("under_500k"), _count_between(v, 500000, 1000000).alias("from_500k_to_1m"),
        _count_between(v, 1000000, 5000000).alias("from_1m_to_5m"), F.count_if(v >= 5000000).alias("over_5m"),
        F.count_if(v > 1000000).alias("properties_over_1m"),
        F.coalesce(F.avg(F.when(v > 1000000, F.col("flex_score"))), F.lit(0.0)).alias("avg_score_over_1m"))


def score_stats(df: DataFrame, score: str = "flex_score") -> DataFrame:
    """AGG-6. The score is computed once, for the median and the other measures."""
    df = stored(df.select(score))
    s = F.col(score)
    med = scalar_row(quantile_row(df, [score], [0.5]))
    return df.agg(
        F.avg(s).alias("mean"), F.min(s).alias("min"), F.max(s).alias("max"), F.stddev_samp(s).alias("std"),
        F.count_if(s >= 8).alias("high"), _count_between(s, 6, 8).alias("medium"), F.count_if(s < 6).alias("low"),
    ).withColumn("median", med[quantile_name(score, 0.5)])


# --- distributions -------------------------------------------------------------------------------------------------

def size_dist(df: DataFrame, col: str = "building_sqft") -> DataFrame:
    """AGG-7: one row of band counts with mean and median."""
    v = typed(df, col)
    n = df.select(v.alias("v"))
    med = scalar_row(quantile_row(n, ["v"], [0.5]))
    c = F.col("v")
    return n.agg(
        _count_between(c, 20000, 50000).alias("from_20k_to_50k"),
        _count_between(c, 50000, 100000).alias("from_50k_to_100k"),
        _count_between(c, 100000, 200000).alias("from_100k_to_200k"), F.count_if(c >= 200000).alias("over_200k"),
        F.avg(c).alias("mean"),
    ).withColumn("median", med[quantile_name("v", 0.5)])


def lot_dist(df: DataFrame, variant: str = "half_open", col: str = "lot_size_acres") -> DataFrame:
    """AGG-8: lot bands; ``half_open``, ``closed_upper`` or ``report`` borders."""
    c = typed(df, col)
    if variant == "half_open":
        bands = [("from_0_5_to_1", _count_between(c, 0.5, 1)), ("from_1_to_5", _count_between(c, 1, 5)),
                 ("from_5_to_10", _count_between(c, 5, 10)), ("from_10_to_20", _count_between(c, 10, 20, True)),
                 ("over_20", F.count_if(c > 20))]
    elif variant == "closed_upper":
        bands = [("from_0_5_to_1", _count_between(c, 0.5, 1)), ("from_1_to_5", _count_between(c, 1, 5, True)),
                 ("from_5_to_10", F.count_if((c > 5) & (c <= 10))),
                 ("from_10_to_20", F.count_if((c > 10) & (c <= 20))), ("over_20", F.count_if(c > 20))]
    elif variant == "report":
        bands = [("under_1", F.count_if(c < 1)), ("from_1_to_3", _count_between(c, 1, 3)),
                 ("from_3_to_5", _count_between(c, 3, 5)), ("from_5_to_10", _count_between(c, 5, 10)),
                 ("over_10", F.count_if(c >= 10))]
    else:
        raise ValueError(f"unknown variant {variant!r}")
    return df.agg(*[agg.alias(name) for name, agg in bands])


# Lower borders of the score bands, by variant; the last entry holds everything below.
SCORE_BANDS = {
    "five": [("excellent_8_10", 8), ("good_6_8", 6), ("fair_4_6", 4), ("poor_2_4", 2), ("very_poor_0_2", None)],
    "four": [("score_8_to_10", 8), ("score_6_to_8", 6), ("score_4_to_6", 4), ("score_below_4", None)],
    "seven": [("excellent_9_to_10", 9), ("very_good_8_to_9", 8), ("good_7_to_8", 7), ("fair_6_to_7", 6),
              ("marginal_5_to_6", 5), ("poor_4_to_5", 4), ("very_poor_below_4", None)],
}


def score_hist(df: DataFrame, variant: str = "five", score: str = "flex_score") -> DataFrame:
    """AGG-9: one row of score band counts. Scores above 10 belong to no band in the four and seven variants."""
    s, upper, aggs = F.col(score), None, []
    for name, low in SCORE_BANDS[variant]:
        cond = s.isNotNull()
        if low is not None:
            cond = cond & (s >= low)
        if upper is not None:
            cond = cond & (s < upper)
        elif variant != "five":
            cond = cond & (s <= 10)
        aggs.append(F.count_if(cond).alias(name))
        upper = low
    return df.agg(*aggs)


def score_percentiles(df: DataFrame, score: str = "flex_score") -> DataFrame:
    """AGG-9: p10, p25, p50, p75 and p90."""
    return quantile_row(df, [score], [0.1, 0.25, 0.5, 0.75, 0.9])


def _moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return long_values(df, cols).groupBy("column").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))


def profile(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """AGG-15: one row per column: n, mean, std, min, max and a ``q…`` column per probability."""
    cols = _present(df, cols)
    df = stored(df.select(*cols))  # four passes follow
    q = exact_quantiles(df, cols, probs).groupBy("column").agg(*[
        F.max(F.when(F.col("prob") == float(p), F.col("value"))).alias(f"q{p * 100:g}") for p in probs])
    return _moments(df, cols).join(F.broadcast(q), "column", "left")


def component_stats(df: DataFrame) -> DataFrame:
    """AGG-10: mean, median and std of the six components."""
    return profile(df, COMPONENTS, [0.5]).select(
        "column", "mean", F.col("q50").alias("median"), "std")


def value_counts(df: DataFrame, cols: Sequence[str], n: int | None = 10) -> DataFrame:
    """AGG-11: rows (column, value, n, rank) of the ``n`` most frequent non-null values of every column.

    All columns are counted in one pass; ties go to the smaller value.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    counts = (df.select(F.inline(pairs)).where(F.col("value").isNotNull())
              .groupBy("column", "value").agg(F.count("*").alias("n")))
    if n is None:
        return counts
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def hhi(df: DataFrame, col: str = "state") -> DataFrame:
    """AGG-12: sum of squared shares of the non-null values."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").cast("double").alias("n"))
    return counts.agg(F.coalesce(F.try_divide(F.sum(F.col("n") * F.col("n")), F.sum("n") * F.sum("n")), F.lit(0.0))
                      .alias("geographic_concentration"), F.count("*").alias("n_values"))


def corrs(df: DataFrame, size: str = "building_sqft", lot: str = "lot_size_acres",
          score: str = "flex_score") -> DataFrame:
    """AGG-13: Pearson correlations over complete rows."""
    n = df.select(typed(df, size).alias("s"), typed(df, lot).alias("l"), F.col(score).alias("f")).na.drop()
    return n.agg(F.corr("s", "f").alias("building_size_vs_score"), F.corr("l", "f").alias("lot_size_vs_score"),
                 F.corr("s", "l").alias("building_vs_lot_size"))


def optimal_range(df: DataFrame, cols: Sequence[str] = ("building_sqft", "lot_size_acres"), low: float = 7.0,
                  score: str = "flex_score") -> DataFrame:
    """AGG-14: first and third quartile among high scores, one row per column."""
    q = exact_quantiles(df.where(F.col(score) >= low), cols, [0.25, 0.75])
    at = lambda p: F.max(F.when(F.col("prob") == p, F.col("value")))
    return q.groupBy("column").agg(at(0.25).alias("q25"), at(0.75).alias("q75"))


def keyword_stats(df: DataFrame, words: Sequence[str] = tuple(TYPE_KEYWORDS), col: str = "property_type",
                  score: str = "flex_score") -> DataFrame:
    """AGG-16: a row counts under every keyword it contains."""
    low = F.lower(F.col(col))
    hits = F.array_compact(F.array(*[F.when(low.contains(w), F.lit(w)) for w in words]))
    return df.select(F.explode(hits).alias("keyword"), score).groupBy("keyword").agg(
        F.count("*").alias("n"), F.avg(score).alias("avg_score"))


def year_stats(df: DataFrame, col: str = "year_built") -> DataFrame:
    """AGG-17: construction years."""
    n = df.select(typed(df, col).alias("y"))
    med = scalar_row(quantile_row(n, ["y"], [0.5]))
    return n.agg(F.avg("y").alias("mean_year"), F.min("y").cast("bigint").alias("oldest"),
                 F.max("y").cast("bigint").alias("newest")).withColumn("median_year", med[quantile_name("y", 0.5)])


def temporal_counts(df: DataFrame, year: str = "year_built", sale: str = "sale_date") -> DataFrame:
    """AGG-17: rows (section, key, n): buildings per decade and sales per year, in one pass."""
    decade = (F.floor(typed(df, year) / 10) * 10).cast("bigint").cast("string")
    pairs = F.array(F.struct(F.lit("decade").alias("section"), F.concat(decade, F.lit("s")).alias("key")),
                    F.struct(F.lit("sale_year").alias("section"), F.year(sale).cast("string").alias("key")))
    return (df.select(F.inline(pairs)).where(F.col("key").isNotNull())
            .groupBy("section", "key").agg(F.count("*").alias("n")))


def sale_span(df: DataFrame, sale: str = "sale_date") -> DataFrame:
    return df.agg(F.min(sale).alias("earliest_sale"), F.max(sale).alias("latest_sale"))


def insights(df: DataFrame, score: str = "flex_score") -> DataFrame:
    """AGG-18: one row; rates only for more than 100 rows; the three states with most high scores as text."""
    s, total = F.col(score), F.count("*")
    top = value_counts(df.where(s >= 7), ["state"], 3).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]), ", ")
        .alias("v"))
    rate = lambda cond: F.when(total > 100, F.count_if(cond) / total * 100)
    return df.agg(
        total.alias("total_market_size"), F.count_if(s >= 7).alias("high_scoring"),
        (F.try_divide(F.count_if(s >= 7).cast("double"), total) * 100).alias("high_scoring_pct"),
        F.count_if(typed(df, "building_sqft").between(20000, 50000)).alias("optimal_size"),
        rate(s > 0).alias("flex_candidate_rate"), rate(s >= 7).alias("high_quality_rate"),
    ).withColumn("top_states", top.scalar())


def coverage(df: DataFrame, dims: Sequence[str] = ("state", "city", "county", "zoning"),
             score: str = "flex_score") -> DataFrame:
    """AGG-19: rows (dimension, value, n, mean, max) for all dimensions in one pass."""
    dims = _present(df, dims)
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in dims])
    return (df.select(score, F.inline(pairs)).where(F.col("value").isNotNull()).groupBy("dimension", "value")
            .agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.max(score).alias("max")))


def best_cities(df: DataFrame, n: int = 10, score: str = "flex_score") -> DataFrame:
    return coverage(df, ["city"], score).orderBy(F.desc("mean"), "value").limit(n)


def value_chars(df: DataFrame) -> DataFrame:
    """AGG-20: improvement bands and the improvement to land ratio (land above zero)."""
    v, land = F.col("improvement_value"), F.col("land_market_value")
    n = df.select("improvement_value", "land_market_value", F.when(land > 0, v / land).alias("ratio"))
    med = scalar_row(quantile_row(n, ["ratio"], [0.5]))
    return n.agg(
        F.count_if(v < 250000).alias("under_250k"), _count_between(v, 250000, 500000).alias("from_250k_to_500k"),
        _count_between(v, 500000, 1000000).alias("from_500k_to_1m"),
        _count_between(v, 1000000, 2000000).alias("from_1m_to_2m"), F.count_if(v >= 2000000).alias("over_2m"),
        F.avg("ratio").alias("avg_improvement_to_land"),
    ).withColumn("median_improvement_to_land", med[quantile_name("ratio", 0.5)])


def exec_summary(df: DataFrame, runs: DataFrame | None = None, score: str = "flex_score") -> DataFrame:
    """AGG-21: one row about the table, with totals of the per-file ``runs`` when they are given. The columns it reads are
    computed once."""
    df = stored(df.select(*dict.fromkeys([score, "lot_size_acres", "improvement_value", "state", "city", "county"])))
    s = F.col(score)
    med = scalar_row(quantile_row(df, [score], [0.5]))
    out = df.agg(
        F.count("*").alias("unique_flex_properties"), F.avg(s).alias("average_flex_score"),
        F.max(s).alias("highest_flex_score"), F.min(s).alias("lowest_flex_score"),
        F.count_if(s.between(8, 10)).alias("prime_flex_count"), _count_between(s, 6, 8).alias("good_flex_count"),
        _count_between(s, 4, 6).alias("potential_flex_count"), F.count_if(s < 4).alias("unlikely_flex_count"),
        F.avg("lot_size_acres").alias("average_lot_size"), F.avg("improvement_value").alias("average_improvement_value"),
        F.count_distinct("state").alias("unique_states"), F.count_distinct("city").alias("unique_cities"),
        F.count_distinct("county").alias("unique_counties"),
    ).withColumn("median_flex_score", med[quantile_name(score, 0.5)])
    if runs is None:
        return out
    r = scalar_row(runs.agg(
        F.count("*").alias("files"), F.count_if("success").alias("ok"),
        F.sum("property_count").alias("properties")))
    before = r["properties"]
    return out.withColumns({
        "total_files_processed": r["files"], "successful_files": r["ok"], "total_properties_analyzed": before,
        "deduplication_rate": F.try_divide((before - F.col("unique_flex_properties")).cast("double"), before) * 100})


def metrics(df: DataFrame) -> DataFrame:
    """AGG-22: dashboard tiles; numeric text is cleaned first."""
    means = {"avg_price": "sold_price", "avg_size": "building_sqft", "avg_lot_size": "lot_size_acres",
             "avg_occupancy": "occupancy"}
    kinds = {"unique_cities": "city", "unique_counties": "county", "unique_states": "state"}
    return df.agg(
        F.count("*").alias("total_properties"),
        *[(F.avg(typed(df, c)) if c in df.columns else F.lit(None).cast("double")).alias(k) for k, c in means.items()],
        *[(F.count_distinct(c) if c in df.columns else F.lit(0).cast("bigint")).alias(k) for k, c in kinds.items()])


def column_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AGG-23: min, max, mean and count per column."""
    return _moments(df.select(*[typed(df, c).alias(c) for c in _present(df, cols)]), _present(df, cols)).select(
        "column", "min", "max", "mean", "n")


def uniques(df: DataFrame, col: str) -> DataFrame:
    """AGG-23: sorted distinct non-null values."""
    return df.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col)


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """AGG-24: equal-width bins between minimum and maximum; the last bin is closed; empty bins are kept."""
    v = stored(df.select(typed(df, col).alias("v")).where(F.col("v").isNotNull()))
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    lo, hi = F.col("__row")["lo"], F.col("__row")["hi"]
    at = F.when(hi > lo, F.least(F.floor((F.col("v") - lo) / (hi - lo) * bins), F.lit(bins - 1))).otherwise(0)
    counts = with_row(v, ends).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    grid = ends.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).select(
        "bin", (F.col("lo") + F.col("bin") * width).alias("bin_start"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"))
    return grid.join(counts, "bin", "left").select(
        "bin", "bin_start", "bin_end", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def five_numbers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AGG-24: box-plot data per column."""
    return profile(df, cols).select("column", "min", F.col("q25").alias("q1"), F.col("q50").alias("median"),
                                    F.col("q75").alias("q3"), "max")


def type_overview(df: DataFrame, words: Sequence[str] = tuple(TYPE_KEYWORDS), col: str = "property_type") -> DataFrame:
    """AGG-25: rows per type with the industrial mark and the share of all typed rows."""
    counts = value_counts(df, [col], None).select(F.col("value").alias(col), "n")
    total = counts.agg(F.sum("n").alias("t")).scalar()
    return counts.withColumns({"is_industrial": contains_any(F.col(col), words),
                               "pct": F.col("n") / total * 100})


def type_totals(df: DataFrame, words: Sequence[str] = tuple(TYPE_KEYWORDS), col: str = "property_type") -> DataFrame:
    """AGG-25: one row: number of types, industrial types, industrial rows and their share of all rows."""
    counts = df.groupBy(col).agg(F.count("*").alias("n")).withColumn("ind", contains_any(F.col(col), words))
    ind = F.sum(F.when(F.col("ind"), F.col("n")).otherwise(0))
    return counts.agg(F.count(col).alias("unique_types"), F.count_if("ind").alias("industrial_types"),
                      ind.alias("total_industrial"), (F.try_divide(ind.cast("double"), F.sum("n")) * 100)
                      .alias("industrial_percentage"))


def pass_rate(df: DataFrame, cond: Column) -> DataFrame:
    """AGG-26: rows that meet a condition and their share."""
    ok = F.count_if(F.coalesce(cond, F.lit(False)))
    return df.agg(F.count("*").alias("total"), ok.alias("passed"),
                  (F.try_divide(ok.cast("double"), F.count("*")) * 100).alias("pass_rate"))


def simple_report(df: DataFrame, place: str = "city") -> DataFrame:
    """AGG-27: rows (section, key, n): potential, municipality, size bands and suitable count, in one pass."""
    s = F.coalesce(F.col("derived_sqft"), F.lit(0))
    band = (F.when(s == 0, "Unknown Size").when(s <= 50000, "20-50K SF").when(s <= 100000, "50-100K SF")
            .when(s <= 200000, "100-200K SF").otherwise("200K+ SF"))
    entry = lambda name, c: F.struct(F.lit(name).alias("section"), c.alias("key"))
    pairs = F.array(entry("by_potential", F.col("flex_potential")),
                    entry("by_municipality", F.coalesce(F.col(place), F.lit("Unknown"))),
                    entry("size_distribution", band),
                    entry("multi_tenant_suitable",
                          F.when(F.col("multi_tenant_suitable").contains("SUITABLE"), F.lit("yes"))),
                    entry("total", F.lit("candidates")))
    return (df.select(F.inline(pairs)).where(F.col("key").isNotNull())
            .groupBy("section", "key").agg(F.count("*").alias("n")))


def phase3(df: DataFrame, place: str = "city", score: str = "flex_score") -> DataFrame:
    """AGG-28: candidates per municipality with the mean score; grand totals are the row without a name."""
    named = df.withColumn(place, F.coalesce(F.col(place), F.lit("Unknown")))
    return named.rollup(place).agg(F.count("*").alias("n"), F.avg(score).alias("avg_score"))
