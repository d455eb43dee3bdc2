"""Queries for aggregations (AGG) and rankings."""

from pyspark.sql import functions as F

from propspark.operators import analytics as agg, scoring as sco
from propspark.plans.props import PROPS_SQL as P, props
from propspark.plans.queries_scoring import SIMPLE_SQL, candidates, weighted
from propspark.plans.registry import query
from propspark.plans.sqltext import CLASS, SCORED_SQL as S, WEIGHTED_SQL as W

NUMPT = "try_cast(CASE WHEN regexp_matches(x,'^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') THEN x END as double)"


def rounded(df, digits=6, **special):
    """Round every double column; ``special`` gives other digits per column."""
    return df.select(*[
        F.round(F.col(c), special.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("agg1_safe_aggregates", P + f"""
, t AS (SELECT CASE WHEN trim(regexp_replace(price_text,'[$,%]','','g')) NOT IN ('N/A','n/a','NA','na','','None','none')
 THEN trim(regexp_replace(price_text,'[$,%]','','g')) END AS x FROM props), v AS (SELECT {NUMPT} AS v FROM t)
SELECT round(avg(v),6) AS mean, round(sum(v),6) AS sum, count(v) AS count, min(v) AS min, max(v) AS max, round(stddev_samp(v),6) AS std,
 median(v) AS median FROM v""")
def _(spark, d):
    return rounded(agg.safe_aggregates(props(spark, d), "price_text"))


@query("agg1_safe_aggregates_number", P + """SELECT round(avg(building_sqft),4) AS mean, round(sum(building_sqft),-2) AS sum,
 count(building_sqft) AS count, min(building_sqft) AS min, max(building_sqft) AS max, round(stddev_samp(building_sqft),4) AS std,
 round(median(building_sqft),4) AS median FROM props""")
def _(spark, d):
    return rounded(agg.safe_aggregates(props(spark, d), "building_sqft"), 4, sum=-2, min=9, max=9)


@query("agg2_overview", S + """SELECT count(*) AS total_properties, count(*) FILTER (flex_score>=5) AS flex_candidates,
 count(*) FILTER (flex_score>=8) AS prime_flex, round(avg(flex_score),6) AS average_flex_score, round(sum(market_value),-3) AS total_market_value,
 round(avg(market_value),2) AS average_market_value, round(sum(lot_size_acres),6) AS total_acres FROM cand""")
def _(spark, d):
    return rounded(agg.summary(candidates(spark, d)), total_market_value=-3, average_market_value=2)


@query("agg3_by_municipality", S + """SELECT city, count(flex_score) AS n, round(avg(flex_score),6) AS avg_score, max(flex_score) AS max_score,
 round(avg(market_value),2) AS avg_value, round(sum(lot_size_acres),6) AS total_acres FROM cand GROUP BY city""")
def _(spark, d):
    return rounded(agg.by_municipality(candidates(spark, d)), avg_value=2)


@query("agg4_by_use", S + """SELECT property_use, count(flex_score) AS n, round(avg(flex_score),6) AS avg_score,
 round(avg(market_value),2) AS avg_value FROM cand GROUP BY property_use""")
def _(spark, d):
    return rounded(agg.by_use(candidates(spark, d)), avg_value=2)


@query("agg5_value_bands", S + """SELECT count(*) FILTER (market_value<500000) AS under_500k,
 count(*) FILTER (market_value>=500000 AND market_value<1000000) AS from_500k_to_1m,
 count(*) FILTER (market_value>=1000000 AND market_value<5000000) AS from_1m_to_5m, count(*) FILTER (market_value>=5000000) AS over_5m,
 count(*) FILTER (market_value>1000000) AS properties_over_1m, round(avg(flex_score) FILTER (market_value>1000000),6) AS avg_score_over_1m FROM cand""")
def _(spark, d):
    return rounded(agg.value_bands(candidates(spark, d)))


@query("agg6_score_stats", S + """SELECT round(avg(flex_score),6) AS mean, min(flex_score) AS min, max(flex_score) AS max,
 round(stddev_samp(flex_score),6) AS std, median(flex_score) AS median, count(*) FILTER (flex_score>=8) AS high,
 count(*) FILTER (flex_score>=6 AND flex_score<8) AS medium, count(*) FILTER (flex_score<6) AS low FROM cand""")
def _(spark, d):
    return rounded(agg.score_stats(candidates(spark, d)))


@query("agg7_size_dist", S + """SELECT count(*) FILTER (building_sqft>=20000 AND building_sqft<50000) AS from_20k_to_50k,
 count(*) FILTER (building_sqft>=50000 AND building_sqft<100000) AS from_50k_to_100k,
 count(*) FILTER (building_sqft>=100000 AND building_sqft<200000) AS from_100k_to_200k, count(*) FILTER (building_sqft>=200000) AS over_200k,
 round(avg(building_sqft),4) AS mean, round(median(building_sqft),4) AS median FROM cand""")
def _(spark, d):
    return rounded(agg.size_dist(candidates(spark, d)), 4)


def _lot_sql(bands):
    return P + "SELECT " + ", ".join(f"count(*) FILTER ({cond}) AS {name}" for name, cond in bands) + " FROM props"


@query("agg8_lot_dist_half_open", _lot_sql([
    ("from_0_5_to_1", "lot_size_acres>=0.5 AND lot_size_acres<1"), ("from_1_to_5", "lot_size_acres>=1 AND lot_size_acres<5"),
    ("from_5_to_10", "lot_size_acres>=5 AND lot_size_acres<10"), ("from_10_to_20", "lot_size_acres>=10 AND lot_size_acres<=20"),
    ("over_20", "lot_size_acres>20")]))
def _(spark, d):
    return agg.lot_dist(props(spark, d), "half_open")


@query("agg8_lot_dist_closed", _lot_sql([
    ("from_0_5_to_1", "lot_size_acres>=0.5 AND lot_size_acres<1"), ("from_1_to_5", "lot_size_acres>=1 AND lot_size_acres<=5"),
    ("from_5_to_10", "lot_size_acres>5 AND lot_size_acres<=10"), ("from_10_to_20", "lot_size_acres>10 AND lot_size_acres<=20"),
    ("over_20", "lot_size_acres>20")]))
def _(spark, d):
    return agg.lot_dist(props(spark, d), "closed_upper")


@query("agg8_lot_dist_report", _lot_sql([
    ("under_1", "lot_size_acres<1"), ("from_1_to_3", "lot_size_acres>=1 AND lot_size_acres<3"),
    ("from_3_to_5", "lot_size_acres>=3 AND lot_size_acres<5"), ("from_5_to_10", "lot_size_acres>=5 AND lot_size_acres<10"),
    ("over_10", "lot_size_acres>=10")]))
def _(spark, d):
    return agg.lot_dist(props(spark, d), "report")


def _hist_sql(bands):
    return S + "SELECT " + ", ".join(f"count(*) FILTER ({cond}) AS {name}" for name, cond in bands) + " FROM scored"


def _bands(variant):
    out, upper = [], None
    for name, low in agg.SCORE_BANDS[variant]:
        cond = "flex_score IS NOT NULL"
        cond += f" AND flex_score>={low}" if low is not None else ""
        cond += f" AND flex_score<{upper}" if upper is not None else ""
        out.append((name, cond))
        upper = low
    return out


@query("agg9_score_hist_five", _hist_sql(_bands("five")))
def _(spark, d):
    return agg.score_hist(sco.flex_score(props(spark, d)), "five")


@query("agg9_score_hist_four", _hist_sql(_bands("four")))
def _(spark, d):
    return agg.score_hist(sco.flex_score(props(spark, d)), "four")


@query("agg9_score_hist_seven", _hist_sql(_bands("seven")))
def _(spark, d):
    return agg.score_hist(sco.flex_score(props(spark, d)), "seven")


@query("agg9_percentiles", S + "SELECT " + ", ".join(
    f"round(quantile_cont(flex_score,{p / 100}),6) AS flex_score_p{p}" for p in (10, 25, 50, 75, 90)) + " FROM scored")
def _(spark, d):
    return rounded(agg.score_percentiles(sco.flex_score(props(spark, d))))


@query("agg10_component_stats", W + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(avg({c}),6) AS mean, round(median({c}),6) AS median, round(stddev_samp({c}),6) AS std FROM weighted"""
    for c in sco.COMPONENTS))
def _(spark, d):
    return rounded(agg.component_stats(weighted(spark, d)))


def _vc_sql(prefix, source, cols, n):
    parts = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}""" for c in cols)
    return prefix + f"""SELECT * FROM (SELECT *, cast(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) as integer) AS rank
 FROM ({parts})) WHERE rank<={n}"""


@query("agg11_value_counts", _vc_sql(S, "cand", ["property_type", "city", "county", "state", "zoning"], 10))
def _(spark, d):
    return agg.value_counts(candidates(spark, d), ["property_type", "city", "county", "state", "zoning"], 10)


@query("agg11_document_counts", _vc_sql("", "documents", ["source", "lang"], 20))
def _(spark, d):
    from propspark.plans.props import table

    return agg.value_counts(table(spark, d, "documents"), ["source", "lang"], 20)


@query("agg12_hhi", S + """, c AS (SELECT state, count(*) AS n FROM cand GROUP BY 1)
SELECT round(sum((n*1.0/(SELECT sum(n) FROM c))*(n*1.0/(SELECT sum(n) FROM c))),6) AS geographic_concentration, count(*) AS n_values FROM c""")
def _(spark, d):
    return rounded(agg.hhi(candidates(spark, d)))


@query("agg12_top_markets", _vc_sql(S, "cand", ["state"], 10))
def _(spark, d):
    return agg.value_counts(candidates(spark, d), ["state"], 10)


@query("agg13_correlations", S + """SELECT round(corr(building_sqft,flex_score),6) AS building_size_vs_score,
 round(corr(lot_size_acres,flex_score),6) AS lot_size_vs_score, round(corr(building_sqft,lot_size_acres),6) AS building_vs_lot_size FROM cand""")
def _(spark, d):
    return rounded(agg.corrs(candidates(spark, d)))


@query("agg14_optimal_range", S + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(quantile_cont({c},0.25),4) AS q25, round(quantile_cont({c},0.75),4) AS q75 FROM cand WHERE flex_score>=7"""
    for c in ("building_sqft", "lot_size_acres")))
def _(spark, d):
    return rounded(agg.optimal_range(candidates(spark, d)), 4)


PROFILE = ["building_sqft", "lot_size_acres", "flex_score", "land_market_value", "improvement_value"]


@query("agg15_profile", S + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}),2) AS mean, round(stddev_samp({c}),2) AS std, round(min({c}),4) AS min,
 round(max({c}),4) AS max, round(quantile_cont({c},0.25),4) AS q25, round(median({c}),4) AS q50, round(quantile_cont({c},0.75),4) AS q75 FROM cand"""
    for c in PROFILE))
def _(spark, d):
    return rounded(agg.profile(candidates(spark, d), PROFILE), 4, mean=2, std=2)


@query("agg16_keyword_stats", S + " UNION ALL ".join(
    f"""SELECT '{w}' AS keyword, count(*) AS n, round(avg(flex_score),6) AS avg_score FROM scored WHERE lower(property_type) LIKE '%{w}%' HAVING count(*)>0"""
    for w in agg.TYPE_KEYWORDS))
def _(spark, d):
    return rounded(agg.keyword_stats(sco.flex_score(props(spark, d))))


@query("agg17_year_stats", P + """SELECT round(avg(year_built),6) AS mean_year, median(year_built) AS median_year,
 cast(min(year_built) as bigint) AS oldest, cast(max(year_built) as bigint) AS newest FROM props""")
def _(spark, d):
    return rounded(agg.year_stats(props(spark, d)))


@query("agg17_temporal_counts", P + """SELECT 'decade' AS section, cast(year_built//10*10 as varchar) || 's' AS key, count(*) AS n FROM props GROUP BY 2
UNION ALL SELECT 'sale_year', cast(year(sale_date) as varchar), count(*) FROM props GROUP BY 2""")
def _(spark, d):
    return agg.temporal_counts(props(spark, d))


@query("agg17_sale_span", P + "SELECT cast(min(sale_date) as varchar) AS earliest_sale, cast(max(sale_date) as varchar) AS latest_sale FROM props")
def _(spark, d):
    df = agg.sale_span(props(spark, d))
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


@query("agg18_insights", S + """, t AS (SELECT state, count(*) AS n FROM scored WHERE flex_score>=7 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)
SELECT count(*) AS total_market_size, count(*) FILTER (flex_score>=7) AS high_scoring,
 round(count(*) FILTER (flex_score>=7)*100.0/count(*),6) AS high_scoring_pct,
 count(*) FILTER (building_sqft BETWEEN 20000 AND 50000) AS optimal_size, round(count(*) FILTER (flex_score>0)*100.0/count(*),6) AS flex_candidate_rate,
 round(count(*) FILTER (flex_score>=7)*100.0/count(*),6) AS high_quality_rate,
 (SELECT string_agg(state, ', ' ORDER BY n DESC, state) FROM t) AS top_states FROM scored""")
def _(spark, d):
    return rounded(agg.insights(sco.flex_score(props(spark, d))))


@query("agg19_coverage", S + " UNION ALL ".join(
    f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS n, round(avg(flex_score),6) AS mean, max(flex_score) AS max FROM cand WHERE {c} IS NOT NULL GROUP BY {c}"
    for c in ("state", "city", "county", "zoning")))
def _(spark, d):
    return rounded(agg.coverage(candidates(spark, d)))


@query("agg19_best_cities", S + """SELECT 'city' AS dimension, city AS value, count(*) AS n, round(avg(flex_score),6) AS mean, max(flex_score) AS max
 FROM cand GROUP BY city ORDER BY avg(flex_score) DESC, city LIMIT 10""")
def _(spark, d):
    return rounded(agg.best_cities(candidates(spark, d)))


@query("agg20_value_chars", S + """, r AS (SELECT *, CASE WHEN land_market_value>0 THEN improvement_value/land_market_value END AS ratio FROM cand)
SELECT count(*) FILTER (improvement_value<250000) AS under_250k, count(*) FILTER (improvement_value>=250000 AND improvement_value<500000) AS from_250k_to_500k,
 count(*) FILTER (improvement_value>=500000 AND improvement_value<1000000) AS from_500k_to_1m,
 count(*) FILTER (improvement_value>=1000000 AND improvement_value<2000000) AS from_1m_to_2m, count(*) FILTER (improvement_value>=2000000) AS over_2m,
 round(avg(ratio),6) AS avg_improvement_to_land, round(median(ratio),6) AS median_improvement_to_land FROM r""")
def _(spark, d):
    return rounded(agg.value_chars(candidates(spark, d)))


@query("agg21_exec_summary", S + """, f AS (SELECT source_file, count(*) AS n FROM props GROUP BY 1)
SELECT count(*) AS unique_flex_properties, round(avg(flex_score),6) AS average_flex_score, max(flex_score) AS highest_flex_score,
 min(flex_score) AS lowest_flex_score, count(*) FILTER (flex_score BETWEEN 8 AND 10) AS prime_flex_count,
 count(*) FILTER (flex_score>=6 AND flex_score<8) AS good_flex_count, count(*) FILTER (flex_score>=4 AND flex_score<6) AS potential_flex_count,
 count(*) FILTER (flex_score<4) AS unlikely_flex_count, round(avg(lot_size_acres),6) AS average_lot_size,
 round(avg(improvement_value),2) AS average_improvement_value, count(DISTINCT state) AS unique_states, count(DISTINCT city) AS unique_cities,
 count(DISTINCT county) AS unique_counties, median(flex_score) AS median_flex_score, (SELECT count(*) FROM f) AS total_files_processed,
 (SELECT count(*) FROM f) AS successful_files, cast((SELECT sum(n) FROM f) as bigint) AS total_properties_analyzed,
 round(((SELECT sum(n) FROM f)-count(*))*100.0/(SELECT sum(n) FROM f),6) AS deduplication_rate FROM cand""")
def _(spark, d):
    runs = props(spark, d).groupBy("source_file").agg(F.count("*").alias("property_count")).withColumn("success", F.lit(True))
    return rounded(agg.exec_summary(candidates(spark, d), runs), average_improvement_value=2)


@query("agg22_metrics", P + """SELECT count(*) AS total_properties, round(avg(sold_price),2) AS avg_price, round(avg(building_sqft),4) AS avg_size,
 round(avg(lot_size_acres),6) AS avg_lot_size, round(avg(occupancy),6) AS avg_occupancy, count(DISTINCT city) AS unique_cities,
 count(DISTINCT county) AS unique_counties, count(DISTINCT state) AS unique_states FROM props""")
def _(spark, d):
    return rounded(agg.metrics(props(spark, d)), avg_price=2, avg_size=4)


@query("agg23_column_stats", P + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", cast(min({c}) as double) AS min, cast(max({c}) as double) AS max, round(avg({c}),2) AS mean, count({c}) AS n FROM props"""
    for c in ("building_sqft", "sold_price", "year_built")))
def _(spark, d):
    return rounded(agg.column_stats(props(spark, d), ["building_sqft", "sold_price", "year_built"]), 9, mean=2)


@query("agg23_unique_values", P + "SELECT DISTINCT city FROM props")
def _(spark, d):
    return agg.uniques(props(spark, d), "city")


def _histogram_sql(col, bins):
    return P + f""", e AS (SELECT min({col}) AS lo, max({col}) AS hi FROM props),
 c AS (SELECT cast(least(floor(({col}-lo)/(hi-lo)*{bins}),{bins - 1}) as int) AS bin, count(*) AS n FROM props, e GROUP BY 1)
SELECT g.bin, round(lo+g.bin*((hi-lo)/{bins}),4) AS bin_start, round(lo+(g.bin+1)*((hi-lo)/{bins}),4) AS bin_end, coalesce(n,0) AS n
 FROM e, (SELECT cast(unnest(range({bins})) as int) AS bin) g LEFT JOIN c ON c.bin=g.bin"""


@query("agg24_histogram_30", _histogram_sql("building_sqft", 30))
def _(spark, d):
    return rounded(agg.histogram(props(spark, d), "building_sqft", 30), 4)


@query("agg24_histogram_20", _histogram_sql("lot_size_acres", 20))
def _(spark, d):
    return rounded(agg.histogram(props(spark, d), "lot_size_acres", 20), 4)


@query("agg24_five_numbers", P + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(min({c}),4) AS min, round(quantile_cont({c},0.25),4) AS q1, round(median({c}),4) AS median,
 round(quantile_cont({c},0.75),4) AS q3, round(max({c}),4) AS max FROM props""" for c in ("sold_price", "lot_size_acres")))
def _(spark, d):
    return rounded(agg.five_numbers(props(spark, d), ["sold_price", "lot_size_acres"]), 4)


IND7 = "regexp_matches(lower(property_type),'industrial|warehouse|distribution|flex|manufacturing|storage|logistics')"


@query("agg25_type_overview", P + f"""SELECT property_type, count(*) AS n, {IND7} AS is_industrial,
 round(count(*)*100.0/(SELECT count(*) FROM props),6) AS pct FROM props GROUP BY property_type""")
def _(spark, d):
    return rounded(agg.type_overview(props(spark, d)))


@query("agg25_type_totals", P + f"""SELECT count(DISTINCT property_type) AS unique_types,
 count(DISTINCT CASE WHEN {IND7} THEN property_type END) AS industrial_types, count(*) FILTER ({IND7}) AS total_industrial,
 round(count(*) FILTER ({IND7})*100.0/count(*),6) AS industrial_percentage FROM props""")
def _(spark, d):
    return rounded(agg.type_totals(props(spark, d)))


@query("agg26_pass_rate", P + """SELECT count(*) AS total, count(*) FILTER (zoning IN ('IL','IG')) AS passed,
 round(count(*) FILTER (zoning IN ('IL','IG'))*100.0/count(*),6) AS pass_rate FROM props""")
def _(spark, d):
    return rounded(agg.pass_rate(props(spark, d), F.col("zoning").isin("IL", "IG")))


@query("agg27_simple_report", SIMPLE_SQL + """SELECT 'by_potential' AS section, flex_potential AS key, count(*) AS n FROM identified GROUP BY 2
UNION ALL SELECT 'by_municipality', city, count(*) FROM identified GROUP BY 2
UNION ALL SELECT 'size_distribution', CASE WHEN derived_sqft=0 THEN 'Unknown Size' WHEN derived_sqft<=50000 THEN '20-50K SF'
 WHEN derived_sqft<=100000 THEN '50-100K SF' WHEN derived_sqft<=200000 THEN '100-200K SF' ELSE '200K+ SF' END, count(*) FROM identified GROUP BY 2
UNION ALL SELECT 'multi_tenant_suitable','yes',count(*) FROM identified WHERE multi_tenant_suitable LIKE '%SUITABLE%'
UNION ALL SELECT 'total','candidates',count(*) FROM identified""")
def _(spark, d):
    return agg.simple_report(sco.identify(props(spark, d)))


@query("agg28_phase3", W + """SELECT city, count(*) AS n, round(avg(flex_score),6) AS avg_score FROM weighted WHERE flex_score>=5 GROUP BY city
UNION ALL SELECT NULL, count(*), round(avg(flex_score),6) FROM weighted WHERE flex_score>=5""")
def _(spark, d):
    return rounded(agg.phase3(weighted(spark, d).where("flex_score >= 5")))


@query("win8_ranked", W + f"""SELECT cast(row_number() OVER (ORDER BY flex_score DESC, parcel_id, rid) as integer) AS rank, rid, flex_score,
 {CLASS} AS flex_classification, city, zoning FROM weighted ORDER BY flex_score DESC, parcel_id, rid LIMIT 10""")
def _(spark, d):
    return agg.ranked(weighted(spark, d), 10).select(
        "rank", "rid", "flex_score", sco.classify_score(F.col("flex_score")).alias("flex_classification"), "city", "zoning")
