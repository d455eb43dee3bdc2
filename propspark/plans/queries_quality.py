"""Queries for data quality (DQ)."""

from pyspark.sql import functions as F

from propspark.operators import quality as dq
from propspark.plans.props import PROPS_SQL as P, props, table
from propspark.plans.queries_analytics import rounded
from propspark.plans.queries_clean import G, NUMBER, gappy
from propspark.plans.queries_scoring import ids, scored
from propspark.plans.registry import query
from propspark.plans.sqltext import SCORED_SQL as S


def num(e):
    return f"CASE WHEN regexp_matches(trim({e}),{NUMBER}) THEN try_cast(trim({e}) as double) END"


PROFILED = ["zoning", "city", "building_sqft", "lot_size_acres", "price_text"]


def _profile_sql():
    out = []
    for c in PROFILED:
        number = c in ("building_sqft", "lot_size_acres")
        lengths = "NULL,NULL,NULL" if number else f"round(avg(length({c})),6), max(length({c})), min(length({c}))"
        stats = (f"round(avg({c}),4), round(stddev_samp({c}),4), min({c}), max({c}), round(quantile_cont({c},0.25),4), round(median({c}),4), round(quantile_cont({c},0.75),4)"
                 if number else "NULL,NULL,NULL,NULL,NULL,NULL,NULL")
        out.append(f"""SELECT '{c}' AS "column", count(*) AS n_rows, count({c}) AS non_null_count, count(DISTINCT {c}) AS unique_count, {lengths},
 count(*)-count({c}), round((count(*)-count({c}))*100.0/count(*),6), round(count(DISTINCT {c})*100.0/count(*),6), {stats} FROM gappy""")
    head = ("""SELECT * FROM (""" + " UNION ALL ".join(out) + """) t("column",n_rows,non_null_count,unique_count,avg_length,max_length,min_length,null_count,
 null_percentage,unique_percentage,mean,std,min,max,q25,median,q75)""")
    return G + head


@query("dq1_profile", _profile_sql())
def _(spark, d):
    out = dq.profile_columns(gappy(spark, d), PROFILED)
    return rounded(out, 6, mean=4, std=4, min=9, max=9, q25=4, median=4, q75=4)


@query("dq1_top_values", S.split(", scored AS")[0] + " SELECT * FROM (SELECT *, cast(row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) as integer) AS rank FROM ("
       + " UNION ALL ".join(f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS n FROM props WHERE {c} IS NOT NULL GROUP BY 2""" for c in ("zoning", "city", "owner_name"))
       + ")) WHERE rank<=5")
def _(spark, d):
    return dq.top_values(props(spark, d).select("zoning", "city", "owner_name", "building_sqft"))


@query("dq1_profile_documents", """SELECT 'source' AS "column", count(*) AS n_rows, count(DISTINCT source) AS unique_count, round(avg(length(source)),6) AS avg_length FROM documents
UNION ALL SELECT 'text', count(*), count(DISTINCT text), round(avg(length(text)),6) FROM documents""")
def _(spark, d):
    return rounded(dq.profile_columns(table(spark, d, "documents"), ["source", "text"]).select("column", "n_rows", "unique_count", "avg_length"))


DQ2 = ["building_sqft", "property_type", "sale_date", "sold_price", "year_built", "lot_size_acres", "zoning", "county"]
DQ2_SQL = " UNION ALL ".join(f"""SELECT '{c}' AS field, count({c}) AS complete_records, count(*)-count({c}) AS missing_records,
 round(count({c})*100.0/count(*),6) AS completeness FROM gappy""" for c in DQ2)


@query("dq2_completeness", G + DQ2_SQL)
def _(spark, d):
    return rounded(dq.completeness(gappy(spark, d)))


@query("dq2_completeness_summary", G + f""", c AS ({DQ2_SQL}) SELECT round(avg(completeness),5) AS average_completeness, round(min(completeness),5) AS min_completeness,
 max(completeness) AS max_completeness, count(*) AS fields_analyzed, count(*) FILTER (completeness=100) AS complete_fields, count(*) FILTER (completeness<100) AS incomplete_fields FROM c""")
def _(spark, d):
    return rounded(dq.completeness_summary(gappy(spark, d)), 5)


@query("dq3_cell_completeness", G + """, c AS (SELECT count(*) AS n, count(zoning)+count(price_text)+count(building_sqft)+count(city)+count(sale_date) AS k,
 (count(zoning)<count(*))::int+(count(price_text)<count(*))::int+(count(building_sqft)<count(*))::int AS g FROM gappy)
SELECT n AS total_rows, 5::bigint AS total_columns, 1::bigint AS numeric_columns, 3::bigint AS text_columns, 1::bigint AS datetime_columns,
 g::bigint AS columns_with_nulls, n*5-k AS total_missing_values, round(k*100.0/(n*5),6) AS overall_completeness FROM c""")
def _(spark, d):
    return rounded(dq.cell_completeness(gappy(spark, d).select("zoning", "price_text", "building_sqft", "city", "sale_date")))


# One file per supplier, display names, numbers partly as text.
def sheets(spark, d):
    return gappy(spark, d).select(
        F.concat(F.lit("file_"), F.col("owner_name")).alias("source_file"), F.col("property_name").alias("Property Name"), F.col("address").alias("Address"),
        F.col("city").alias("City"), F.col("state").alias("State"), F.col("property_type").alias("Property Type"), F.col("price_text").alias("Building SqFt"),
        F.col("lot_size_acres").alias("Lot Size Acres"), F.col("year_built").alias("Year Built"), F.col("zoning").alias("Zoning"))


SHEETS = G + f""", sheets AS (SELECT 'file_' || owner_name AS f, * FROM gappy),
 st AS (SELECT f, count(*) AS n, (count(*)-count(price_text))*100.0/count(*) AS np, (count(*)-count(lot_size_acres))*100.0/count(*) AS nl,
  (count(*)-count(zoning))*100.0/count(*) AS nz, count(price_text)-count({num('price_text')}) AS bad FROM sheets GROUP BY f),
 val AS (SELECT f AS source_file, true AS is_valid, n AS record_count, '' AS missing_columns, 'Zoning' AS extra_columns, 0::bigint AS error_count,
  cast((bad>0)::int + (np>0)::int + (np>80)::int + (nl>80)::int + (nz>0)::int + (nz>80)::int + 1 as bigint) AS warning_count, 0::bigint AS schema_issue_count,
  (100.0 + greatest(0, 100-(np+nl+nz)/9) + (8-(bad>0)::int)*100.0/8 + CASE WHEN n>=100 THEN 100 WHEN n>=10 THEN 80 ELSE 60 END)/4 AS quality_score FROM st)
"""


@query("dq4_validate", SHEETS + "SELECT * REPLACE (round(quality_score,6) AS quality_score) FROM val")
def _(spark, d):
    return rounded(dq.validate(sheets(spark, d)))


@query("dq4_validation_issues", SHEETS + """, i AS (SELECT f AS source_file, 'Building SqFt' AS "column", 'not_numeric' AS issue, bad*100.0/n AS pct FROM st WHERE bad>0
 UNION ALL SELECT f, 'Building SqFt', 'null_not_allowed', np FROM st WHERE np>0 UNION ALL SELECT f, 'Building SqFt', 'too_many_nulls', np FROM st WHERE np>80
 UNION ALL SELECT f, 'Lot Size Acres', 'too_many_nulls', nl FROM st WHERE nl>80 UNION ALL SELECT f, 'Zoning', 'null_not_allowed', nz FROM st WHERE nz>0
 UNION ALL SELECT f, 'Zoning', 'too_many_nulls', nz FROM st WHERE nz>80) SELECT source_file, "column", issue, round(pct,6) AS pct FROM i""")
def _(spark, d):
    return rounded(dq.validation_issues(sheets(spark, d)))


DQ5 = ["address", "city", "state", "zoning", "building_sqft", "price_text"]


@query("dq5_assess_quality", G + f""", g AS (SELECT count(*) AS n FROM gappy GROUP BY address, city, state HAVING count(*)>1), dup AS (SELECT coalesce(sum(n),0)::bigint AS m FROM g),
 a AS (SELECT count(*) AS t, ({'+'.join(f'count({c})' for c in DQ5)})*100.0/count(*)/6 AS comp, (count({num('price_text')})*100.0/count(price_text)+100.0)/2 AS cons FROM gappy)
SELECT t AS total_records, round(comp,6) AS completeness_score, round(cons,6) AS consistency_score, m AS duplicate_records, t-m AS unique_records,
 round(m*100.0/t,6) AS duplicate_percentage, round((comp+cons+100-least(m*100.0/t,50.0))/3,6) AS overall_quality_score FROM a, dup""")
def _(spark, d):
    return rounded(dq.assess_quality(gappy(spark, d).select(*DQ5), numeric=["building_sqft", "price_text"]))


@query("dq6_consistency", P + """, g AS (SELECT count(*) AS n FROM props GROUP BY address, city, state HAVING count(*)>1),
 r AS (SELECT 'building_sqft_out_of_range' AS rule, count(*) FILTER (building_sqft<1000 OR building_sqft>10000000) AS n FROM props
 UNION ALL SELECT 'lot_size_acres_out_of_range', count(*) FILTER (lot_size_acres<0.1 OR lot_size_acres>1000) FROM props
 UNION ALL SELECT 'year_built_out_of_range', count(*) FILTER (year_built<1800 OR year_built>2003) FROM props
 UNION ALL SELECT 'invalid_state', count(*) FILTER (length(state)<>2) FROM props
 UNION ALL SELECT 'duplicate_records', coalesce(sum(n),0)::bigint FROM g UNION ALL SELECT 'duplicate_keys', count(*) FROM g) SELECT * FROM r WHERE n>0""")
def _(spark, d):
    return dq.consistency(props(spark, d), 2001)


@query("dq7_rollup", SHEETS + """SELECT count(*) AS total_files, count(*) FILTER (is_valid) AS valid_files, count(*) FILTER (NOT is_valid) AS invalid_files,
 round(count(*) FILTER (is_valid)*100.0/count(*),6) AS success_rate, cast(sum(record_count) as bigint) AS total_records, round(avg(quality_score),6) AS average_quality_score,
 round(min(quality_score),6) AS min_quality_score, round(max(quality_score),6) AS max_quality_score, count(*) FILTER (quality_score>=80) AS files_above_80_percent,
 count(*) FILTER (quality_score<50) AS files_below_50_percent, cast(sum(error_count) as bigint) AS total_errors, cast(sum(warning_count) as bigint) AS total_warnings FROM val""")
def _(spark, d):
    return rounded(dq.rollup(dq.validate(sheets(spark, d))))


@query("dq7_common_issues", SHEETS + """, i AS (SELECT 'not_numeric: Building SqFt' AS issue FROM st WHERE bad>0 UNION ALL SELECT 'null_not_allowed: Building SqFt' FROM st WHERE np>0
 UNION ALL SELECT 'too_many_nulls: Lot Size Acres' FROM st WHERE nl>80 UNION ALL SELECT 'null_not_allowed: Zoning' FROM st WHERE nz>0 UNION ALL SELECT 'too_many_nulls: Zoning' FROM st WHERE nz>80)
SELECT issue, count(*) AS n FROM i GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def _(spark, d):
    return dq.common_issues(dq.validation_issues(sheets(spark, d)))


@query("dq8_readiness", G + f""", a AS (SELECT count(*) AS total_properties, (count(*)-count(property_type))*100.0/count(*) AS property_type_null_pct,
 (count(*)-count(price_text))*100.0/count(*) AS building_size_null_pct, (count(price_text)-count({num('price_text')}))*100.0/count(*) AS building_size_failed_pct,
 (count(*)-count(lot_size_acres))*100.0/count(*) AS lot_size_null_pct, 0.0 AS lot_size_failed_pct FROM gappy)
SELECT total_properties, round(property_type_null_pct,6) AS property_type_null_pct, round(building_size_null_pct,6) AS building_size_null_pct,
 round(building_size_failed_pct,6) AS building_size_failed_pct, round(lot_size_null_pct,6) AS lot_size_null_pct, cast(0 as double) AS lot_size_failed_pct,
 cast(10.0 - CASE WHEN building_size_null_pct>50 THEN 2.0 WHEN building_size_null_pct>25 THEN 1.0 WHEN building_size_null_pct>10 THEN 0.5 ELSE 0 END
 - CASE WHEN building_size_failed_pct>10 THEN 1.5 WHEN building_size_failed_pct>5 THEN 1.0 WHEN building_size_failed_pct>1 THEN 0.5 ELSE 0 END
 - CASE WHEN lot_size_null_pct>50 THEN 2.0 WHEN lot_size_null_pct>25 THEN 1.0 WHEN lot_size_null_pct>10 THEN 0.5 ELSE 0 END as double) AS quality_score FROM a""")
def _(spark, d):
    df = gappy(spark, d).select("property_type", F.col("price_text").alias("building_sqft"), "lot_size_acres")
    return rounded(dq.readiness(df))


@query("dq9_quality4", G + """, x AS (SELECT CASE WHEN row_pos%7=0 THEN upper(city) ELSE city END AS city, zoning, building_sqft, improvement_value AS price FROM gappy),
 b AS (SELECT quantile_cont(building_sqft,0.25) AS a1, quantile_cont(building_sqft,0.75) AS a3, quantile_cont(price,0.25) AS p1, quantile_cont(price,0.75) AS p3 FROM x),
 o AS (SELECT count(*) FILTER (building_sqft<a1-1.5*(a3-a1) OR building_sqft>a3+1.5*(a3-a1))*100.0/count(*) AS oa,
  count(*) FILTER (price<p1-1.5*(p3-p1) OR price>p3+1.5*(p3-p1))*100.0/count(*) AS op FROM x, b),
 s AS (SELECT count(*) AS n_rows, (count(city)+count(zoning)+count(building_sqft)+count(price))*1.0/(count(*)*4) AS completeness,
  (SELECT (2 + CASE WHEN oa>5 THEN greatest(0.5,1-oa/100) ELSE 1 END + CASE WHEN op>5 THEN greatest(0.5,1-op/100) ELSE 1 END)/4 FROM o) AS validity, (4-0.3)/4 AS consistency,
  (SELECT count(*) FROM (SELECT DISTINCT * FROM x))*1.0/count(*) AS uniqueness FROM x)
SELECT n_rows, round(completeness,6) AS completeness, round(validity,6) AS validity, round(consistency,6) AS consistency, round(uniqueness,6) AS uniqueness,
 round((completeness+validity+consistency+uniqueness)/4,6) AS quality_score, (completeness+validity+consistency+uniqueness)/4>0.3 AS is_valid FROM s""")
def _(spark, d):
    city = F.when(F.col("row_pos") % 7 == 0, F.upper("city")).otherwise(F.col("city"))
    return rounded(dq.quality4(gappy(spark, d).select(city.alias("city"), "zoning", "building_sqft", F.col("improvement_value").alias("price"))))


def board(spark, d):
    return gappy(spark, d).select(
        F.col("property_type").alias("Property Type"), F.col("city").alias("City"), F.col("state").alias("State"), F.col("building_sqft").alias("Building SqFt"),
        F.col("lot_size_acres").alias("Lot Size Acres"), F.col("year_built").alias("Year Built"), F.col("price_text").alias("Sold Price"))


BOARD_CELLS = "(count(property_type)+count(city)+count(state)+count(building_sqft)+count(lot_size_acres)+count(year_built)+count(price_text))*1.0/(count(*)*7)"
BOARD_DASH = f"""dash AS (SELECT {BOARD_CELLS} AS cells, (count(*) FILTER (year_built BETWEEN 1800 AND 2025)*1.0/count(year_built)
 + count(*) FILTER (building_sqft>0 AND building_sqft<10000000)*1.0/count(building_sqft))/2*15 AS acc FROM gappy),
 parts AS (SELECT cells*40 AS completeness, acc AS accuracy, least(6*40.0/15 + cells*30 + 4*30.0/5, 100.0) AS structure_score, 3*25.0/5 AS consistency, 20.0 AS validity FROM dash)"""


@query("dq10_quality_dashboard", G + ", " + BOARD_DASH + """ SELECT round(completeness,6) AS completeness, round(accuracy,6) AS accuracy,
 round(structure_score+40.0/15,6) AS structure_score, cast(consistency as double) AS consistency, cast(validity as double) AS validity,
 round(completeness+accuracy+consistency+validity,6) AS total_score FROM parts""")
def _(spark, d):
    return rounded(dq.quality_dash(board(spark, d)))


OUT = ["improvement_value", "land_market_value", "sold_price"]


@query("dq11_outliers", P + " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) FILTER ({c}<a-1.5*(b-a) OR {c}>b+1.5*(b-a)) AS n_outliers,
 round(count(*) FILTER ({c}<a-1.5*(b-a) OR {c}>b+1.5*(b-a))*100.0/count(*),6) AS pct FROM props, (SELECT quantile_cont({c},0.25) AS a, quantile_cont({c},0.75) AS b FROM props)""" for c in OUT))
def _(spark, d):
    return rounded(dq.outliers(props(spark, d), OUT))


@query("dq11_outlier_bounds", P + " UNION ALL ".join(f"""SELECT '{c}' AS "column", round(a,4) AS q1, round(b,4) AS q3, round(a-1.5*(b-a),4) AS lower_bound,
 round(b+1.5*(b-a),4) AS upper_bound FROM (SELECT quantile_cont({c},0.25) AS a, quantile_cont({c},0.75) AS b FROM props)""" for c in OUT))
def _(spark, d):
    return rounded(dq.outlier_bounds(props(spark, d), OUT), 4)


RATIO = "improvement_value/land_market_value"


@query("dq11_outlier_rows", P + f""", r AS (SELECT rid, {RATIO} AS v FROM props), b AS (SELECT quantile_cont(v,0.25) AS a, quantile_cont(v,0.75) AS b FROM r)
SELECT rid, round(v,6) AS v FROM r, b WHERE v<a-1.5*(b-a) OR v>b+1.5*(b-a)""")
def _(spark, d):
    df = props(spark, d).select("rid", (F.col("improvement_value") / F.col("land_market_value")).alias("v"))
    return rounded(dq.outlier_rows(df, "v"))


TEXTNUM = f"CASE WHEN trim(regexp_replace(price_text,'[$,%]','','g')) NOT IN ('N/A','n/a','NA','na','','None','none') THEN {num(chr(114) + 'egexp_replace(price_text,' + chr(39) + '[$,%]' + chr(39) + ',' + chr(39) * 2 + ',' + chr(39) + 'g' + chr(39) + ')')} END"
CLEANED = f""", v AS (SELECT price_text, {TEXTNUM} AS p, building_sqft AS s FROM gappy),
 b AS (SELECT quantile_cont(p,0.25) AS p1, quantile_cont(p,0.75) AS p3, quantile_cont(s,0.25) AS s1, quantile_cont(s,0.75) AS s3 FROM v),
 rep AS (SELECT 'Sold Price' AS "column", count(*)-count(price_text) AS nulls_before, count(*)-count(p) AS nulls_after, 0::bigint AS recovered, count(price_text)-count(p) AS lost,
  count(*) FILTER (p<p1-1.5*(p3-p1) OR p>p3+1.5*(p3-p1)) AS n_outliers, true AS type_changed FROM v, b
 UNION ALL SELECT 'Building SqFt', count(*)-count(s), count(*)-count(s), 0, 0, count(*) FILTER (s<s1-1.5*(s3-s1) OR s>s3+1.5*(s3-s1)), false FROM v, b)
"""


@query("dq12_cleaning_report", G + CLEANED + "SELECT * FROM rep")
def _(spark, d):
    return dq.cleaning_report(board(spark, d), ["Sold Price", "Building SqFt"])


@query("dq13_report_quality", S + """SELECT count(*) AS total_records, 0::bigint AS invalid_scores, count(*) FILTER (lot_size_acres-1<0) AS negative_lot_size_acres,
 0::bigint AS negative_improvement_value, 0::bigint AS negative_land_market_value,
 round((5+round_even(count(zoning)*1.0/count(*),3))/6*100 - 5,6) AS overall_quality_score FROM scored""")
def _(spark, d):
    return rounded(dq.report_quality(scored(spark, d).withColumn("lot_size_acres", F.col("lot_size_acres") - 1)))


@query("dq14_issues", G + """, x AS (SELECT city, rid, CASE WHEN row_pos%3=0 THEN zoning END AS zoning, building_sqft FROM gappy)
SELECT 'city' AS "column", 'low_diversity' AS issue, round(count(DISTINCT city)*100.0/count(*),6) AS pct FROM x
UNION ALL SELECT 'zoning','high_missing',round((count(*)-count(zoning))*100.0/count(*),6) FROM x
UNION ALL SELECT 'zoning','low_diversity',round(count(DISTINCT zoning)*100.0/count(*),6) FROM x""")
def _(spark, d):
    x = gappy(spark, d).select("city", "rid", F.when(F.col("row_pos") % 3 == 0, F.col("zoning")).alias("zoning"), "building_sqft")
    return rounded(dq.issues(x))


@query("dq15_plausibility", P + """SELECT count(DISTINCT zoning) AS zoning_codes, round(stddev_samp(sold_price*0.02/market_value),8) AS tax_rate_std,
 round(min(sold_price*0.02/market_value),8) AS min_rate, round(max(sold_price*0.02/market_value),8) AS max_rate, count(DISTINCT zoning)=1 AS single_zoning,
 stddev_samp(sold_price*0.02/market_value)<0.001 AS constant_tax_rate FROM props""")
def _(spark, d):
    df = props(spark, d).withColumn("tax", F.col("sold_price") * 0.02)
    return rounded(dq.plausibility(df, "zoning", "tax", "market_value"), 8)


@query("dq16_fingerprint")
def _(spark, d):
    return dq.fingerprint(props(spark, d))


@query("dq18_quarantine", P + f"""SELECT rid, CASE WHEN ({TEXTNUM}) IS NULL AND price_text IS NOT NULL THEN 'price_text: not a number' END AS scoring_errors FROM props""")
def _(spark, d):
    return ids(dq.quarantine(props(spark, d), ["price_text"]), "scoring_errors")


@query("dq19_processing_report", G + CLEANED + ", " + BOARD_DASH + """, fin AS (SELECT completeness, consistency, validity, accuracy, completeness+accuracy+consistency+validity AS total FROM parts),
 nl AS (SELECT 'Building SqFt' AS key, (count(*)-count(building_sqft)) AS v, count(*) AS n FROM gappy UNION ALL SELECT 'Lot Size Acres', count(*)-count(lot_size_acres), count(*) FROM gappy
  UNION ALL SELECT 'Sold Price', count(*)-count(price_text), count(*) FROM gappy),
 r AS (SELECT 'null_handling' AS section, key, v::double AS value FROM nl WHERE v>0 UNION ALL SELECT 'outliers_detected', "column", n_outliers FROM rep WHERE n_outliers>0
 UNION ALL SELECT 'type_conversions', "column", 1 FROM rep WHERE type_changed UNION ALL SELECT 'quality_breakdown','completeness',completeness FROM fin
 UNION ALL SELECT 'quality_breakdown','consistency',consistency FROM fin UNION ALL SELECT 'quality_breakdown','validity',validity FROM fin
 UNION ALL SELECT 'quality_breakdown','accuracy',accuracy FROM fin UNION ALL SELECT 'quality_breakdown','total_score',total FROM fin
 UNION ALL SELECT 'recommendation','high_missing_data',count(*) FROM nl WHERE v*1.0/n>0.3 HAVING count(*)>0
 UNION ALL SELECT 'recommendation','low_quality_score',total FROM fin WHERE total<70
 UNION ALL SELECT 'recommendation','review_outliers',sum(n_outliers) FROM rep HAVING sum(n_outliers)>0
 UNION ALL SELECT 'recommendation','low_completeness',completeness FROM fin WHERE completeness<30
 UNION ALL SELECT 'recommendation','type_inconsistencies',consistency FROM fin WHERE consistency<15)
SELECT section, key, round(value,6) AS value FROM r""")
def _(spark, d):
    return rounded(dq.processing_report(board(spark, d), ["Sold Price", "Building SqFt"]))
