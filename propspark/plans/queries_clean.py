"""Queries for cleaning (CLN), naming (COL), de-duplication (WIN) and unions (SET)."""

from pyspark.sql import Window, functions as F

from propspark.functions import text
from propspark.functions.ffill import forward_fill
from propspark.operators import clean, dedupe, filters as flt, schema, scoring as sco
from propspark.plans.props import PROPS_SQL as P, TODAY, props, table
from propspark.plans.queries_analytics import rounded
from propspark.plans.queries_scoring import candidates, ids, scored
from propspark.plans.registry import query
from propspark.plans.sqltext import CANDIDATE, SCORED_SQL as S, WEIGHTED_SQL as W

NUMBER = "'^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$'"


def num(e):
    return f"CASE WHEN regexp_matches({e},{NUMBER}) THEN try_cast({e} as double) END"


STRIPPED = "trim(regexp_replace(price_text,'[$,%]','','g'))"
ZERO_TEXT = "trim(regexp_replace(regexp_replace(coalesce(price_text,''),'[%$£€¥,]','','g'),'\\(([0-9.]+)\\)','-\\1','g'))"
ZERO = f"CASE WHEN lower({ZERO_TEXT}) IN ('none','null','n/a','na','-','') THEN 0.0 ELSE {num(ZERO_TEXT)} END"


@query("cln1_clean_numeric", P + f"SELECT rid, CASE WHEN {STRIPPED} NOT IN ('N/A','n/a','NA','na','','None','none') THEN {num(STRIPPED)} END AS price FROM props")
def _(spark, d):
    return ids(props(spark, d), text.clean_numeric(F.col("price_text")).alias("price"))


@query("cln2_clean_numeric_zero", P + f"SELECT rid, {ZERO} AS price FROM props")
def _(spark, d):
    return ids(props(spark, d), text.clean_numeric_zero(F.col("price_text")).alias("price"))


SHAPES = "|".join(text.NUMERIC_SHAPES + [text.PLAIN_NUMBER])


@query("cln3_detect_numeric", P + ", v AS (" + " UNION ALL ".join(
    f"""SELECT DISTINCT '{c}' AS "column", {c} AS value FROM props WHERE {c} IS NOT NULL""" for c in ("price_text", "zoning", "state", "year_text"))
    .replace("year_text AS value", "cast(year_built as varchar) AS value").replace("WHERE year_text", "WHERE year_built") + f"""),
 t AS (SELECT "column", trim(value) NOT IN ('nan','null','none','') AND regexp_matches(trim(value),'{SHAPES}') AS number,
  {num("regexp_replace(trim(value),'[$,%]','','g')")} AS x FROM v),
 g AS (SELECT "column", count(*) AS total_count, count(*) FILTER (number) AS numeric_count, coalesce(bool_or(x<>floor(x)),false) AS fraction FROM t GROUP BY 1)
SELECT "column", total_count, numeric_count, round(numeric_count*1.0/total_count,6) AS confidence, numeric_count*1.0/total_count>=0.8 AS conversion_feasible,
 CASE WHEN numeric_count*1.0/total_count>=0.8 THEN CASE WHEN fraction THEN 'float64' ELSE 'int64' END END AS target_type FROM g""")
def _(spark, d):
    df = props(spark, d).withColumn("year_text", F.col("year_built").cast("string"))
    return rounded(clean.detect_numeric(df, ["price_text", "zoning", "state", "year_text"]))


@query("cln4_assess", P + f"""SELECT 'price_text' AS "column", round(count({num('trim(price_text)')})*1.0/count(price_text),6) AS confidence,
 count({num('trim(price_text)')})*1.0/count(price_text)>=0.8 AS feasible,
 cast(floor((count(price_text)-count({num('trim(price_text)')}))*1.0/count(price_text)*count(*)) as bigint) AS estimated_null_count FROM props""")
def _(spark, d):
    return rounded(clean.assess(props(spark, d), ["price_text"]))


@query("cln5_conversion_report", P + f"""SELECT 'price_text' AS "column", count(*) AS n_rows, count(*) FILTER (price_text IS NULL) AS initial_null_count,
 count(*) FILTER (({ZERO}) IS NULL) AS final_null_count, count(*) FILTER (({ZERO}) IS NOT NULL AND price_text IS NOT NULL) AS values_converted,
 count(*) FILTER (({ZERO}) IS NULL AND price_text IS NOT NULL) AS values_failed,
 round(count(*) FILTER (({ZERO}) IS NOT NULL AND price_text IS NOT NULL)*100.0/count(*),6) AS success_rate FROM props
UNION ALL SELECT 'zoning', count(*), count(*) FILTER (zoning IS NULL), count(*) FILTER (zoning IS NOT NULL), 0, count(zoning), 0.0 FROM props""")
def _(spark, d):
    return rounded(clean.conversion_report(props(spark, d), ["price_text", "zoning"]))


@query("cln5_convert", P + f"SELECT rid, {ZERO} AS price_text FROM props")
def _(spark, d):
    return ids(clean.convert(props(spark, d), ["price_text"]), "price_text")


@query("cln6_to_numeric", P + f"SELECT rid, {num('trim(price_text)')} AS price_text FROM props")
def _(spark, d):
    return ids(clean.to_numeric(props(spark, d), ["price_text"]), "price_text")


def gappy(spark, d):
    """Props with gaps: few in building_sqft and zoning, many in lot_size_acres and price_text."""
    return props(spark, d).withColumns({
        "building_sqft": F.when(F.col("occupancy") > 82, F.col("building_sqft")),
        "lot_size_acres": F.when(F.col("occupancy") > 92, F.col("lot_size_acres"))})


G = P + """, gappy AS (SELECT * REPLACE (CASE WHEN occupancy>82 THEN building_sqft END AS building_sqft,
 CASE WHEN occupancy>92 THEN lot_size_acres END AS lot_size_acres) FROM props)
"""


@query("cln7_fill_zero", G + "SELECT rid, coalesce(building_sqft,0) AS building_sqft, coalesce(lot_size_acres,0) AS lot_size_acres FROM gappy")
def _(spark, d):
    return ids(clean.handle_missing(gappy(spark, d), "fill_zero", ["building_sqft", "lot_size_acres"]), "building_sqft", "lot_size_acres")


@query("cln7_fill_median", G + """SELECT rid, round(coalesce(building_sqft,(SELECT median(building_sqft) FROM gappy)),4) AS building_sqft,
 coalesce(lot_size_acres,(SELECT median(lot_size_acres) FROM gappy)) AS lot_size_acres FROM gappy""")
def _(spark, d):
    out = clean.handle_missing(gappy(spark, d), "fill_median", ["building_sqft", "lot_size_acres"])
    return rounded(ids(out, "building_sqft", "lot_size_acres"), 4)


IMPUTED = """SELECT rid, round(coalesce(building_sqft,(SELECT median(building_sqft) FROM gappy)),4) AS building_sqft,
 coalesce(last_value(lot_size_acres IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY row_pos, rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),0.0) AS lot_size_acres,
 coalesce(zoning,(SELECT zoning FROM gappy WHERE zoning IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS zoning,
 coalesce(price_text, 'x') AS price_text FROM gappy"""


@query("cln8_impute", G + IMPUTED.replace("coalesce(price_text, 'x')", """CASE WHEN (SELECT count(*)-count(price_text) FROM gappy)*1.0/(SELECT count(*) FROM gappy)<0.2
 THEN coalesce(price_text,(SELECT price_text FROM gappy WHERE price_text IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) ELSE coalesce(price_text,'Unknown') END"""))
def _(spark, d):
    cols = ["building_sqft", "lot_size_acres", "zoning", "price_text"]
    out = clean.impute(gappy(spark, d), "row_pos", ["source_file"], ["rid"], cols=cols, block_rows=5000)
    return rounded(ids(out, *cols), 4)


@query("win9_forward_fill", G + """SELECT rid, last_value(lot_size_acres IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY row_pos, rid
 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lot_size_acres FROM gappy""")
def _(spark, d):
    out = forward_fill(gappy(spark, d), ["lot_size_acres"], "row_pos", ["source_file"], ["rid"], block_rows=20000)
    return ids(out, "lot_size_acres")


@query("cln9_winsorize", P + ", st AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in ("building_sqft", "improvement_value")) + " FROM props) SELECT rid, " + ", ".join(
    f"round(CASE WHEN abs({c}-m_{c})>1.5*s_{c} THEN greatest(least({c},m_{c}+1.5*s_{c}),m_{c}-1.5*s_{c}) ELSE {c} END,2) AS {c}"
    for c in ("building_sqft", "improvement_value")) + " FROM props, st")
def _(spark, d):
    cols = ["building_sqft", "improvement_value"]
    return rounded(ids(clean.winsorize(props(spark, d), cols, 1.5), *cols), 2)


@query("cln10_clean_text", P + """SELECT rid, CASE WHEN trim(price_text) NOT IN ('nan','NaN','null','NULL','') THEN trim(price_text) END AS price_text,
 list_aggregate(list_transform(string_split(city,' '), lambda w: upper(w[1:1]) || lower(w[2:])),'string_agg',' ') AS city, trim(zoning) AS zoning FROM props""")
def _(spark, d):
    cols = ["price_text", "city", "zoning"]
    return ids(clean.clean_text_columns(props(spark, d), cols), *cols)


@query("cln11_normalize_types", P + """SELECT rid, CASE WHEN regexp_matches(lower(property_type),'mixed|multi-use') THEN 'mixed_use'
 WHEN regexp_matches(lower(property_type),'retail|store|shop') THEN 'retail' WHEN lower(property_type) LIKE '%off%' THEN 'office'
 WHEN lower(property_type) LIKE '%flex%' THEN 'flex' WHEN regexp_matches(lower(property_type),'warehouse|wh|storage|distribution') THEN 'warehouse'
 WHEN regexp_matches(lower(property_type),'ind|manufacturing|mfg') THEN 'industrial' ELSE property_type END AS property_type FROM props""")
def _(spark, d):
    return ids(clean.normalize_types(props(spark, d)), "property_type")


@query("cln12_drop_empty_rows", P + """SELECT zoning, price_text, count(*) AS n FROM (SELECT zoning, nullif(price_text,'') AS price_text FROM props)
 WHERE zoning IS NOT NULL OR price_text IS NOT NULL GROUP BY 1,2""")
def _(spark, d):
    df = props(spark, d).select("zoning", F.nullif("price_text", F.lit("")).alias("price_text"))
    return clean.drop_empty_rows(df).groupBy("zoning", "price_text").agg(F.count("*").alias("n"))


@query("cln13_add_fields", P + """SELECT rid, CASE WHEN building_sqft>0 AND sold_price>0 THEN round(sold_price/building_sqft,6) END AS price_per_sqft,
 2001-year_built AS building_age, CASE WHEN lot_size_acres>0 THEN round(building_sqft/(lot_size_acres*43560),6) END AS building_efficiency,
 round(building_sqft/(100000.0+year_built),6) AS lot_efficiency FROM props""")
def _(spark, d):
    df = props(spark, d).withColumn("lot_size_sqft", F.lit(100000.0) + F.col("year_built"))
    return rounded(ids(clean.add_fields(df, 2001), "price_per_sqft", "building_age", "building_efficiency", "lot_efficiency"))


@query("cln14_range_check", P + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS n, count(*) FILTER ({c}<{lo} OR {c}>{hi}) AS out_of_range FROM props"""
    for c, (lo, hi) in clean.SANE_RANGES.items()))
def _(spark, d):
    return clean.range_check(props(spark, d))


def raw_sheet(spark, d):
    """Props under the header spellings of a raw sheet, numbers as text."""
    return props(spark, d).select(
        "rid", F.col("parcel_id").alias("Parcel ID"), F.col("property_name").alias("Property Name"),
        F.col("property_type").alias("Property Type"),
        F.col("building_sqft").cast("decimal(18,2)").cast("string").alias("Building SqFt"),
        F.when(F.col("lot_size_acres") > 1, F.col("lot_size_acres").cast("decimal(10,1)").cast("string")).otherwise("n/a").alias("Lot Size Acres"),
        F.col("year_built").alias("Year Built"), F.col("address").alias("Address"), F.col("city").alias("City"),
        F.col("state").alias("State"), F.col("county").alias("County"), F.col("owner_name").alias("Owner Name"),
        F.col("zoning").alias("Zoning Code"), F.col("sale_date").cast("date").cast("string").alias("Sale Date"),
        F.concat(F.lit("$"), F.col("sold_price").cast("decimal(18,2)").cast("string")).alias("Sold Price"),
        F.col("occupancy").alias("Occupancy"))


@query("cln15_preprocess", P + """SELECT rid, CASE WHEN lower(property_type) LIKE '%off%' THEN 'office' WHEN lower(property_type) LIKE '%flex%' THEN 'flex'
 WHEN regexp_matches(lower(property_type),'warehouse|distribution') THEN 'warehouse' ELSE 'industrial' END AS property_type,
 round(building_sqft,2) AS building_sqft, CASE WHEN lot_size_acres>1 THEN lot_size_acres END AS lot_size_acres, cast(year_built as double) AS year_built,
 city, occupancy FROM props""")
def _(spark, d):
    out = clean.preprocess(raw_sheet(spark, d))
    return rounded(ids(out, "property_type", "building_sqft", "lot_size_acres", "year_built", "city", "occupancy"), 2)


@query("cln16_clean_and_transform", P + """, st AS (SELECT avg(occupancy) AS m, stddev_samp(occupancy) AS s, avg(year_built) AS my, stddev_samp(year_built) AS sy FROM props)
SELECT DISTINCT rid, coalesce(zoning,(SELECT zoning FROM props WHERE zoning IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC,1 LIMIT 1)) AS zoning_code,
 round(CASE WHEN abs(occupancy-m)>3*s THEN greatest(least(occupancy,m+3*s),m-3*s) ELSE occupancy END,6) AS occupancy,
 cast(2001-year_built as double) AS building_age FROM props, st""")
def _(spark, d):
    # Every row of the sheet with the place of every row of its id. One window over the table instead of a join of the table with
    # itself, which computed and moved it twice; a repeated id makes as many rows as its list is long, times its rows.
    place = F.struct(F.col("row_pos").alias("Row Pos"), F.col("source_file").alias("Source File"))
    places = F.collect_list(place).over(Window.partitionBy("rid"))
    sheet = props(spark, d).where("rid IS NOT NULL").select(
        "rid", F.col("zoning").alias("Zoning Code"), F.col("occupancy").alias("Occupancy"), F.col("year_built").alias("Year Built"),
        places.alias("places"))
    df = sheet.select("rid", F.col("rid").alias("Row Tie"), "Zoning Code", "Occupancy", "Year Built", F.inline("places"))
    out = clean.clean_and_transform(df, 2001, "row_pos", ["source_file"], ["rid"])
    return rounded(ids(out, "zoning_code", "occupancy", "building_age"))


NORM = "regexp_replace(trim(lower(coalesce({c},''))),'\\s+',' ','g')"


def normalized_address_sql(e):
    for word, short in text.ADDRESS_ABBREVIATIONS.items():
        e = f"regexp_replace({e},'(?i)\\b{word}\\b','{short}','g')"
    return f"regexp_replace({e},'[.,#]','','g')"


KEY = "({} || '|' || {} || '|' || {})".format(
    normalized_address_sql(NORM.format(c="address")), NORM.format(c="city"), NORM.format(c="state"))


@query("cln17_normalize_address", P + f"SELECT rid, {normalized_address_sql('address')} AS address FROM props")
def _(spark, d):
    return ids(props(spark, d), text.normalize_address(F.col("address")).alias("address"))


DASHES = "parcel_id[1:2] || '-' || parcel_id[3:4] || '-' || parcel_id[5:6] || '-' || parcel_id[7:8] || '-' || parcel_id[9:10] || '-' || parcel_id[11:13] || '-' || parcel_id[14:]"


@query("cln18_parcel_key", P + f"""SELECT rid, {DASHES} AS dashed, lpad(regexp_replace({DASHES},'[^0-9A-Za-z]','','g'),17,'0') AS key,
 lpad(ltrim(parcel_id,'0'),17,'0') AS short_key FROM props""")
def _(spark, d):
    dashed = text.dashed_parcel(F.col("parcel_id"))
    short = F.regexp_replace("parcel_id", "^0+", "")
    return ids(props(spark, d), dashed.alias("dashed"), text.parcel_key(dashed).alias("key"), text.parcel_key(short).alias("short_key"))


@query("cln19_sale_timestamp", P + "SELECT rid, cast(sale_date as varchar) AS from_text, cast(sale_date as varchar) AS from_millis FROM props")
def _(spark, d):
    ts = F.col("sale_date").cast("timestamp")
    iso, millis = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), (F.unix_timestamp(ts) * 1000).cast("string")
    return ids(props(spark, d), text.sale_timestamp(iso).cast("string").alias("from_text"),
               text.sale_timestamp(millis).cast("string").alias("from_millis"))


# --- naming --------------------------------------------------------------------------------------------------------

@query("col2_normalize_columns", P + """SELECT rid, parcel_id, address AS site_address, city, state, '' AS zip_code, lot_size_acres AS acres, zoning,
 improvement_value, 0.0::double AS land_market_value, market_value AS total_market_value FROM props""")
def _(spark, d):
    raw = props(spark, d).select("rid", F.col("parcel_id").alias(" Parcel ID "), F.col("address").alias("ADDRESS"), F.col("city").alias("Municipality"),
                                 F.col("state").alias("ST"), F.col("lot_size_acres").alias("Lot Size Acres"), F.col("zoning").alias("Zoning Code"),
                                 F.col("improvement_value").alias("Improvements"), F.col("market_value").alias("Market_Value"))
    return schema.normalize_columns(raw)


@query("col3_standardize_columns", P + """SELECT rid, property_type, building_sqft, city, owner_name AS property_name FROM props""")
def _(spark, d):
    raw = props(spark, d).select("rid", F.col("property_type").alias("Main Property Type"), F.col("building_sqft").alias("Total Building SqFt"),
                                 F.col("city").alias("City Name"), F.col("owner_name").alias("The Owner Name"))
    out = schema.standardize_columns(raw.withColumnRenamed("City Name", "Municipality"))
    return out.select("rid", "property_type", "building_sqft", "city", "property_name")


DISPLAY = {"address": "Address", "city": "City", "state": "State", "building_sqft": "Building SqFt", "lot_size_acres": "Lot Size Acres",
           "property_type": "Property Type", "flex_score": "Flex Score"}


@query("col4_legacy_classic", S + """SELECT address AS site_address, city AS property_city, state AS property_state, building_sqft AS building_size,
 lot_size_acres AS lot_acres, property_type, flex_score FROM cand""")
def _(spark, d):
    return schema.to_legacy(candidates(spark, d).withColumnsRenamed(DISPLAY), "classic")


@query("col4_legacy_enhanced", S + """SELECT rid, flex_score AS "Flex Score", '2001-12-31' AS processing_date, 'scalable_v1.0' AS pipeline_version, 'high' AS data_quality_score FROM cand""")
def _(spark, d):
    return schema.to_legacy(candidates(spark, d).select("rid", F.col("flex_score").alias("Flex Score")), "enhanced", TODAY)


@query("col4_legacy_minimal", S + """SELECT address AS "Address", city AS "City", state AS "State", flex_score AS "Flex Score" FROM cand""")
def _(spark, d):
    return schema.to_legacy(candidates(spark, d).withColumnsRenamed(DISPLAY), "minimal")


@query("col4_from_legacy", S + """SELECT address AS "Address", building_sqft AS "Building SqFt", flex_score AS "Flex Score" FROM cand""")
def _(spark, d):
    df = candidates(spark, d).select(F.col("address").alias("site_address"), F.col("building_sqft").alias("building_size"), F.col("flex_score").alias("score"))
    return schema.from_legacy(df)


NAMES = ["Property Type", "prop_type", "Adress", "City", "citty", "STATE", "Building SqFt", "bldg_sqft!", "Lot Acres", "Year-Built",
         "year_built", "sale_price", "12345", "Occupancy Rate", "County", "Owner Name", "zone", "Size (m2)",
         "a very long column heading that nobody would ever type by hand", "Use Type"]
CAT = "WITH names(i,n) AS (VALUES " + ",".join(f"({i},'{n}')" for i, n in enumerate(NAMES)) + """),
cat AS (SELECT 'file_' || l_orderkey AS source_file, n AS "column", l_linenumber AS position, CASE WHEN l_quantity>25 THEN 'string' ELSE 'double' END AS type
 FROM lineitem JOIN names ON i=l_partkey%20)
"""


def catalog(spark, d):
    """A schema catalogue: every order is a file and every line item one of its columns."""
    names = F.array(*[F.lit(n) for n in NAMES])
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("file_"), F.col("l_orderkey").cast("string")).alias("source_file"),
        F.element_at(names, (F.col("l_partkey") % 20 + 1).cast("int")).alias("column"), F.col("l_linenumber").alias("position"),
        F.when(F.col("l_quantity") > 25, "string").otherwise("double").alias("type"))


PAIRS = [(k, std, a.lower()) for k, (std, a) in enumerate((s, a) for s, v in schema.PROCESSOR_ALIASES.items() for a in v)]
SUGGEST = CAT.replace("WITH", "WITH RECURSIVE", 1) + ", al(k,std,a) AS (VALUES " + ",".join(f"({k},'{s}','{a}')" for k, s, a in PAIRS) + """),
 u AS (SELECT DISTINCT "column", lower(trim("column")) AS name FROM cat), x AS (SELECT "column", name, std, k, a, name=a AS ex FROM u, al),
 ab AS (SELECT DISTINCT name, a FROM x),
 run AS (SELECT name, a, i, j, max(n) AS n FROM ab, unnest(range(1,len(name)+1)) AS t(i), unnest(range(1,len(a)+1)) AS q(j), unnest(range(1,len(a)+1)) AS o(n)
  WHERE j+n<=len(a)+1 AND i+n<=len(name)+1 AND substr(name,i,n)=substr(a,j,n) GROUP BY ALL),
 seg AS (SELECT name, a, 1 AS alo, len(name)+1 AS ahi, 1 AS blo, len(a)+1 AS bhi FROM ab
  UNION ALL SELECT name, a, CASE WHEN side=0 THEN alo ELSE -m.i+m.n END, CASE WHEN side=0 THEN -m.i ELSE ahi END,
   CASE WHEN side=0 THEN blo ELSE -m.j+m.n END, CASE WHEN side=0 THEN -m.j ELSE bhi END
  FROM (SELECT seg.name, seg.a, alo, ahi, blo, bhi, max({'n': least(n, ahi-i, bhi-j), 'i': -i, 'j': -j}) AS m FROM seg JOIN run ON seg.name=run.name AND seg.a=run.a
   WHERE i>=alo AND i<ahi AND j>=blo AND j<bhi GROUP BY ALL), (VALUES (0),(1)) s(side)),
 hit AS (SELECT seg.name, seg.a, alo, ahi, blo, bhi, max(least(n, ahi-i, bhi-j)) AS n FROM seg JOIN run ON seg.name=run.name AND seg.a=run.a
   WHERE i>=alo AND i<ahi AND j>=blo AND j<bhi GROUP BY seg.name, seg.a, alo, ahi, blo, bhi),
 sim AS (SELECT name, a, 2.0*sum(n)/(len(name)+len(a)) AS s FROM hit GROUP BY name, a),
 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY ex DESC, CASE WHEN ex THEN 0 ELSE -s END, k) AS r FROM x LEFT JOIN sim USING (name, a) WHERE ex OR s>0.6) WHERE r=1),
 sug AS (SELECT cat.source_file, cat."column", position, std AS suggested, round(CASE WHEN ex THEN 1.0 ELSE s END,6) AS confidence,
  CASE WHEN ex THEN 'exact' ELSE 'fuzzy' END AS mapping_type FROM cat JOIN b ON cat."column"=b."column")
"""


@query("col5_suggest_mapping", SUGGEST + "SELECT * FROM sug")
def _(spark, d):
    return rounded(schema.suggest_mapping(catalog(spark, d)).drop("type"))


@query("col5_unmapped_required", SUGGEST + """SELECT f.source_file, r.suggested FROM (SELECT DISTINCT source_file FROM cat) f,
 (VALUES ('property_type'),('city'),('state')) r(suggested) WHERE NOT EXISTS (SELECT 1 FROM sug WHERE sug.source_file=f.source_file AND sug.suggested=r.suggested)""")
def _(spark, d):
    c = catalog(spark, d)
    return schema.unmapped_required(c, schema.suggest_mapping(c), ["property_type", "city", "state"])


@query("col6_apply_mapping", P + 'SELECT rid AS "id", city AS "City", state FROM props')
def _(spark, d):
    return schema.apply_mapping(props(spark, d).select("rid", "city", "state"), {"rid": "id", "city": "City", "absent": "x"})


@query("col7_clean_names", P + "SELECT rid, city AS city_name, state AS st, building_sqft AS building_sqft_total, zoning AS column_4 FROM props")
def _(spark, d):
    raw = props(spark, d).select("rid", F.col("city").alias("  City   Name "), F.col("state").alias("St."), F.col("building_sqft").alias("Building SqFt_(Total)"), F.col("zoning").alias("!!!"))
    return schema.clean_names(raw)


@query("col8_validate_names", CAT + """SELECT source_file, "column", 'special_characters' AS issue FROM cat WHERE regexp_matches("column",'[^\\w\\s-]')
UNION ALL SELECT source_file, "column", 'long_name' FROM cat WHERE length("column")>50
UNION ALL SELECT source_file, "column", 'numeric_only' FROM cat WHERE regexp_matches("column",'^\\d+$')
UNION ALL SELECT source_file, "column", 'duplicate' FROM cat GROUP BY 1,2 HAVING count(*)>1
UNION ALL SELECT source_file, NULL, 'few_columns' FROM cat GROUP BY 1 HAVING count(*)<3""")
def _(spark, d):
    return schema.validate_names(catalog(spark, d))


@query("col9_pipeline_record", P + """SELECT rid, parcel_id, property_type AS property_use, lot_acres AS acres, round(building_sqft,2) AS building_sqft, round(sold_price,2) AS market_value,
 0.0::double AS assessed_value, coalesce(zoning,'') AS zoning, year_built, city AS municipality, address, owner_name
 FROM (SELECT *, CASE WHEN lot_size_acres>1 THEN lot_size_acres ELSE 0.0 END AS lot_acres FROM props)""")
def _(spark, d):
    return rounded(schema.to_pipeline_record(raw_sheet(spark, d)), 2)


@query("col10_export_projection", S + """SELECT property_name AS "Property Name", property_type AS "Property Type", address AS "Address", city AS "City", state AS "State",
 county AS "County", building_sqft AS "Building SqFt", lot_size_acres AS "Lot Size Acres", year_built AS "Year Built", cast(sale_date as varchar) AS "Sale Date",
 sold_price AS "Sold Price", owner_name AS "Owner Name", occupancy AS "Occupancy", flex_score AS "Flex Score" FROM cand""")
def _(spark, d):
    out = schema.project_export(candidates(spark, d))
    return out.withColumn("Sale Date", F.col("Sale Date").cast("string"))


@query("col11_column_usage", CAT + """SELECT lower(trim("column")) AS "column", count(DISTINCT source_file) AS n_files,
 count(DISTINCT source_file)=(SELECT count(DISTINCT source_file) FROM cat) AS is_common FROM cat GROUP BY 1""")
def _(spark, d):
    return schema.column_usage(catalog(spark, d))


@query("col11_schema_diff", CAT + """SELECT f.source_file, c.c AS missing_column FROM (SELECT DISTINCT source_file FROM cat) f,
 (SELECT DISTINCT lower(trim("column")) AS c FROM cat) c WHERE NOT EXISTS (SELECT 1 FROM cat WHERE cat.source_file=f.source_file AND lower(trim(cat."column"))=c.c)""")
def _(spark, d):
    return schema.schema_diff(catalog(spark, d))


def _required_sql():
    def missing(groups):
        return "concat_ws('|'," + ",".join(
            f"CASE WHEN NOT bool_or(regexp_matches(lower(\"column\"),'{'|'.join(g)}')) THEN '{g[0]}' END" for g in groups) + ")"
    return (CAT + f"SELECT source_file, {missing(schema.REQUIRED_GROUPS)} AS missing_required, {missing(schema.RECOMMENDED_GROUPS)} AS missing_recommended, "
            f"{missing(schema.REQUIRED_GROUPS)}='' AS is_valid FROM cat GROUP BY 1")


@query("col12_check_required", _required_sql())
def _(spark, d):
    out = schema.check_required(catalog(spark, d))
    return out.withColumns({c: F.concat_ws("|", c) for c in ("missing_required", "missing_recommended")})


@query("col13_drop_empty_columns", P + "SELECT rid, city FROM props")
def _(spark, d):
    return schema.drop_empty_columns(props(spark, d).select("rid", F.when(F.col("building_sqft") < 0, "x").alias("nothing"), "city"))


@query("dq17_check_types", CAT + """SELECT source_file, "column", position, type FROM cat WHERE type='string' AND regexp_matches(lower("column"),'price|sqft|size|year|rate')""")
def _(spark, d):
    return schema.check_types(catalog(spark, d))


# --- de-duplication and unions -------------------------------------------------------------------------------------

@query("win1_dup_key", P + f"SELECT rid, {KEY} AS duplicate_key FROM props")
def _(spark, d):
    return ids(dedupe.dup_key(props(spark, d)), "duplicate_key")


KEYED = S + f", keyed AS (SELECT *, {KEY} AS k FROM cand)"


@query("win2_dedupe_best", KEYED + """SELECT rid, address, flex_score FROM
 (SELECT *, row_number() OVER (PARTITION BY k ORDER BY flex_score DESC NULLS LAST, parcel_id, rid) AS r FROM keyed) WHERE r=1""")
def _(spark, d):
    return ids(dedupe.dedupe_best(candidates(spark, d)), "address", "flex_score")


@query("win3_dedupe_first", KEYED + """SELECT rid, address, source_file FROM
 (SELECT *, row_number() OVER (PARTITION BY k ORDER BY source_file, row_pos, rid) AS r FROM keyed) WHERE r=1""")
def _(spark, d):
    return ids(dedupe.dedupe_first(candidates(spark, d), ["source_file", "row_pos", "rid"]), "address", "source_file")


@query("win4_dedupe_raw", S + """SELECT rid, address, flex_score FROM
 (SELECT *, row_number() OVER (PARTITION BY address, city, state ORDER BY flex_score DESC NULLS LAST, parcel_id, rid) AS r FROM cand) WHERE r=1""")
def _(spark, d):
    return ids(dedupe.dedupe_raw(candidates(spark, d)), "address", "flex_score")


@query("win5_dup_summary", KEYED + """, g AS (SELECT k, count(*) AS n FROM keyed GROUP BY 1 HAVING count(*)>1)
SELECT cast(sum(n)-count(*) as bigint) AS potential_duplicates, count(*) AS duplicate_groups_count, max(n) AS largest_duplicate_group,
 (SELECT count(*) FROM cand) AS total_properties FROM g""")
def _(spark, d):
    return dedupe.dup_summary(candidates(spark, d))


@query("win5_dup_members", KEYED + """, g AS (SELECT k, count(*) AS n FROM keyed GROUP BY 1 HAVING count(*)>1 ORDER BY k LIMIT 10)
SELECT keyed.k AS duplicate_key, g.n AS group_size, rid, address, city, state, flex_score, source_file FROM keyed JOIN g ON keyed.k=g.k""")
def _(spark, d):
    return dedupe.dup_members(candidates(spark, d))


@query("win6_mark_dups", P + "SELECT rid, count(*) OVER (PARTITION BY address, city, state)>1 AS is_duplicate FROM props")
def _(spark, d):
    return ids(dedupe.mark_dups(props(spark, d).select("rid", "address", "city", "state"), ["address", "city", "state"], salt_by=["rid"]), "is_duplicate")


@query("win7_distinct", P + "SELECT DISTINCT address, city, state, zoning, property_type FROM props")
def _(spark, d):
    return dedupe.distinct(props(spark, d).select("address", "city", "state", "zoning", "property_type"))


@query("set1_union_all", P + """SELECT rid, city, zoning, NULL::varchar AS county FROM props WHERE source_file='file_A'
UNION ALL SELECT rid, city, NULL, county FROM props WHERE source_file<>'file_A'""")
def _(spark, d):
    p = props(spark, d)
    return dedupe.union_all([p.where("source_file = 'file_A'").select("rid", "city", "zoning"), p.where("source_file <> 'file_A'").select("rid", "city", "county")])


@query("set2_column_sets", CAT + """, a AS (SELECT DISTINCT "column" FROM cat WHERE type='string'), b AS (SELECT DISTINCT "column" FROM cat WHERE type='double')
SELECT "column", 'both' AS "where" FROM a WHERE "column" IN (SELECT * FROM b) UNION ALL SELECT "column", 'left' FROM a WHERE "column" NOT IN (SELECT * FROM b)
UNION ALL SELECT "column", 'right' FROM b WHERE "column" NOT IN (SELECT * FROM a)""")
def _(spark, d):
    c = catalog(spark, d)
    return dedupe.column_sets(c.where("type = 'string'").select("column").distinct(), c.where("type = 'double'").select("column").distinct())


BY_FILE = ["file_A", "file_N", "file_R"]


@query("set3_aggregate", KEYED + """SELECT rid, flex_score FROM
 (SELECT *, row_number() OVER (PARTITION BY k ORDER BY flex_score DESC NULLS LAST, parcel_id, rid) AS r FROM keyed) WHERE r=1""")
def _(spark, d):
    c = candidates(spark, d)
    return ids(dedupe.aggregate([c.where(F.col("source_file") == f) for f in BY_FILE], keep=["rid", "flex_score"]), "flex_score")


@query("set3_aggregate_stats", KEYED + """, u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY flex_score DESC NULLS LAST, parcel_id, rid) AS r FROM keyed) WHERE r=1)
SELECT count(*) AS total_after, count(DISTINCT address) AS unique_addresses, count(DISTINCT city) AS unique_cities, count(DISTINCT state) AS unique_states,
 count(*) FILTER (flex_score BETWEEN 8 AND 10) AS score_8_to_10, count(*) FILTER (flex_score>=6 AND flex_score<8) AS score_6_to_8,
 count(*) FILTER (flex_score>=4 AND flex_score<6) AS score_4_to_6, count(*) FILTER (flex_score<4) AS score_below_4, (SELECT count(*) FROM cand) AS total_before,
 (SELECT count(*) FROM cand)-count(*) AS duplicates_removed, round(((SELECT count(*) FROM cand)-count(*))*100.0/(SELECT count(*) FROM cand),6) AS deduplication_rate FROM u""")
def _(spark, d):
    c = candidates(spark, d)
    return rounded(dedupe.aggregate_stats(c, dedupe.dedupe_best(c, keep=["address", "city", "state", "flex_score"])))


@query("sco15_add_scoring", W + """SELECT rid, round_even(least((z*3.0+s*2.0+0*2.5+location_score*1.5+5.0*1.0+5.0*1.0)/11.0 + CASE WHEN z>=8 AND s>=7 THEN 0.5 ELSE 0.0 END,10.0),2) AS flex_score
 FROM (SELECT *, zoning_score AS z, CASE WHEN lot_size_acres>1 THEN size_score ELSE 0.0 END AS s FROM parts
 WHERE regexp_matches(lower(property_type),'industrial|warehouse|distribution|flex|manufacturing|storage|logistics'))""")
def _(spark, d):
    raw = flt.filter_industrial(raw_sheet(spark, d), col="Property Type")
    return ids(sco.weighted_score(schema.to_pipeline_record(raw), TODAY), "flex_score")
