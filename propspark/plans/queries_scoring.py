"""Queries for filters (FLT), scores (SCO) and sorted selections (SRT)."""

from pyspark.sql import functions as F

from propspark.operators import filters as flt, scoring as sco
from propspark.plans.props import PROPS_SQL as P, TODAY, props
from propspark.plans.registry import query
from propspark.plans.sqltext import (CANDIDATE, CLASS, INDUSTRIAL, LOT_PTS, OCC_PTS, SCORED_SQL, SIZE_PTS, TYPE_PTS,
                                     WEIGHTED_SQL, YEAR_PTS)


def ids(df, *cols):
    return df.select("rid", *cols)


def scored(spark, d):
    return sco.flex_score(props(spark, d))


def candidates(spark, d):
    """Scored candidate rows: the input of most reports."""
    return sco.flex_score(flt.classify(props(spark, d)))


def weighted(spark, d):
    return sco.weighted_score(props(spark, d), TODAY)


@query("flt1_industrial", P + f"SELECT rid, property_type FROM props WHERE {INDUSTRIAL}")
def _(spark, d):
    return ids(flt.filter_industrial(props(spark, d)), "property_type")


@query("flt2_building", P + "SELECT rid, building_sqft FROM props WHERE building_sqft>=20000")
def _(spark, d):
    return ids(flt.filter_building(props(spark, d)), "building_sqft")


@query("flt3_lot", P + "SELECT rid, lot_size_acres FROM props WHERE lot_size_acres BETWEEN 0.5 AND 20")
def _(spark, d):
    return ids(flt.filter_lot(props(spark, d)), "lot_size_acres")


@query("flt4_classify", P + f"SELECT rid, property_type, building_sqft FROM props WHERE {CANDIDATE}")
def _(spark, d):
    return ids(flt.classify(props(spark, d)), "property_type", "building_sqft")


@query("flt4_classify_funnel", P + f"""
, c AS (SELECT count(*) AS n, count(*) FILTER ({INDUSTRIAL}) AS a, count(*) FILTER ({INDUSTRIAL} AND building_sqft>=20000) AS b,
 count(*) FILTER ({CANDIDATE}) AS e FROM props)
SELECT 0 AS step_no, 'original' AS step, n AS n_rows, round(100.0*n/n,6) AS pct_of_original FROM c
UNION ALL SELECT 1,'industrial',a,round(100.0*a/n,6) FROM c UNION ALL SELECT 2,'building',b,round(100.0*b/n,6) FROM c
UNION ALL SELECT 3,'lot',e,round(100.0*e/n,6) FROM c""")
def _(spark, d):
    return flt.classify_funnel(props(spark, d)).withColumn("pct_of_original", F.round("pct_of_original", 6))


NUM = ("CASE WHEN trim(regexp_replace(price_text,'[$,%]','','g')) NOT IN ('N/A','n/a','NA','na','','None','none') THEN "
       "CASE WHEN regexp_matches(trim(regexp_replace(price_text,'[$,%]','','g')),'^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') "
       "THEN try_cast(trim(regexp_replace(price_text,'[$,%]','','g')) as double) END END")


@query("flt5_range", P + f"SELECT rid, price_text FROM props WHERE ({NUM}) BETWEEN 10 AND 30000")
def _(spark, d):
    return ids(flt.range_filter(props(spark, d), "price_text", 10, 30000), "price_text")


@query("flt6_compare", P + f"""
SELECT rid, 'ge' AS op FROM props WHERE ({NUM})>=85 UNION ALL SELECT rid,'lt' FROM props WHERE ({NUM})<85
UNION ALL SELECT rid,'ne' FROM props WHERE ({NUM})<>85 UNION ALL SELECT rid,'eq' FROM props WHERE ({NUM})=85
UNION ALL SELECT rid,'gt' FROM props WHERE ({NUM})>85 UNION ALL SELECT rid,'le' FROM props WHERE ({NUM})<=85""")
def _(spark, d):
    p = props(spark, d)
    ops = {"ge": ">=", "lt": "<", "ne": "!=", "eq": "==", "gt": ">", "le": "<="}
    out = None
    for name, op in ops.items():
        part = ids(flt.compare(p, "price_text", op, 85)).withColumn("op", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("flt7_values", P + "SELECT rid, state FROM props WHERE state IN ('FL','TX')")
def _(spark, d):
    return ids(flt.value_filter(props(spark, d), "state", ["FL", "TX"]), "state")


@query("flt8_bounds", P + """SELECT rid FROM props WHERE sold_price BETWEEN 500000 AND 2500000 AND building_sqft BETWEEN 20000 AND 150000
 AND year_built BETWEEN 1970 AND 2010 AND lot_size_acres BETWEEN 1 AND 15 AND occupancy BETWEEN 85 AND 100""")
def _(spark, d):
    df = props(spark, d)
    for kind, bounds in (("price", (500000, 2500000)), ("size", (20000, 150000)), ("year", (1970, 2010)),
                         ("lot", (1, 15)), ("occupancy", (85, 100))):
        df = flt.bound_filter(df, kind, bounds)
    return ids(df)


@query("flt9_bundle", P + """SELECT rid, property_type, sold_price FROM props WHERE
 regexp_matches(lower(property_type),'industrial|warehouse|distribution|flex') AND building_sqft BETWEEN 20000 AND 100000
 AND lot_size_acres BETWEEN 0.5 AND 20 AND sold_price BETWEEN 150000 AND 2000000""")
def _(spark, d):
    return ids(flt.apply_filters(props(spark, d)), "property_type", "sold_price")


SPEC = {"building_sqft": {"min": 30000, "max": 120000}, "state": ["FL", "CA"], "property_type": "Warehouse", "nope": 1}
SPEC_SQL = "building_sqft>=30000 AND building_sqft<=120000 AND state IN ('FL','CA') AND property_type='Warehouse'"


@query("flt10_filter_map", P + f"SELECT rid, building_sqft FROM props WHERE {SPEC_SQL}")
def _(spark, d):
    return ids(flt.filter_map(props(spark, d), SPEC), "building_sqft")


@query("flt10_filter_map_summary", P + f"""SELECT count(*) AS original_count, count(*) FILTER ({SPEC_SQL}) AS filtered_count,
 round((count(*)-count(*) FILTER ({SPEC_SQL}))*100.0/count(*),6) AS reduction_percentage, cast(4 as bigint) AS filters_count FROM props""")
def _(spark, d):
    return flt.filter_map_summary(props(spark, d), SPEC).withColumn(
        "reduction_percentage", F.round("reduction_percentage", 6))


@query("flt12_find_candidates", SCORED_SQL + """SELECT parcel_id, address, owner_name, flex_score, zoning, lot_size_acres, building_sqft
 FROM (SELECT * FROM scored WHERE flex_score>=5 AND zoning IN ('IL','IG','IP','IND','M-1','MUPD')
 ORDER BY flex_score DESC, parcel_id, rid LIMIT 1000)""")
def _(spark, d):
    return flt.find_candidates(scored(spark, d))


@query("flt13_select_for_enrichment", P + """SELECT rid, market_value FROM props WHERE market_value>500000
 ORDER BY market_value DESC, parcel_id, rid LIMIT 100""")
def _(spark, d):
    return ids(flt.select_for_enrichment(props(spark, d)), "market_value")


DEMO = """regexp_matches(lower(property_type),'industrial|warehouse|distribution|flex') AND building_sqft>=20000
 AND lot_size_acres BETWEEN 0.5 AND 20 AND sold_price BETWEEN 150000 AND 50000000"""


@query("flt14_demo_filter", P + f"SELECT rid, sold_price FROM props WHERE {DEMO}")
def _(spark, d):
    return ids(flt.demo_filter(props(spark, d)), "sold_price")


@query("flt15_uses", P + """SELECT rid, property_use FROM props WHERE property_use IN ('HEAVY MFG','VACANT INDUSTRIAL','WAREH/DIST TERM',
 'OPEN STORAGE','WORKING WATERFRONT','STORES','SHOPPING CENTER CMMITY','SMALL DISCOUNT STORE < 25000 SF')""")
def _(spark, d):
    return ids(flt.filter_uses(props(spark, d)), "property_use")


@query("flt16_min_score", SCORED_SQL + "SELECT rid, flex_score FROM scored WHERE flex_score>=4")
def _(spark, d):
    return ids(flt.min_score(scored(spark, d)), "flex_score")


@query("flt17_industrial_sample", P + f"""SELECT property_name, property_type, building_sqft, city, state FROM
 (SELECT * FROM props WHERE {INDUSTRIAL} ORDER BY rid LIMIT 10)""")
def _(spark, d):
    return flt.industrial_sample(props(spark, d))


@query("flt17_industrial_types", P + f"SELECT DISTINCT property_type FROM props WHERE {INDUSTRIAL}")
def _(spark, d):
    return flt.industrial_types(props(spark, d))


@query("sco1_flex_score", SCORED_SQL + "SELECT rid, flex_score FROM scored")
def _(spark, d):
    return ids(scored(spark, d), "flex_score")


def _cfg_sql(w, top="10.0"):
    parts = dict(zip(("building_size", "property_type", "lot_size", "age_condition", "occupancy"),
                     (SIZE_PTS, TYPE_PTS, LOT_PTS, YEAR_PTS, OCC_PTS)))
    cols = ", ".join(f"round(cast({e} as double)*{w[k]},6) AS {k}" for k, e in parts.items())
    total = "+".join(f"cast({e} as double)*{w[k]}" for k, e in parts.items())
    return P + f"SELECT rid, round(least({total},{top}),6) AS flex_score, {cols} FROM props"


def _cfg(spark, d, cfg):
    df = sco.flex_score_cfg(props(spark, d), cfg)
    parts = df.schema["score_breakdown"].dataType.names
    return ids(df, F.round("flex_score", 6).alias("flex_score"),
               *[F.round(F.col("score_breakdown")[p], 6).alias(p) for p in parts])


@query("sco2_configured_score", _cfg_sql(sco.PRESETS["conservative"].weights))
def _(spark, d):
    return _cfg(spark, d, sco.PRESETS["conservative"])


@query("sco2_aggressive_preset", _cfg_sql(sco.PRESETS["aggressive"].weights))
def _(spark, d):
    return _cfg(spark, d, sco.PRESETS["aggressive"])


OPEN_CFG = sco.ScoreConfig(size_ranges=((20000, 50000, 3.0), (50000, 100000, 2.0), (100000, None, 1.0)),
                           year_steps=((1980, 0.5), (1990, 1.0), (2010, 1.5)), occupancy_percent=95.0,
                           occupancy_points=2.0, max_score=9.0)


@query("sco3_configured_score_open", P + f"""
, s AS (SELECT rid, cast(CASE WHEN building_sqft>=20000 AND building_sqft<50000 THEN 3.0 WHEN building_sqft>=50000 AND building_sqft<100000
 THEN 2.0 WHEN building_sqft>=100000 THEN 1.0 ELSE 0.0 END as double) AS building_size, cast({TYPE_PTS} as double) AS property_type,
 cast({LOT_PTS} as double) AS lot_size,
 cast(CASE WHEN year_built>=2010 THEN 1.5 WHEN year_built>=1990 THEN 1.0 WHEN year_built>=1980 THEN 0.5 ELSE 0.0 END as double) AS age_condition,
 cast(CASE WHEN occupancy/100<0.95 THEN 2.0 ELSE 0.0 END as double) AS occupancy FROM props)
SELECT rid, least(building_size+property_type+lot_size+age_condition+occupancy, 9.0) AS flex_score, building_size, property_type,
 lot_size, age_condition, occupancy FROM s""")
def _(spark, d):
    return _cfg(spark, d, OPEN_CFG)


W = WEIGHTED_SQL


@query("sco4_weighted_score", W + """SELECT rid, flex_score,
 CASE WHEN zoning_score>=8 AND size_score>=7 THEN 'HIGH_POTENTIAL' ELSE '' END AS flags FROM weighted""")
def _(spark, d):
    return ids(weighted(spark, d), "flex_score", F.concat_ws(",", "flags").alias("flags"))


@query("sco4a_zoning", W + "SELECT rid, zoning_score FROM parts")
def _(spark, d):
    return ids(props(spark, d).withColumn("zoning_score", sco.zoning_score(F.col("zoning"))), "zoning_score")


@query("sco4b_size", W + "SELECT rid, round(size_score,6) AS size_score FROM parts")
def _(spark, d):
    return ids(props(spark, d), F.round(sco.size_score(F.col("lot_size_acres")), 6).alias("size_score"))


@query("sco4d_location", W + "SELECT rid, location_score FROM parts")
def _(spark, d):
    return ids(props(spark, d), sco.location_score(F.col("city")).alias("location_score"))


@query("sco4f_value", W + "SELECT rid, value_score FROM parts")
def _(spark, d):
    p = props(spark, d)
    return ids(p, sco.value_score(p).alias("value_score"))


@query("sco5_classification", W + f"SELECT {CLASS} AS flex_classification, count(*) AS n FROM weighted GROUP BY 1")
def _(spark, d):
    return (weighted(spark, d).groupBy(sco.classify_score(F.col("flex_score")).alias("flex_classification"))
            .agg(F.count("*").alias("n")))


@query("sco6_score_report", W + f"""SELECT rid, {CLASS} AS classification,
 concat_ws('; ', CASE WHEN zoning_score>=8 THEN 'Excellent industrial zoning' END, CASE WHEN size_score>=8 THEN 'Ideal property size for flex' END,
  CASE WHEN building_score>=8 THEN 'Building well-suited for flex use' END) AS strengths,
 concat_ws('; ', CASE WHEN zoning_score<5 THEN 'Zoning may not permit industrial use' END,
  CASE WHEN size_score<5 THEN 'Property size not optimal for flex' END,
  CASE WHEN building_score<5 THEN 'Building needs modifications for flex use' END) AS weaknesses,
 CASE WHEN flex_score>=6 THEN 'High priority for acquisition/development' WHEN flex_score>=4 THEN
  'Investigate further with site visit; Check zoning for conditional use permits' ELSE '' END AS recommendations FROM weighted""")
def _(spark, d):
    r = sco.score_report(weighted(spark, d))
    return ids(r, "classification", *[F.concat_ws("; ", c).alias(c) for c in ("strengths", "weaknesses", "recommendations")])


USE = "upper(property_use)"
SIMPLE = f"""
, sized AS (SELECT *, cast(CASE WHEN lot_size_acres>0 THEN floor(lot_size_acres*43560*0.25) ELSE 0 END as bigint) AS derived_sqft FROM props)
, simple AS (SELECT *, cast(CASE WHEN {USE} LIKE '%WAREH%' OR {USE} LIKE '%DIST%' THEN 4 WHEN {USE} LIKE '%VACANT INDUSTRIAL%' THEN 3
  WHEN {USE} LIKE '%MFG%' THEN 2 WHEN {USE} LIKE '%STORAGE%' THEN 2 WHEN {USE} LIKE '%INDUSTRIAL%' THEN 1 ELSE 0 END
 + CASE WHEN derived_sqft BETWEEN 20000 AND 50000 THEN 3 WHEN derived_sqft>50000 AND derived_sqft<=100000 THEN 2
  WHEN derived_sqft>100000 AND derived_sqft<=200000 THEN 1 WHEN derived_sqft>200000 THEN 0.5 ELSE 0 END
 + CASE WHEN lot_size_acres BETWEEN 1 AND 5 THEN 2 WHEN lot_size_acres>5 AND lot_size_acres<=10 THEN 1.5
  WHEN lot_size_acres>=0.5 AND lot_size_acres<1 THEN 1 WHEN lot_size_acres>10 AND lot_size_acres<=20 THEN 0.5 ELSE 0 END
 + CASE WHEN market_value BETWEEN 500000 AND 5000000 THEN 2 WHEN market_value>5000000 AND market_value<=10000000 THEN 1
  WHEN market_value>=250000 AND market_value<500000 THEN 1 ELSE 0 END as double) AS flex_score FROM sized)
, labelled AS (SELECT *, CASE WHEN flex_score>=8 THEN 'EXCELLENT' WHEN flex_score>=6 THEN 'VERY GOOD' WHEN flex_score>=4 THEN 'GOOD'
  WHEN flex_score>=2 THEN 'MODERATE' ELSE 'LOW' END AS flex_potential,
 CASE WHEN derived_sqft BETWEEN 20000 AND 100000 AND regexp_matches({USE},'WAREH|DIST|STORAGE|VACANT') AND lot_size_acres BETWEEN 1 AND 10
   THEN 'HIGHLY SUITABLE' WHEN derived_sqft BETWEEN 20000 AND 100000 AND regexp_matches({USE},'WAREH|DIST|STORAGE|VACANT') THEN 'SUITABLE'
  WHEN derived_sqft BETWEEN 20000 AND 100000 OR regexp_matches({USE},'WAREH|DIST|STORAGE|VACANT') THEN 'POTENTIALLY SUITABLE'
  ELSE 'LIMITED SUITABILITY' END AS multi_tenant_suitable FROM simple)
, identified AS (SELECT * FROM labelled WHERE property_use<>'STORES' AND (derived_sqft<=0 OR derived_sqft>=20000) AND flex_score>0)
"""
SIMPLE_SQL = P + SIMPLE


@query("sco7_simple_score", SIMPLE_SQL + "SELECT rid, flex_score FROM simple")
def _(spark, d):
    return ids(sco.simple_score(sco.derive_sqft(props(spark, d))), "flex_score")


@query("sco8_derive_sqft", SIMPLE_SQL + "SELECT rid, derived_sqft FROM sized")
def _(spark, d):
    return ids(sco.derive_sqft(props(spark, d)), "derived_sqft")


@query("sco9_suitability", SIMPLE_SQL + "SELECT rid, flex_potential, multi_tenant_suitable FROM labelled")
def _(spark, d):
    df = sco.suitability(sco.simple_score(sco.derive_sqft(props(spark, d))))
    return ids(df, "flex_potential", "multi_tenant_suitable")


@query("sco10_identify", SIMPLE_SQL + "SELECT rid, derived_sqft, flex_score, flex_potential, multi_tenant_suitable FROM identified")
def _(spark, d):
    return ids(sco.identify(props(spark, d)), "derived_sqft", "flex_score", "flex_potential", "multi_tenant_suitable")


IND = f"""
, ind0 AS (SELECT *, CASE WHEN {USE} LIKE '%WAREH%' OR {USE} LIKE '%DIST%' THEN 3.0 WHEN {USE} LIKE '%INDUSTRIAL%' THEN 2.5
  WHEN {USE} LIKE '%MFG%' THEN 2.0 WHEN {USE} LIKE '%STORAGE%' THEN 1.5 ELSE 0.0 END AS tp, 2001-year_built AS age,
  datediff('day',cast(sale_date as date),DATE '2001-12-31')<=730 AS recent,
  CASE WHEN land_market_value>0 THEN improvement_value/land_market_value END AS ratio FROM props)
, ind AS (SELECT *, cast(tp + CASE WHEN age<=10 THEN 2 WHEN age<=20 THEN 1 ELSE 0 END + CASE WHEN recent THEN 1 ELSE 0 END
  + CASE WHEN ratio>=2 THEN 2 WHEN ratio>=1 THEN 1 ELSE 0 END + CASE WHEN lot_size_acres BETWEEN 0.5 AND 10 THEN 1 ELSE 0 END as double)
  AS adjustment FROM ind0)
"""


@query("sco11_flex_indicators", P + IND + """SELECT rid, adjustment AS flex_score_adjustment, tp>0 AS is_flex_compatible,
 cast(greatest(age,0) as bigint) AS building_age, recent AS recent_sale, round(greatest(coalesce(ratio,0),0),6) AS value_ratio,
 cast(tp as double) AS property_type_score FROM ind""")
def _(spark, d):
    x = sco.flex_indicators(props(spark, d), TODAY)
    return ids(x, "flex_indicators.*").withColumn("value_ratio", F.round("value_ratio", 6))


@query("sco12_use_class", P + f"""SELECT rid, CASE WHEN {USE} LIKE '%WAREH%' OR {USE} LIKE '%DIST%' THEN 'WAREHOUSE/DISTRIBUTION'
 WHEN {USE} LIKE '%MFG%' OR {USE} LIKE '%MANUFACT%' THEN 'MANUFACTURING' WHEN {USE} LIKE '%INDUSTRIAL%' THEN 'INDUSTRIAL'
 WHEN {USE} LIKE '%STORAGE%' THEN 'STORAGE' WHEN {USE} LIKE '%STORE%' OR {USE} LIKE '%SHOPPING%' THEN 'COMMERCIAL' ELSE 'UNKNOWN' END AS use_type,
 ({USE} LIKE '%WAREH%' OR {USE} LIKE '%DIST%') AS is_warehouse, ({USE} LIKE '%MFG%' OR {USE} LIKE '%MANUFACT%') AS is_manufacturing,
 {USE} LIKE '%INDUSTRIAL%' AS is_industrial,
 regexp_matches({USE},'WAREH|DIST|MFG|MANUFACT|INDUSTRIAL') AS is_flex_compatible FROM props""")
def _(spark, d):
    return ids(sco.use_class(props(spark, d)), "use_type", "is_warehouse", "is_manufacturing", "is_industrial",
               "is_flex_compatible")


@query("sco13_adjusted_score", W + IND.replace("FROM props", "FROM weighted") + """SELECT rid,
 round(CASE WHEN zoning='RS' THEN flex_score ELSE greatest(least(flex_score+adjustment,10.0),0.0) END,6) AS final_score FROM ind""")
def _(spark, d):
    df = sco.flex_indicators(weighted(spark, d), TODAY).withColumn(
        "adjustment", F.when(F.coalesce(F.col("zoning"), F.lit("")) != "RS",
                             F.col("flex_indicators.flex_score_adjustment")))
    out = sco.adjust(df, "flex_score", "adjustment", "final_score")
    return ids(out, F.round("final_score", 6).alias("final_score"))


@query("sco14_demo_score", P + f"""SELECT rid, cast(least(CASE WHEN building_sqft BETWEEN 20000 AND 50000 THEN 3.0 WHEN building_sqft>50000 AND
 building_sqft<=100000 THEN 2.0 WHEN building_sqft>100000 THEN 1.0 ELSE 0.0 END + CASE WHEN lower(property_type) LIKE '%flex%' THEN 3.0
 WHEN lower(property_type) LIKE '%warehouse%' THEN 2.5 WHEN lower(property_type) LIKE '%industrial%' THEN 2.0 ELSE 0.0 END
 + CASE WHEN lot_size_acres BETWEEN 1 AND 5 THEN 2.0 WHEN lot_size_acres>5 AND lot_size_acres<=10 THEN 1.5 ELSE 0.0 END
 + CASE WHEN year_built>=1990 THEN 1.0 ELSE 0.0 END, 10.0) as double) AS flex_score FROM props WHERE {DEMO}""")
def _(spark, d):
    return ids(sco.demo_score(flt.demo_filter(props(spark, d))), "flex_score")


@query("sco16_classify_file", W + f"""SELECT rid, source_file, flex_score, {CLASS} AS flex_classification, zoning_score,
 round(size_score,6) AS size_score, building_score, location_score, activity_score, value_score FROM weighted WHERE flex_score>=4""")
def _(spark, d):
    df = sco.classify_file(props(spark, d), TODAY)
    return ids(df, "source_file", "flex_score", "flex_classification", "zoning_score",
               F.round("size_score", 6).alias("size_score"), "building_score", "location_score", "activity_score",
               "value_score")


# Nested inputs, derived row by row: two permits and two licences per line item and its own numbers as the building.
def nested_parcels(spark, d):
    from propspark.plans.props import table

    q = F.col("l_quantity")
    building = F.when(F.col("l_linenumber") > 1, F.struct(
        (q * 1000).alias("total_sqft"), (F.col("l_linenumber") * 4).cast("double").alias("ceiling_height"),
        (F.col("l_partkey") % 3).alias("loading_docks"), F.lit(0).alias("overhead_doors"),
        (q * 100 * (F.col("l_suppkey") % 6)).alias("office_area"), (q * 300).alias("warehouse_area")))
    status = lambda c, v: F.struct(F.when(F.col(c) == v, "ACTIVE").otherwise("EXPIRED").alias("status"))
    return (
        table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", building.alias("building_data"),
                F.array(F.struct(F.col("l_shipdate").alias("issue_date")),
                        F.struct(F.col("o_orderdate").alias("issue_date"))).alias("permits"),
                F.array(status("l_returnflag", "A"), status("l_linestatus", "F")).alias("business_licenses"),
                F.col("o_orderdate").alias("sale_date"), (F.col("o_totalprice") * 10).alias("improvement_value"),
                (F.col("l_extendedprice") * 20).alias("land_market_value")))


KEYS4 = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
NESTED = """WITH j AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity*1000 AS sq, l_linenumber*4 AS h, l_partkey%3 AS docks,
 l_quantity*100*(l_suppkey%6) AS office, l_quantity*300 AS store, l_returnflag, l_linestatus, l_linenumber AS n,
 datediff('day',cast(l_shipdate as date),DATE '2001-12-31') AS ship_age, datediff('day',cast(o_orderdate as date),DATE '2001-12-31') AS sale_age,
 o_totalprice*10 AS imp, l_extendedprice*20 AS land FROM lineitem JOIN orders ON l_orderkey=o_orderkey)
"""


@query("sco4c_building", NESTED + """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(CASE WHEN n<=1 THEN CASE WHEN imp>100000
 THEN 3.0 ELSE 0.0 END ELSE least(5.0 + CASE WHEN sq BETWEEN 5000 AND 100000 THEN 2 ELSE 0 END + CASE WHEN sq BETWEEN 15000 AND 35000 THEN 1 ELSE 0 END
 + CASE WHEN h BETWEEN 14 AND 24 THEN 2 ELSE 0 END + CASE WHEN docks>=1 THEN 1 ELSE 0 END
 + CASE WHEN office>0 AND store>0 AND office/(office+store) BETWEEN 0.15 AND 0.5 THEN 2 ELSE 0 END, 10.0) END as double) AS building_score FROM j""")
def _(spark, d):
    df = nested_parcels(spark, d)
    return df.select(*KEYS4, sco.building_score(df).alias("building_score"))


@query("sco4e_activity", NESTED + """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(least(5.0 + CASE WHEN ship_age<=365 THEN 1 ELSE 0 END
 + CASE WHEN sale_age<=365 THEN 1 ELSE 0 END + CASE WHEN l_returnflag='A' AND l_linestatus='F' THEN 3 WHEN l_returnflag='A' OR l_linestatus='F' THEN 1
 ELSE 0 END + CASE WHEN sale_age<=730 THEN 1 ELSE 0 END, 10.0) as double) AS activity_score FROM j""")
def _(spark, d):
    df = nested_parcels(spark, d)
    return df.select(*KEYS4, sco.activity_score(df, TODAY).alias("activity_score"))


@query("sco4f_value_with_building", NESTED + """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(least(5.0
 + CASE WHEN land>0 AND imp/land>1.5 THEN 2 WHEN land>0 AND imp/land>0.5 THEN 1 ELSE 0 END + CASE WHEN imp BETWEEN 500000 AND 5000000 THEN 2
 WHEN imp>=250000 AND imp<500000 THEN 1 ELSE 0 END + CASE WHEN n>1 AND sq>0 AND imp>0 AND imp/sq BETWEEN 50 AND 150 THEN 1 ELSE 0 END,10.0) as double)
 AS value_score FROM j""")
def _(spark, d):
    df = nested_parcels(spark, d)
    return df.select(*KEYS4, sco.value_score(df).alias("value_score"))


@query("srt1_sorted_candidates", SCORED_SQL + "SELECT rid, flex_score FROM cand ORDER BY flex_score DESC, rid")
def _(spark, d):
    from propspark.operators.analytics import sort_score

    return ids(sort_score(candidates(spark, d), tie=["rid"]), "flex_score")


@query("srt2_top_candidates", SCORED_SQL + """SELECT rid, parcel_id, property_name, property_type, flex_score FROM cand
 ORDER BY flex_score DESC, parcel_id, rid LIMIT 100""")
def _(spark, d):
    from propspark.operators.analytics import top_n

    return top_n(candidates(spark, d), 100).select("rid", "parcel_id", "property_name", "property_type", "flex_score")


@query("srt3_page", SCORED_SQL + """SELECT rid, cand.sale_date::varchar AS sale_date FROM cand
 ORDER BY cand.sale_date DESC, rid LIMIT 50 OFFSET 100""")
def _(spark, d):
    from propspark.operators.analytics import page

    out = page(candidates(spark, d), "sale_date", 100, 50, tie=["rid"])
    return ids(out, F.col("sale_date").cast("string").alias("sale_date"))
