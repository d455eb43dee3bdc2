"""Queries for joins and enrichment (JOI), upserts and flattened features."""

from pyspark.sql import functions as F

from propspark.functions.text import dashed_parcel
from propspark.operators import enrich as en
from propspark.operators.dedupe import union_all
from propspark.plans.props import PROPS_SQL as P, props, scratch, table
from propspark.plans.queries_analytics import rounded
from propspark.plans.queries_scoring import ids
from propspark.plans.registry import query
from propspark.sources import versioned


# Orders are the parcels; the line items of urgent and high-priority orders are their details.
def orders(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("parcel_id"), "o_custkey", (F.col("o_totalprice") * 10).alias("market_value"), "o_orderpriority", "o_orderdate")


def details(spark, d):
    li = table(spark, d, "lineitem").join(
        table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")), F.col("l_orderkey") == F.col("o_orderkey"))
    return li.select(F.col("l_orderkey").alias("parcel_id"), F.col("l_linenumber").alias("detail_no"), F.col("l_partkey").alias("detail_part"),
                     F.col("l_suppkey").alias("detail_supp"), F.col("l_quantity").alias("office_area"), F.col("l_extendedprice").alias("detail_price"),
                     (F.col("l_quantity") * 3 - 30).alias("warehouse_area"), (F.col("l_linenumber") % 3).alias("loading_docks"))


ORDER = ["detail_no", "detail_part", "detail_supp", "detail_price"]
D = """WITH details AS (SELECT l_orderkey AS parcel_id, l_linenumber AS detail_no, l_partkey AS detail_part, l_suppkey AS detail_supp,
 l_quantity AS office_area, l_extendedprice AS detail_price, l_quantity*3-30 AS warehouse_area, l_linenumber%3 AS loading_docks
 FROM lineitem JOIN orders ON l_orderkey=o_orderkey WHERE o_orderpriority IN ('1-URGENT','2-HIGH')),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY detail_no, detail_part, detail_supp, detail_price) AS r FROM details) WHERE r=1),
par AS (SELECT o_orderkey AS parcel_id, o_custkey, o_totalprice*10 AS market_value, o_orderpriority, o_orderdate FROM orders)
"""


@query("joi1_enrich_first_match", D + "SELECT par.parcel_id, market_value, detail_part, office_area FROM par LEFT JOIN first USING (parcel_id)")
def _(spark, d):
    return en.enrich(orders(spark, d), details(spark, d), order=ORDER, salt_by=["parcel_id"]).select(
        "parcel_id", "market_value", "detail_part", "office_area")


@query("joi2_assemble", D + """SELECT par.parcel_id, round(market_value,6) AS market_value, coalesce(loading_docks,0)>0 AS has_loading,
 round(CASE WHEN office_area>0 AND warehouse_area>0 THEN office_area/(office_area+warehouse_area) END,6) AS office_warehouse_ratio,
 office_area AS appraiser_office_area FROM par LEFT JOIN first USING (parcel_id)""")
def _(spark, d):
    df = en.enrich(orders(spark, d), details(spark, d), order=ORDER, salt_by=["parcel_id"])
    out = en.assemble(en.with_sources(df, ["parcel_id", "market_value"], ["detail_part", "office_area"]))
    return rounded(out.select("parcel_id", "market_value", "has_loading", "office_warehouse_ratio",
                              F.col("source_data.appraiser.office_area").alias("appraiser_office_area")))


def roll(spark, d):
    """A tax roll with two id columns in different spellings and text values; parts 0 to 2 of 3 are covered."""
    p = props(spark, d).where(F.col("row_pos") % 3 != 0)
    even = F.col("row_pos") % 2 == 0
    return p.select(
        F.when(even, F.col("parcel_id")).alias("PARID"), F.when(~even, dashed_parcel(F.col("parcel_id"))).alias("PCN"),
        F.col("rid").alias("roll_no"), F.col("market_value").cast("decimal(18,2)").cast("string").alias("JV"),
        F.when(F.col("occupancy") > 84, F.col("land_market_value").cast("decimal(18,2)").cast("string")).otherwise("").alias("LND_VAL"),
        F.concat(F.lit(" "), F.col("owner_name"), F.lit(" ")).alias("OWNER_NAME"), F.lit("x").alias("ACREAGE"),
        F.col("year_built").cast("string").alias("YR_BLT"))


R = P + """, roll AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY rid) AS r FROM props WHERE row_pos%3<>0) WHERE r=1)
"""


@query("joi3_cama_join", R + """SELECT props.rid, roll.rid AS roll_no, CASE WHEN roll.rid IS NULL THEN 'NOT_FOUND_IN_CAMA' END AS status,
 CASE WHEN roll.rid IS NULL THEN 'FAILED' ELSE 'COMPLETE' END AS data_quality FROM props LEFT JOIN roll USING (parcel_id)""")
def _(spark, d):
    p = props(spark, d).select("rid", "parcel_id")
    return en.cama_join(p, roll(spark, d), ["roll_no"], salt_by=["rid"], keep=["roll_no"]).select("rid", "roll_no", "status", "data_quality")


@query("joi3_spelling_order", """SELECT o_orderkey AS parcel, CASE WHEN o_orderkey%2=0 THEN 'exact' WHEN o_orderkey%3=0 THEN 'filled' WHEN o_orderkey%5=0 THEN 'dashed' ELSE 'spaced' END AS how,
 CASE WHEN o_orderkey%2=0 THEN 'PARCEL_ID' WHEN o_orderkey%3=0 THEN 'PCN' ELSE 'PARID' END AS id_column FROM orders""")
def _(spark, d):
    own = F.lpad(F.col("o_orderkey").cast("string"), 14, "9")
    parcels = table(spark, d, "orders").select(F.col("o_orderkey").alias("parcel"), own.alias("parcel_id"))
    key, none = F.col("parcel_id"), F.lit(None).cast("string")

    def rows(how, rank, **ids):
        return parcels.where(f"parcel % {rank} = 0").select(*[ids.get(k, none).alias(k) for k in ("PARID", "PCN", "PARCEL_ID")], F.lit(how).alias("how"), F.lit(9 - rank).alias("roll_no"))

    # The better a spelling, the later its id column and row.
    roll_ = union_all([rows("spaced", 1, PARID=F.concat(F.lit(" "), key)), rows("dashed", 5, PARID=dashed_parcel(key)),
                          rows("filled", 3, PCN=F.lpad(key, 17, "0")), rows("exact", 2, PARCEL_ID=key)])
    found = en.cama_join(parcels, roll_, ["roll_no"], salt_by=["parcel"])
    return found.select("parcel", "how", F.when(F.col("PARID").isNotNull(), "PARID").when(F.col("PCN").isNotNull(), "PCN").otherwise("PARCEL_ID").alias("id_column"))


@query("joi4_cama_fields", P + """SELECT rid AS roll_no, round(market_value,2) AS market_value_cama, CASE WHEN occupancy>84 THEN round(land_market_value,2) END AS land_value_cama,
 owner_name AS owner_name_cama, NULL::double AS acreage_cama, cast(year_built as double) AS year_built_cama,
 CASE WHEN occupancy>84 THEN round(market_value-land_market_value,2) END AS improvement_value_cama FROM props WHERE row_pos%3<>0""")
def _(spark, d):
    return rounded(en.cama_fields(roll(spark, d), ["roll_no"]), 2)


@query("joi5_fallback_join", D + """, f2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY detail_no, detail_part, detail_supp, detail_price) AS r
 FROM details WHERE office_area>25) WHERE r=1)
SELECT par.parcel_id, coalesce(f2.office_area, CASE WHEN first.detail_part%2=0 THEN first.office_area END) AS office_area,
 CASE WHEN f2.parcel_id IS NOT NULL THEN 'first' WHEN first.detail_part%2=0 THEN 'second' END AS data_source,
 CASE WHEN f2.parcel_id IS NOT NULL OR first.detail_part%2=0 THEN 'COMPLETE' ELSE 'FAILED' END AS data_quality
 FROM par LEFT JOIN f2 USING (parcel_id) LEFT JOIN first USING (parcel_id)""")
def _(spark, d):
    dt = details(spark, d)
    second = en.first_match(dt, ["parcel_id"], ORDER).where("detail_part % 2 = 0")
    return en.fallback_join(orders(spark, d).select("parcel_id"), dt.where("office_area > 25"), second, "parcel_id", ["office_area"], ORDER, ["parcel_id"])


@query("joi6_merge", D + """SELECT par.parcel_id, o_custkey, coalesce(detail_price, market_value) AS market_value, office_area FROM par LEFT JOIN first USING (parcel_id)""")
def _(spark, d):
    b = en.first_match(details(spark, d), ["parcel_id"], ORDER).select("parcel_id", F.col("detail_price").alias("market_value"), "office_area")
    return en.merge(orders(spark, d).select("parcel_id", "o_custkey", "market_value"), b, ["parcel_id"])


@query("joi6_merge_null_wins", D + """SELECT par.parcel_id, CASE WHEN first.parcel_id IS NULL THEN market_value WHEN detail_part%2=0 THEN detail_price END AS market_value
 FROM par LEFT JOIN first USING (parcel_id)""")
def _(spark, d):
    b = en.first_match(details(spark, d), ["parcel_id"], ORDER).select(
        "parcel_id", F.when(F.col("detail_part") % 2 == 0, F.col("detail_price")).alias("market_value"))
    return en.merge(orders(spark, d).select("parcel_id", "market_value"), b, ["parcel_id"], null_wins=True)


@query("joi7_group_footprints", """SELECT l_orderkey AS parcel_id, count(*) AS n_buildings, sum(l_quantity) AS total_area, min(l_linenumber) AS first_building FROM lineitem GROUP BY 1""")
def _(spark, d):
    buildings = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("parcel_id"), F.col("l_linenumber").alias("detail_no"), F.col("l_partkey").alias("detail_part"),
                                                   F.col("l_suppkey").alias("detail_supp"), F.col("l_extendedprice").alias("detail_price"), F.col("l_quantity").alias("office_area"))
    out = en.group_footprints(buildings, fields=ORDER + ["office_area"])
    one = F.aggregate("buildings", F.lit(0.0), lambda a, b: a + b["office_area"])
    return (out.groupBy("parcel_id").agg(F.sum(F.size("buildings")).alias("n_buildings"), F.sum(one).alias("total_area"),
                                         F.min(F.element_at("buildings", 1)["detail_no"]).alias("first_building")))


@query("joi8_restrict", D + "SELECT parcel_id, market_value FROM par WHERE parcel_id IN (SELECT parcel_id FROM details)")
def _(spark, d):
    return en.restrict(orders(spark, d), details(spark, d), "parcel_id").select("parcel_id", "market_value")


@query("joi9_unmatched", D + "SELECT parcel_id, o_orderpriority FROM par WHERE parcel_id NOT IN (SELECT parcel_id FROM details)")
def _(spark, d):
    return en.unmatched(orders(spark, d), details(spark, d), "parcel_id").select("parcel_id", "o_orderpriority")


@query("joi10_appraiser_fields", P + """SELECT rid, CASE WHEN zoning='RS' THEN NULL ELSE year_built END AS year_built, lot_size_acres AS acres, property_use, 0.0::double AS total_value,
 CASE WHEN zoning IS NULL THEN 0 ELSE 1 END AS n_sales, CASE WHEN zoning IS NOT NULL THEN cast(sale_date as varchar) END AS sale_date,
 CASE WHEN zoning IS NOT NULL THEN sold_price END AS sale_price FROM props""")
def _(spark, d):
    raw = props(spark, d).select(
        "rid", F.when(F.col("zoning") == "RS", "0").otherwise(F.concat(F.col("year_built").cast("string"), F.lit(".0"))).alias("YEAR_ADDED"),
        F.col("lot_size_acres").alias("ACRES"), F.col("property_use").alias("PROPERTY_USE"), F.col("sold_price").alias("PRICE"),
        F.when(F.col("zoning").isNotNull(), (F.unix_timestamp(F.col("sale_date").cast("timestamp")) * 1000).cast("string")).alias("SALE_DATE"))
    out = en.appraiser_fields(raw, ["rid"])
    sale = F.try_element_at("sales_history", F.lit(1))
    return out.select("rid", "building_info.year_built", "building_info.acres", "building_info.property_use", "building_info.total_value",
                      F.size("sales_history").alias("n_sales"), sale["sale_date"].cast("string").alias("sale_date"), sale["sale_price"].alias("sale_price"))


@query("snk5_upsert", """SELECT coalesce(c.c_custkey, u.k) AS c_custkey, c.c_name, coalesce(u.bal, c.c_acctbal) AS c_acctbal, u.n_orders FROM
 (SELECT * FROM customer WHERE c_custkey%4<>0) c FULL OUTER JOIN
 (SELECT o_custkey AS k, count(*) AS n_orders, CASE WHEN count(*)>10 THEN max(o_totalprice) END AS bal FROM orders GROUP BY 1) u ON c.c_custkey=u.k""")
def _(spark, d):
    base = table(spark, d, "customer").where("c_custkey % 4 <> 0").select("c_custkey", "c_name", "c_acctbal")
    new = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.max("o_totalprice").alias("top"))
    root = f"{scratch(spark, 'upsert')}/table"
    versioned.create(base, root, "c_custkey", buckets=16)
    changes = new.select("c_custkey", "n_orders", F.when(F.col("n_orders") > 10, F.col("top")).alias("c_acctbal"))
    for half in (0, 1):  # two runs, each over its own keys
        versioned.update(changes.where(F.col("c_custkey") % 2 == half), root)
    return versioned.read(spark, root)


@query("snk5_update_existing", """SELECT c.c_custkey, c.c_name, coalesce(u.bal, c.c_acctbal) AS c_acctbal FROM customer c LEFT JOIN
 (SELECT o_custkey AS k, arg_max(o_totalprice, o_orderkey) AS bal FROM orders GROUP BY 1) u ON c.c_custkey=u.k""")
def _(spark, d):
    root = f"{scratch(spark, 'update')}/table"
    versioned.create(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), root, "c_custkey", buckets=16)
    # several updates a key, of which the last counts, and some for keys that the table lacks
    orders_ = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), F.col("o_orderkey").alias("at"))
    strangers = orders_.withColumn("c_custkey", -F.col("c_custkey") - 1)
    versioned.update(orders_.unionByName(strangers), root, order=["at"], insert=False)
    return versioned.read(spark, root).drop("at")


@query("src5_flatten_features", P + """SELECT parcel_id, property_use, lot_size_acres AS acres, owner_name, city AS municipality, market_value, 0.0::double AS sale_price,
 'gis_property_use' AS source FROM props""")
def _(spark, d):
    attrs = F.struct(F.col("parcel_id").alias("PARID"), F.col("property_use").alias("PROPERTY_USE"), F.col("lot_size_acres").alias("ACRES"),
                     F.col("owner_name").alias("OWNER_NAME1"), F.col("city").alias("MUNICIPALITY"), F.col("market_value").alias("TOTAL_MARKET"))
    geometry = F.struct(F.lit(1.0).alias("x"))
    pages = props(spark, d).select(F.array(F.struct(attrs.alias("attributes"), geometry.alias("geometry"))).alias("features"))
    return en.flatten_features(pages).select("parcel_id", "property_use", "acres", "owner_name", "municipality", "market_value", "sale_price", "source")
