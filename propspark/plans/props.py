"""The conformed property table derived from the star-schema tables used for checks and benchmarks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from propspark.session import checkpoint_dir

TODAY = "2001-12-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which every executor can reach."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One property per line item. Dimension sizes decide between broadcast and shuffle joins at run time."""
    li, orders, part, supplier, nation, region = (
        table(spark, sf_dir, n) for n in ("lineitem", "orders", "part", "supplier", "nation", "region"))
    base = (
        li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    types = {"ECONOMY": "Flex Industrial", "SMALL": "Warehouse", "MEDIUM": "Distribution Center",
             "PROMO": "Light Industrial", "STANDARD": "Manufacturing"}
    property_type = F.lit("Office")
    for key, name in types.items():
        property_type = F.when(F.col("p_type") == key, name).otherwise(property_type)
    states = {"AFRICA": "FL", "AMERICA": "TX", "ASIA": "CA", "EUROPE": "NY"}
    state = F.lit("GA")
    for key, name in states.items():
        state = F.when(F.col("r_name") == key, name).otherwise(state)
    cities = ["Boca Raton", "Delray Beach", "Jupiter", "Lake Worth"]
    city = F.col("n_name")
    for i, name in enumerate(cities):
        city = F.when(F.col("n_nationkey") % 6 == i, name).otherwise(city)
    zones = ["IL", "IP", "IG", "IND", "MUPD", "CG", "M-1", "M-2", "RS"]
    uses = ["WAREH/DIST TERM", "VACANT INDUSTRIAL", "HEAVY MFG", "LIGHT MFG", "OPEN STORAGE",
            "WORKING WATERFRONT", "INDUSTRIAL", "STORES"]
    line = F.col("l_linenumber")
    price_text = (
        F.when(line == 1, F.concat(F.lit("$"), F.col("l_quantity").cast("int").cast("string"), F.lit(",000")))
        .when(line == 2, "85%").when(line == 3, "(100)").when(line == 4, "N/A").when(line == 5, "")
        .when(line == 6, F.col("l_quantity").cast("int").cast("string"))
    )
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string")
    return base.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")],
                    cents).alias("rid"),
        F.concat(F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), F.lpad(F.col("l_partkey").cast("string"), 6, "0"),
                 F.lpad(line.cast("string"), 2, "0")).alias("parcel_id"),
        (F.col("l_orderkey") * 8 + line).cast("bigint").alias("row_pos"),
        F.concat_ws(" ", "p_name", "p_brand").alias("property_name"),
        property_type.alias("property_type"),
        (F.col("l_extendedprice") * 2).alias("building_sqft"),
        ((F.col("l_quantity") - 1) / 2.0).alias("lot_size_acres"),
        (F.lit(1960) + F.col("l_partkey") % 60).cast("int").alias("year_built"),
        (F.lit(100.0) - F.round(F.col("l_discount") * 100) * 2).alias("occupancy"),
        F.element_at(F.array(*[F.lit(z) for z in zones], F.lit(None)),
                     (F.col("l_suppkey") % 10 + 1).cast("int")).alias("zoning"),
        F.concat(F.col("l_partkey").cast("string"),
                 F.when(line % 3 == 0, " Main Street").when(line % 3 == 1, " Main St.").otherwise(" MAIN  ST")
                 ).alias("address"),
        city.alias("city"), F.col("r_name").alias("county"), state.alias("state"),
        F.col("s_name").alias("owner_name"),
        (F.col("o_totalprice") * 10).alias("improvement_value"),
        (F.col("l_extendedprice") * 20).alias("land_market_value"),
        (F.col("o_totalprice") * 10 + F.col("l_extendedprice") * 20).alias("market_value"),
        (F.col("o_totalprice") * 10).alias("sold_price"),
        F.col("o_orderdate").alias("sale_date"),
        F.element_at(F.array(*[F.lit(u) for u in uses]), (F.col("l_partkey") % 8 + 1).cast("int")).alias("property_use"),
        F.concat(F.lit("file_"), F.col("l_returnflag")).alias("source_file"),
        price_text.alias("price_text"),
    )


# DuckDB twin of :func:`props`, used as the prefix of the check queries.
PROPS_SQL = """
WITH props AS (
 SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(round(l_extendedprice*100) as bigint)) AS rid,
  lpad(cast(l_orderkey as varchar),9,'0') || lpad(cast(l_partkey as varchar),6,'0') || lpad(cast(l_linenumber as varchar),2,'0') AS parcel_id,
  cast(l_orderkey*8+l_linenumber as bigint) AS row_pos,
  p_name || ' ' || p_brand AS property_name,
  CASE p_type WHEN 'ECONOMY' THEN 'Flex Industrial' WHEN 'SMALL' THEN 'Warehouse' WHEN 'MEDIUM' THEN 'Distribution Center'
   WHEN 'PROMO' THEN 'Light Industrial' WHEN 'STANDARD' THEN 'Manufacturing' ELSE 'Office' END AS property_type,
  l_extendedprice*2 AS building_sqft, (l_quantity-1)/2.0 AS lot_size_acres, cast(1960 + l_partkey%60 as integer) AS year_built,
  100.0 - round(l_discount*100)*2 AS occupancy,
  CASE l_suppkey%10 WHEN 0 THEN 'IL' WHEN 1 THEN 'IP' WHEN 2 THEN 'IG' WHEN 3 THEN 'IND' WHEN 4 THEN 'MUPD' WHEN 5 THEN 'CG'
   WHEN 6 THEN 'M-1' WHEN 7 THEN 'M-2' WHEN 8 THEN 'RS' END AS zoning,
  cast(l_partkey as varchar) || CASE l_linenumber%3 WHEN 0 THEN ' Main Street' WHEN 1 THEN ' Main St.' ELSE ' MAIN  ST' END AS address,
  CASE n_nationkey%6 WHEN 0 THEN 'Boca Raton' WHEN 1 THEN 'Delray Beach' WHEN 2 THEN 'Jupiter' WHEN 3 THEN 'Lake Worth' ELSE n_name END AS city,
  r_name AS county,
  CASE r_name WHEN 'AFRICA' THEN 'FL' WHEN 'AMERICA' THEN 'TX' WHEN 'ASIA' THEN 'CA' WHEN 'EUROPE' THEN 'NY' ELSE 'GA' END AS state,
  s_name AS owner_name, o_totalprice*10 AS improvement_value, l_extendedprice*20 AS land_market_value,
  o_totalprice*10 + l_extendedprice*20 AS market_value, o_totalprice*10 AS sold_price, o_orderdate AS sale_date,
  CASE l_partkey%8 WHEN 0 THEN 'WAREH/DIST TERM' WHEN 1 THEN 'VACANT INDUSTRIAL' WHEN 2 THEN 'HEAVY MFG' WHEN 3 THEN 'LIGHT MFG'
   WHEN 4 THEN 'OPEN STORAGE' WHEN 5 THEN 'WORKING WATERFRONT' WHEN 6 THEN 'INDUSTRIAL' ELSE 'STORES' END AS property_use,
  'file_' || l_returnflag AS source_file,
  CASE l_linenumber WHEN 1 THEN '$' || cast(cast(l_quantity as int) as varchar) || ',000' WHEN 2 THEN '85%' WHEN 3 THEN '(100)'
   WHEN 4 THEN 'N/A' WHEN 5 THEN '' WHEN 6 THEN cast(cast(l_quantity as int) as varchar) END AS price_text
 FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey JOIN supplier ON l_suppkey=s_suppkey
  JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey
)
"""
