"""Shared pieces of the check SQL."""

from propspark.plans.props import PROPS_SQL

SIZE_PTS = ("CASE WHEN building_sqft>=20000 AND building_sqft<50000 THEN 3.0 WHEN building_sqft>=50000 AND building_sqft<100000 "
            "THEN 2.0 WHEN building_sqft>=100000 AND building_sqft<200000 THEN 1.0 ELSE 0.0 END")
TYPE_PTS = ("CASE WHEN lower(property_type) LIKE '%flex%' THEN 3.0 WHEN lower(property_type) LIKE '%warehouse%' OR "
            "lower(property_type) LIKE '%distribution%' THEN 2.5 WHEN lower(property_type) LIKE '%light industrial%' THEN 2.0 "
            "WHEN lower(property_type) LIKE '%industrial%' THEN 1.5 WHEN lower(property_type) LIKE '%manufacturing%' THEN 1.0 "
            "ELSE 0.0 END")
LOT_PTS = ("CASE WHEN lot_size_acres BETWEEN 1 AND 5 THEN 2.0 WHEN lot_size_acres>5 AND lot_size_acres<=10 THEN 1.5 WHEN "
           "(lot_size_acres>=0.5 AND lot_size_acres<1) OR (lot_size_acres>10 AND lot_size_acres<=20) THEN 1.0 ELSE 0.0 END")
YEAR_PTS = "CASE WHEN year_built>=1990 THEN 1.0 WHEN year_built>=1980 THEN 0.5 ELSE 0.0 END"
OCC_PTS = "CASE WHEN (CASE WHEN occupancy>1 THEN occupancy/100 ELSE occupancy END)<1 THEN 1.0 ELSE 0.0 END"
FLEX = f"cast(least({SIZE_PTS}+{TYPE_PTS}+{LOT_PTS}+{YEAR_PTS}+{OCC_PTS},10.0) as double)"
INDUSTRIAL = "regexp_matches(lower(property_type),'industrial|warehouse|distribution|flex|manufacturing|storage|logistics')"
CANDIDATE = f"({INDUSTRIAL} AND building_sqft>=20000 AND lot_size_acres BETWEEN 0.5 AND 20)"

# props -> scored (all rows with flex_score) -> cand (the candidates)
SCORED_SQL = PROPS_SQL + f""", scored AS (SELECT *, {FLEX} AS flex_score FROM props)
, cand AS (SELECT * FROM scored WHERE {CANDIDATE})
"""

ZONING4 = ("CASE WHEN upper(zoning) IN ('IL','IP','PIPD','M-1') THEN 10.0 WHEN upper(zoning) IN ('IG','IND','M-2') THEN 8.0 "
           "WHEN upper(zoning) IN ('MUPD','MXPD','AGR/IND') THEN 6.0 WHEN upper(zoning) IN ('CG','CH','CS') THEN 4.0 ELSE 0.0 END")
SIZE4 = ("CASE WHEN lot_size_acres<=0 THEN 0.0 WHEN lot_size_acres<0.5 THEN 2.0 WHEN lot_size_acres>20 THEN 3.0 "
         "WHEN lot_size_acres<2.5 THEN 5+(lot_size_acres-0.5)/2.0*5 ELSE 5+(20-lot_size_acres)/17.5*5 END")
BUILD4 = "CASE WHEN improvement_value>100000 THEN 3.0 ELSE 0.0 END"
LOC4 = ("CASE WHEN regexp_matches(upper(city),'BOCA RATON|DELRAY BEACH|BOYNTON BEACH|WEST PALM BEACH') THEN 8.0 "
        "WHEN regexp_matches(upper(city),'LAKE WORTH|RIVIERA BEACH|JUPITER|WELLINGTON') THEN 7.0 ELSE 5.0 END")
ACT4 = "CASE WHEN datediff('day', cast(sale_date as date), DATE '2001-12-31')<=730 THEN 6.0 ELSE 5.0 END"
VALUE4 = ("5.0 + CASE WHEN land_market_value>0 AND improvement_value/land_market_value>1.5 THEN 2.0 "
          "WHEN land_market_value>0 AND improvement_value/land_market_value>0.5 THEN 1.0 ELSE 0.0 END "
          "+ CASE WHEN improvement_value BETWEEN 500000 AND 5000000 THEN 2.0 "
          "WHEN improvement_value>=250000 AND improvement_value<500000 THEN 1.0 ELSE 0.0 END")
WEIGHTED_SQL = PROPS_SQL + f""", parts AS (SELECT *, cast({ZONING4} as double) AS zoning_score, cast({SIZE4} as double) AS size_score,
 cast({BUILD4} as double) AS building_score, cast({LOC4} as double) AS location_score, cast({ACT4} as double) AS activity_score,
 cast({VALUE4} as double) AS value_score FROM props)
, weighted AS (SELECT *, round_even(least((zoning_score*3.0+size_score*2.0+building_score*2.5+location_score*1.5+activity_score*1.0
 +value_score*1.0)/11.0 + CASE WHEN zoning_score>=8 AND size_score>=7 THEN 0.5 ELSE 0.0 END
 + CASE WHEN building_score>=8 THEN 0.3 ELSE 0.0 END, 10.0),2) AS flex_score FROM parts)
"""
CLASS = ("CASE WHEN flex_score>=8 THEN 'PRIME_FLEX' WHEN flex_score>=6 THEN 'GOOD_FLEX' WHEN flex_score>=4 THEN 'POTENTIAL_FLEX' "
         "WHEN flex_score>=2 THEN 'POSSIBLE_FLEX' ELSE 'UNLIKELY_FLEX' END")


def pick(*names):
    return ", ".join(names)
