"""Offers derived from the given order tables: the frames that the registered queries run over.

An order line is an offer, its part the unit, its supplier the site, its order the time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.functions import numbers
from lodeframe.operators import grouping


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Narrow rows dealt evenly to twice as many tasks as there are cores: a table of few row groups is read by few tasks, which then do all dear work on its rows."""
    spark = rows.sparkSession
    return rows.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def listing_id():
    """Order, line, part and supplier in one number: lines of the test tables repeat within an order."""
    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return ((line * 1_000_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")).alias("listing_id")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line, keyed by listing_id."""
    part = F.col("l_partkey")
    line = F.col("l_linenumber")
    fee = F.when(F.col("l_discount") >= 0.01, F.floor(F.col("l_tax") * 100 + 0.5) * 1000)
    price = F.when(line != 7, F.floor("l_extendedprice"))
    codes = {
        "GAS_CITY": part % 5 == 0, "GAS_LPG": part % 7 == 0, "ALL_ELECTRIC": part % 13 == 0,
        "STOVE_IH": F.col("l_suppkey") % 3 == 0, "FEAT_A": F.col("l_returnflag") == "A", "FEAT_R": F.col("l_returnflag") == "R",
    }
    rows = table(spark, sf_dir, "lineitem").select(
        listing_id(),
        F.col("l_suppkey").alias("site_id"),
        (F.col("l_suppkey") % 4).alias("site_priority"),
        part.alias("unit_id"),
        F.col("l_orderkey").alias("order_id"),
        F.element_at(F.array(*map(F.lit, grouping.PARTS)), (part % 4 + 1).cast("int")).alias("property_family"),
        price.alias("price"),
        fee.alias("mgmt_fee_monthly"),
        numbers.rent_total(price, fee).alias("rent_total"),
        (F.col("l_quantity") + (part % 10) / 10.0).alias("area_sqm"),
        F.when(part % 9 != 0, F.col("l_quantity") * 3.0).alias("land_area_sqm"),
        F.when(part % 8 != 0, F.col("l_quantity") * 2.0).alias("building_area_sqm"),
        F.element_at(F.array(*map(F.lit, ("1R", "1K", "1LDK", "2LDK", "1SLDK"))), (part % 5 + 1).cast("int")).alias("layout"),
        F.when(line != 6, (F.col("l_suppkey") % 12 + 1).cast("int")).alias("floor_num"),
        (part % 40).cast("int").alias("age_years"),
        F.when(part % 11 != 0, (part % 25 + 1).cast("int")).alias("walk_minutes"),
        (F.col("l_linestatus") == "F").alias("detail_fetched"),
        F.when(part % 17 != 0, F.concat(F.lit("A"), (part % 20).cast("string"), F.lit("-"), (part % 3 + 1).cast("string"), F.lit("丁目"))).alias("address_normalized"),
        F.when(F.col("l_returnflag") == "R", "sold").otherwise("active").alias("status"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("first_seen"),
        F.date_format("l_shipdate", "yyyy-MM").alias("period"),
        F.array_compact(F.array(*(F.when(on, F.lit(code)) for code, on in sorted(codes.items())))).alias("feature_codes"),
    )
    return rows.withColumn("feature_count", F.size("feature_codes")).withColumn("dedup_key", grouping.dedup_key())


#: The same offers for DuckDB, as common table expressions.
LISTINGS_SQL = """
base AS (
    SELECT ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS listing_id, l_suppkey AS site_id, l_suppkey % 4 AS site_priority, l_partkey AS unit_id, l_orderkey AS order_id,
        CASE l_partkey % 4 WHEN 0 THEN 'CHINTAI' WHEN 1 THEN 'MANSION_BUY' WHEN 2 THEN 'KODATE_BUY' ELSE 'TOCHI_BUY' END AS property_family,
        CASE WHEN l_linenumber <> 7 THEN CAST(floor(l_extendedprice) AS BIGINT) END AS price,
        CASE WHEN l_discount >= 0.01 THEN CAST(floor(l_tax * 100 + 0.5) AS BIGINT) * 1000 END AS mgmt_fee_monthly,
        l_quantity + (l_partkey % 10) / 10.0 AS area_sqm,
        CASE WHEN l_partkey % 9 <> 0 THEN l_quantity * 3.0 END AS land_area_sqm,
        CASE WHEN l_partkey % 8 <> 0 THEN l_quantity * 2.0 END AS building_area_sqm,
        CASE l_partkey % 5 WHEN 0 THEN '1R' WHEN 1 THEN '1K' WHEN 2 THEN '1LDK' WHEN 3 THEN '2LDK' ELSE '1SLDK' END AS layout,
        CASE l_partkey % 5 WHEN 0 THEN '1R' WHEN 1 THEN '1K' WHEN 2 THEN '1LDK' WHEN 3 THEN '2LDK' ELSE '1LDK' END AS plain_layout,
        CASE WHEN l_linenumber <> 6 THEN CAST(l_suppkey % 12 + 1 AS INTEGER) END AS floor_num,
        CAST(l_partkey % 40 AS INTEGER) AS age_years,
        CASE WHEN l_partkey % 11 <> 0 THEN CAST(l_partkey % 25 + 1 AS INTEGER) END AS walk_minutes,
        l_linestatus = 'F' AS detail_fetched,
        CASE WHEN l_partkey % 17 <> 0 THEN 'A' || (l_partkey % 20) || '-' || (l_partkey % 3 + 1) || '丁目' END AS address_normalized,
        CASE WHEN l_returnflag = 'R' THEN 'sold' ELSE 'active' END AS status,
        strftime(l_shipdate, '%Y-%m-%d') AS first_seen, strftime(l_shipdate, '%Y-%m') AS period,
        l_partkey % 5 = 0 AS city_gas, l_partkey % 7 = 0 AS lpg, l_partkey % 13 = 0 AS electric, l_suppkey % 3 = 0 AS ih, l_returnflag = 'A' AS fa, l_returnflag = 'R' AS fr
    FROM lineitem
), keyed AS (
    SELECT *, CASE WHEN price IS NOT NULL THEN price + coalesce(mgmt_fee_monthly, 0) END AS rent_total,
        CAST(city_gas AS INT) + CAST(lpg AS INT) + CAST(electric AS INT) + CAST(ih AS INT) + CAST(fa AS INT) + CAST(fr AS INT) AS feature_count,
        CASE property_family
            WHEN 'KODATE_BUY' THEN 'v2|KODATE_BUY|' || address_normalized || '|' || CAST(CAST(land_area_sqm AS DECIMAL(20, 2)) AS VARCHAR) || '|' || CAST(CAST(building_area_sqm AS DECIMAL(20, 2)) AS VARCHAR) || '|' || plain_layout
            WHEN 'TOCHI_BUY' THEN 'v2|TOCHI_BUY|' || address_normalized || '|' || CAST(CAST(land_area_sqm AS DECIMAL(20, 2)) AS VARCHAR)
            ELSE 'v2|' || property_family || '|' || address_normalized || '|' || plain_layout || '|' || CAST(CAST(area_sqm AS DECIMAL(20, 2)) AS VARCHAR) || '|' || CAST(floor_num AS VARCHAR)
        END AS key_text FROM base
), listings AS (SELECT *, sha256(key_text) AS dedup_key FROM keyed)
"""
