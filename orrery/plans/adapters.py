"""The supplied star schema in the shape of the two catalogs, and the same shape in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.rules import Rule

MONEY = "decimal(18,2)"
#: Providers by market segment: ordered rules as for vehicles.
SEGMENT_RULES = (Rule("Builders", ("build",)), Rule("Carriers", ("auto", "machin"), ("aut",)), Rule("Homes", ("household", "furn")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def launches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders and their customers as launches: a launch tag an order."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        F.col("o_orderkey").alias("launch_tag"),
        F.concat_ws(" ", "c_mktsegment", "o_orderpriority").alias("lv"),
        F.col("c_mktsegment").alias("lv_family"),
        F.col("o_orderpriority").alias("site"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("ldate"),
        F.col("o_orderstatus").isin("O", "F").alias("orbital"),
    )


def objects(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    """lineitem as objects; parts adds columns of `part`, `owner` (supplier, nation, region) and `launch`."""
    item = table(spark, sf_dir, "lineitem")
    mass = F.when(F.col("l_quantity") != 13, F.col("l_extendedprice").cast(MONEY))
    out = item.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("jcat"),
        F.col("l_orderkey").alias("launch_tag"),
        "l_partkey",
        "l_suppkey",
        F.col("l_linenumber").cast("long").alias("satno"),
        F.col("l_returnflag").alias("object_class"),
        F.col("l_linestatus").alias("sat_state"),
        mass.alias("mass_kg"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").cast(MONEY).alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_shipdate").alias("shipdate"),
        (F.col("l_discount") * 1000).alias("inc_deg"),
    )
    if "part" in parts:
        part = table(spark, sf_dir, "part")
        out = out.join(part, F.col("l_partkey") == F.col("p_partkey")).withColumnsRenamed({"p_name": "name", "p_type": "op_orbit", "p_brand": "pl_name"})
        out = out.withColumn("perigee_km", F.col("p_size") * 40).withColumn("apogee_km", F.col("p_size") * 50)
    if "owner" in parts:
        supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
        place = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        out = out.join(place.select("s_suppkey", F.col("n_name").alias("owner"), F.col("r_name").alias("state")), F.col("l_suppkey") == F.col("s_suppkey"))
    if "launch" in parts:
        out = out.join(launches(spark, sf_dir).select("launch_tag", "lv", "lv_family", "site", "ldate"), "launch_tag")
    return out


def decays() -> Column:
    return F.col("sat_state") == "F"


#: The same shape for the oracle: common table expressions `launches` and `objects`.
SQL = """
launches AS (
  SELECT o_orderkey AS launch_tag, c_mktsegment || ' ' || o_orderpriority AS lv, c_mktsegment AS lv_family, o_orderpriority AS site,
    strftime(o_orderdate, '%Y-%m-%d') AS ldate, o_orderstatus IN ('O', 'F') AS orbital
  FROM orders JOIN customer ON o_custkey = c_custkey),
objects AS (
  SELECT l_orderkey || '-' || l_linenumber AS jcat, l_orderkey AS launch_tag, l_linenumber::BIGINT AS satno, l_returnflag AS object_class, l_linestatus AS sat_state,
    CASE WHEN l_quantity <> 13 THEN l_extendedprice::DECIMAL(18,2) END AS mass_kg, l_quantity AS quantity, l_extendedprice::DECIMAL(18,2) AS price,
    l_discount AS discount, l_shipdate AS shipdate, l_discount * 1000 AS inc_deg, p_name AS name, p_type AS op_orbit, p_brand AS pl_name,
    p_size * 40 AS perigee_km, p_size * 50 AS apogee_km, n_name AS owner, r_name AS state, lv, lv_family, site, ldate
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey JOIN launches ON l_orderkey = launches.launch_tag)"""
SQL_PROVIDER = """CASE WHEN trim(lower(coalesce(lv_family, '') || ' ' || coalesce(lv, ''))) = '' THEN 'Unknown'
  WHEN contains(lower(lv_family || ' ' || lv), 'build') THEN 'Builders'
  WHEN contains(lower(lv_family || ' ' || lv), 'auto') OR contains(lower(lv_family || ' ' || lv), 'machin') OR starts_with(lower(lv_family || ' ' || lv), 'aut') THEN 'Carriers'
  WHEN contains(lower(lv_family || ' ' || lv), 'household') OR contains(lower(lv_family || ' ' || lv), 'furn') THEN 'Homes' ELSE 'Other' END"""
