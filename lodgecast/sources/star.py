"""Listing table derived from the star-schema tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def star_listings(spark: SparkSession, folder: str) -> DataFrame:
    """Each order seen as a listing: its customer is the host, its lines are the reviews.

    Listings per host are counted before the join, so a host with very many listings is never
    gathered in one window; lines are aggregated on the order key before they meet the orders.
    """
    orders = read_table(spark, folder, "orders")
    customer = read_table(spark, folder, "customer")
    nation = read_table(spark, folder, "nation")
    region = read_table(spark, folder, "region")
    lines = (
        read_table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("l_quantity").cast("int").alias("min_nights"),
            # Prices are positive: half up, without a detour through decimals.
            F.sum(F.floor(F.col("l_extendedprice") + 0.5)).alias("price"),
        )
    )
    owned = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("owned"))
    hosts = (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .join(owned, customer.c_custkey == owned.o_custkey)
        .select("c_custkey", "c_name", "n_name", "r_name", "owned")
    )
    key = F.col("o_orderkey")
    n = F.col("n")
    return (
        orders.join(hosts, orders.o_custkey == hosts.c_custkey)
        .join(lines, key == F.col("l_orderkey"), "left")
        .select(
            key.alias("id"),
            F.when(key % 50 != 7, F.concat(F.lit("listing "), key.cast("string"))).alias("name"),
            F.col("c_custkey").alias("host_id"),
            F.col("c_name").alias("host_name"),
            F.col("r_name").alias("neighbourhood_group"),
            F.col("n_name").alias("neighbourhood"),
            (F.lit(40.5) + (key % 420) / F.lit(1000.0)).alias("latitude"),
            (F.lit(-74.25) + (F.col("c_custkey") % 540) / F.lit(1000.0)).alias("longitude"),
            F.col("o_orderstatus").alias("room_type"),
            F.coalesce("price", F.lit(0)).cast("bigint").alias("price"),
            F.coalesce("min_nights", F.lit(1)).cast("int").alias("minimum_nights"),
            F.coalesce(n, F.lit(0)).cast("bigint").alias("number_of_reviews"),
            F.when(n.isNotNull(), F.col("o_orderdate").cast("date")).alias("last_review"),
            F.round(n / F.lit(7.0), 2).alias("reviews_per_month"),
            F.col("owned").alias("calculated_host_listings_count"),
            (key % 366).cast("int").alias("availability_365"),
        )
    )
