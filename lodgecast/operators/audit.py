"""What the price cap keeps and what it leaves out."""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgecast import schema as S
from lodgecast.functions.quantiles import grouped_quantiles, value_counts
from lodgecast.operators.cleaning import price_cap, priced_listings


class PriceCapAudit(NamedTuple):
    upper_bound: DataFrame
    summary: DataFrame
    excluded_by_segment: DataFrame


def cap_scopes(priced: DataFrame) -> DataFrame:
    """Three scope rows: before the cap, kept, left out. An empty scope keeps its row, with NULLs.

    The listings are read once, as counts per price; cap, medians and totals all follow from those.
    """
    counts = value_counts(priced, [], "price")
    quartiles = counts.agg(F.percentile("price", F.array(F.lit(0.25), F.lit(0.75)), F.col("n_value")).alias("q"))
    first, third = F.col("q")[0], F.col("q")[1]
    cap = quartiles.select(third + F.lit(S.IQR_MULTIPLIER) * (third - first)).scalar()
    scopes = [S.SCOPE_BEFORE, S.SCOPE_INCLUDED, S.SCOPE_EXCLUDED]
    side = F.when(F.col("price") <= F.col("cap"), F.lit(S.SCOPE_INCLUDED)).otherwise(F.lit(S.SCOPE_EXCLUDED))
    tagged = counts.withColumn("cap", cap).select(
        "price", "n_value", F.explode(F.array(F.lit(S.SCOPE_BEFORE), side)).alias("scope")
    )
    n, price = F.col("n_value"), F.col("price")
    measured = tagged.groupBy("scope").agg(
        F.sum(n).alias("rows"),
        F.min(price).cast("double").alias("min_price"),
        F.percentile(price, F.lit(0.5), n).alias("median_price"),
        (F.sum(price * n) / F.sum(n)).alias("mean_price"),
        F.max(price).cast("double").alias("max_price"),
    )
    spark = priced.sparkSession
    all_scopes = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in scopes])).alias("scope"))
    total = counts.agg(F.sum("n_value")).scalar()
    rows = F.coalesce("rows", F.lit(0))
    return all_scopes.join(measured, "scope", "left").select(
        "scope",
        rows.alias("rows"),
        (rows / total).alias("share"),
        "min_price",
        "median_price",
        "mean_price",
        "max_price",
    )


def excluded_segments(priced: DataFrame) -> DataFrame:
    """Rows above the cap by borough and room type, the largest segment first."""
    keys = ["neighbourhood_group", "room_type"]
    cap = F.lit(price_cap(priced).first()["cap"]).cast("double")
    above = value_counts(priced.filter(F.col("price") > cap), keys, "price")
    n, price = F.col("n_value"), F.col("price")
    return (
        above.groupBy(*keys)
        .agg(
            F.sum(n).alias("rows"),
            F.percentile(price, F.lit(0.5), n).alias("median_price"),
            (F.sum(price * n) / F.sum(n)).alias("mean_price"),
        )
        .orderBy(F.desc("rows"), *keys)
    )


def price_cap_audit(raw: DataFrame) -> PriceCapAudit:
    priced = priced_listings(raw)
    return PriceCapAudit(price_cap(priced), cap_scopes(priced), excluded_segments(priced))


def price_quantiles(priced: DataFrame) -> DataFrame:
    """Quartiles and 90th percentile of the price."""
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75, "p90": 0.9}
    return grouped_quantiles(priced, [], {name: ("price", p) for name, p in probs.items()})
