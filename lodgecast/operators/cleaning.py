"""Row filters, null rules and imputation."""

from collections.abc import Sequence
from datetime import date
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodgecast.functions.lookups import sized
from lodgecast.functions.quantiles import grouped_quantiles, quantile_array
from lodgecast.functions.scalars import is_finite, parse_day
from lodgecast.operators.features import add_features
from lodgecast.schema import DROPPED_COLUMNS, IQR_MULTIPLIER


def fill_review_rate(df: DataFrame) -> DataFrame:
    """A listing without a review rate has rate 0; a missing review day stays NULL."""
    return df.fillna({"reviews_per_month": 0.0})


def require_names(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["name", "host_name"])


def positive_price(df: DataFrame) -> DataFrame:
    return df.filter(F.col("price") > 0)


def zero_price(df: DataFrame) -> DataFrame:
    return df.filter(F.col("price") == 0)


def priced_listings(raw: DataFrame) -> DataFrame:
    """Rows in scope before the price cap."""
    return raw.transform(fill_review_rate).transform(require_names).transform(positive_price)


def price_cap(priced: DataFrame) -> DataFrame:
    """One row ``cap``: third quartile plus 1.5 interquartile ranges."""
    q = quantile_array(priced, "price", [0.25, 0.75])
    first, third = F.col("q")[0], F.col("q")[1]
    return q.select((third + F.lit(IQR_MULTIPLIER) * (third - first)).alias("cap"))


def capped_listings(raw: DataFrame, cap_from: DataFrame | None = None) -> DataFrame:
    """Rows in the mainstream price range.

    The cap comes from all priced rows, before any split; pass ``cap_from`` to take it from other
    rows, such as the training rows.
    """
    priced = priced_listings(raw)
    cap = price_cap(priced if cap_from is None else priced_listings(cap_from))
    # One number for the plan: whatever passes over the listings again does not look for the cap again.
    return priced.filter(F.col("price") <= F.lit(cap.first()["cap"]).cast("double"))


def numeric_columns(df: DataFrame, keep_out: Sequence[str] = ("id", "price")) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in keep_out]


def impute_medians(df: DataFrame, columns: Sequence[str] | None = None, holes: Sequence[str] | None = None) -> DataFrame:
    """Replace NULL by the column's median, as doubles.

    Only columns that have NULLs at all pay for a median: ``holes`` names them where that is known,
    otherwise one counting pass finds them.
    """
    if holes is None:
        columns = list(columns) if columns is not None else numeric_columns(df)
        counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
        holes = [c for c in columns if counts[c]]
    if not holes:
        return df
    medians = grouped_quantiles(df, [], {c: (c, 0.5) for c in holes}).first()
    known = {c: medians[c] for c in holes if medians[c] is not None}
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in known.items()})


class ListingFacts(NamedTuple):
    """What cleaning has to know about all priced rows before it can treat any of them."""

    cap: float | None
    latest_review: date | None
    holes: list[str]


def listing_facts(priced: DataFrame) -> ListingFacts:
    """Price cap, latest review day and columns with NULLs among the kept rows, from one pass.

    The pass keeps one row per price. The cap follows from the counts, and the other facts from the
    prices at or below it, so the listings are not read again.
    """
    numbers = [c for c in numeric_columns(priced) if c not in DROPPED_COLUMNS]
    by_price = priced.groupBy("price").agg(
        F.count(F.lit(1)).alias("n_value"),
        F.max(parse_day(F.col("last_review"))).alias("day"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in numbers],
    )
    by_price = sized(by_price)
    q = by_price.agg(F.percentile("price", F.array(F.lit(0.25), F.lit(0.75)), F.col("n_value")).alias("q")).first()["q"]
    if q is None:
        return ListingFacts(None, None, [])
    cap = q[1] + IQR_MULTIPLIER * (q[1] - q[0])
    row = by_price.filter(F.col("price") <= F.lit(cap)).agg(
        F.max("day").alias("day"), *[F.sum(f"null_{c}").alias(c) for c in numbers]
    ).first()
    return ListingFacts(cap, row["day"], [c for c in numbers if row[c]])


def clean_listings(raw: DataFrame) -> DataFrame:
    """The model table: cleaned, capped, with engineered features and without NULL numbers."""
    priced = priced_listings(raw)
    facts = listing_facts(priced)
    kept = priced.filter(F.col("price") <= F.lit(facts.cap).cast("double"))
    featured = add_features(kept, F.lit(facts.latest_review).cast("date")).drop(*DROPPED_COLUMNS)
    logs = {"minimum_nights": "log_minimum_nights", "calculated_host_listings_count": "log_host_listing_count"}
    holes = [*facts.holes, *[logs[c] for c in facts.holes if c in logs]]
    return impute_medians(featured, holes=holes)


def log_target(df: DataFrame) -> DataFrame:
    """Swap the price for its logarithm, the regression label."""
    return df.withColumn("label", F.log1p(F.col("price").cast("double"))).drop("price")


def finite_summary(df: DataFrame, column: str) -> DataFrame:
    """Rows, and rows whose value is missing, not a number or infinite."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~is_finite(F.col(column))).alias("not_finite"),
    )


def require_finite(df: DataFrame, column: str) -> DataFrame:
    """Pass rows through; a value that is missing or not finite fails the job."""
    bad = F.raise_error(F.lit(f"{column} has values that are not finite")).cast("double")
    return df.withColumn(column, F.when(is_finite(F.col(column)), F.col(column)).otherwise(bad))
