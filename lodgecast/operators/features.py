"""Engineered listing features: one projection and one scalar subquery for the latest review day."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgecast import schema as S
from lodgecast.functions.scalars import (
    clip,
    cut_label,
    flag,
    joined_key,
    parse_day,
    round_coordinate,
    text_or_missing,
)


def recency_columns(latest: Column, missing_days: int = S.NO_REVIEW_DAYS) -> dict[str, Column]:
    """Days since the last review, counted from the latest day seen, with flag and bucket."""
    since = clip(F.datediff(latest, parse_day(F.col("last_review"))), low=0)
    days = F.coalesce(since, F.lit(missing_days))
    return {
        "days_since_last_review": days,
        "has_reviews": flag(F.col("number_of_reviews") > 0),
        "review_recency_bucket": cut_label(days, S.RECENCY_EDGES, S.RECENCY_LABELS),
    }


def latest_review(df: DataFrame) -> Column:
    """Latest review day of a table, as a scalar subquery."""
    return df.agg(F.max(parse_day(F.col("last_review")))).scalar()


def review_recency(df: DataFrame, latest: Column | None = None, missing_days: int = S.NO_REVIEW_DAYS) -> DataFrame:
    """Add the recency columns; without a latest day given, the rows' own latest day counts."""
    return df.withColumns(recency_columns(latest_review(df) if latest is None else latest, missing_days))


def geo_cell(latitude: Column, longitude: Column) -> Column:
    return F.concat_ws(
        "_", text_or_missing(round_coordinate(latitude)), text_or_missing(round_coordinate(longitude))
    )


def bucket_columns() -> dict[str, Column]:
    nights, hosted = F.col("minimum_nights"), F.col("calculated_host_listings_count")
    return {
        "minimum_nights_bucket": cut_label(nights, S.NIGHTS_EDGES, S.NIGHTS_LABELS),
        "availability_bucket": cut_label(F.col("availability_365"), S.AVAILABILITY_EDGES, S.AVAILABILITY_LABELS),
        "host_listing_count_bucket": cut_label(hosted, S.HOST_COUNT_EDGES, S.HOST_COUNT_LABELS),
    }


def flag_columns() -> dict[str, Column]:
    return {
        "has_reviews": flag(F.col("number_of_reviews") > 0),
        "is_long_stay": flag(F.col("minimum_nights") >= S.LONG_STAY_NIGHTS),
        "is_professional_host": flag(F.col("calculated_host_listings_count") > 1),
    }


def interaction_columns() -> dict[str, Column]:
    room = F.col("room_type")
    return {
        f"room_type_{other}": joined_key(room, F.col(other))
        for other in ("neighbourhood_group", "availability_bucket", "minimum_nights_bucket", "neighbourhood")
    }


def add_features(df: DataFrame, latest: Column | None = None) -> DataFrame:
    """All engineered columns; interaction keys build on the buckets of the same projection."""
    nights, hosted = F.col("minimum_nights"), F.col("calculated_host_listings_count")
    return (
        review_recency(df, latest)
        .withColumns(
            {
                **bucket_columns(),
                **flag_columns(),
                "log_minimum_nights": F.log1p(nights.cast("double")),
                "log_host_listing_count": F.log1p(hosted.cast("double")),
                "geo_cell": geo_cell(F.col("latitude"), F.col("longitude")),
            }
        )
        .withColumns(interaction_columns())
    )
