import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodgecast import schema as S
from lodgecast.functions.scalars import clip, cut_label, round_coordinate
from lodgecast.operators.audit import price_cap_audit
from lodgecast.operators.cleaning import clean_listings, finite_summary, impute_medians, require_finite
from lodgecast.operators.features import review_recency

AUDIT_SCHEMA = (
    "id bigint, name string, host_name string, reviews_per_month double, last_review string, price bigint, "
    "neighbourhood_group string, room_type string"
)


def listing(i, price=100, **changes):
    row = {
        "id": i, "name": f"n{i}", "host_id": i, "host_name": "h", "neighbourhood_group": "Queens",
        "neighbourhood": "Astoria", "latitude": 40.7, "longitude": -73.9, "room_type": "Private room", "price": price,
        "minimum_nights": 2, "number_of_reviews": 3, "last_review": "2019-06-01", "reviews_per_month": 0.5,
        "calculated_host_listings_count": 1, "availability_365": 100,
    }
    row.update(changes)
    return row


def frame(spark, rows):
    return spark.createDataFrame([[r[f.name] for f in S.LISTING_SCHEMA] for r in rows], S.LISTING_SCHEMA)


def test_cap_audit(spark):
    rows = [(i, f"n{i}", "h", 1.0 if i else None, None, p, "Manhattan", "Private room")
            for i, p in enumerate([50, 60, 70, 80, 500])]
    audit = price_cap_audit(spark.createDataFrame(rows, AUDIT_SCHEMA))
    assert audit.upper_bound.first()["cap"] == 110.0
    scopes = {r["scope"]: r for r in audit.summary.collect()}
    left_out = scopes[S.SCOPE_EXCLUDED]
    assert (left_out["rows"], left_out["max_price"], left_out["share"]) == (1, 500.0, 0.2)
    assert scopes[S.SCOPE_INCLUDED]["median_price"] == 65.0
    segment = audit.excluded_by_segment.first()
    assert (segment["neighbourhood_group"], segment["rows"], segment["median_price"]) == ("Manhattan", 1, 500.0)


def test_cap_audit_keeps_empty_scopes(spark):
    rows = [(i, "n", "h", 1.0, None, 100, "Bronx", "Shared room") for i in range(4)]
    audit = price_cap_audit(spark.createDataFrame(rows, AUDIT_SCHEMA))
    scopes = {r["scope"]: r for r in audit.summary.collect()}
    assert scopes[S.SCOPE_EXCLUDED]["rows"] == 0 and scopes[S.SCOPE_EXCLUDED]["median_price"] is None
    assert audit.excluded_by_segment.count() == 0


def test_clean_listings_edge_rows(spark):
    rows = [listing(i, 100 + i) for i in range(20)]
    rows += [
        listing(100, name=None),
        listing(101, host_name=None),
        listing(102, price=0),
        listing(103, price=None),
        listing(104, price=100_000),
        listing(105, last_review="not a date", minimum_nights=0),
        listing(106, last_review=None, number_of_reviews=0, reviews_per_month=None, availability_365=None),
        listing(107, latitude=None, minimum_nights=None, neighbourhood_group=None),
    ]
    cleaned = {r["id"]: r for r in clean_listings(frame(spark, rows)).collect()}
    assert set(cleaned) == {*range(20), 105, 106, 107}
    assert cleaned[105]["days_since_last_review"] == 3650
    assert cleaned[105]["minimum_nights_bucket"] == "nan"
    assert cleaned[106]["reviews_per_month"] == 0.0 and cleaned[106]["availability_365"] == 100.0
    assert cleaned[106]["availability_bucket"] == "nan"
    assert cleaned[106]["room_type_availability_bucket"] == "Private room__nan"
    assert cleaned[107]["latitude"] == 40.7 and cleaned[107]["minimum_nights"] == 2.0
    assert cleaned[107]["log_minimum_nights"] == pytest.approx(math.log(3))
    assert cleaned[107]["geo_cell"] == "nan_-73.9" and cleaned[107]["is_long_stay"] == 0
    assert cleaned[107]["room_type_neighbourhood_group"] == "Private room__nan"
    assert set(cleaned[0].asDict()) == {
        "id", "price", *S.CATEGORICAL_FEATURES, *S.TARGET_ENCODED_FEATURES, *S.NUMERIC_FEATURES
    }


def test_clean_listings_without_priced_rows(spark):
    assert clean_listings(frame(spark, [listing(1, price=0)])).count() == 0


def test_recency_without_any_review_day(spark):
    rows = frame(spark, [listing(i, last_review=None) for i in range(3)])
    days = {r["days_since_last_review"] for r in review_recency(rows).collect()}
    assert days == {3650}


def test_impute_uses_the_midpoint(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 10.0), (4, 20.0), (5, None)], "id bigint, v double")
    assert impute_medians(rows).filter("id = 5").first()["v"] == 6.0


@pytest.mark.parametrize("value", [1.015, 40.645, -73.985, 40.0, -0.125, 12.345, 2.675])
def test_rounding_like_pandas(spark, value):
    got = spark.range(1).select(round_coordinate(F.lit(value))).first()[0]
    assert got == pd.Series([value]).round(2)[0]


def test_cut_like_pandas(spark):
    values = [-5.0, -1.0, 0.0, 1.0, 3.0, 30.0, 30.5, 365.0, 366.0, 4000.0, None]
    for edges, labels in (
        (S.RECENCY_EDGES, S.RECENCY_LABELS), (S.NIGHTS_EDGES, S.NIGHTS_LABELS),
        (S.AVAILABILITY_EDGES, S.AVAILABILITY_LABELS), (S.HOST_COUNT_EDGES, S.HOST_COUNT_LABELS),
    ):
        expected = pd.cut(pd.Series(values, dtype="float64"), bins=edges, labels=labels).astype(str).tolist()
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
        got = [r[0] for r in rows.orderBy("i").select(cut_label(F.col("v"), edges, labels)).collect()]
        assert got == expected


def test_clip_to_label_range(spark):
    rows = spark.createDataFrame([(100.0,), (1.0,), (3.0,), (None,)], "p double")
    assert [r[0] for r in rows.select(clip(F.col("p"), 2.0, 4.0)).collect()] == [4.0, 2.0, 3.0, None]


def test_finite_check(spark):
    rows = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "p double")
    assert tuple(finite_summary(rows, "p").first()) == (4, 3)
    with pytest.raises(Exception, match="not finite"):
        require_finite(rows, "p").collect()
