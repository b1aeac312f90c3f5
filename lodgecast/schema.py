"""Column names, types and constants shared by every stage."""

from pyspark.sql import types as T

LISTING_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("host_id", T.LongType()),
        T.StructField("host_name", T.StringType()),
        T.StructField("neighbourhood_group", T.StringType()),
        T.StructField("neighbourhood", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("room_type", T.StringType()),
        T.StructField("price", T.LongType()),
        T.StructField("minimum_nights", T.IntegerType()),
        T.StructField("number_of_reviews", T.LongType()),
        T.StructField("last_review", T.StringType()),
        T.StructField("reviews_per_month", T.DoubleType()),
        T.StructField("calculated_host_listings_count", T.LongType()),
        T.StructField("availability_365", T.IntegerType()),
    ]
)

# Column roles.
DROPPED_COLUMNS = ["name", "host_id", "host_name", "last_review"]
CATEGORICAL_FEATURES = [
    "neighbourhood_group",
    "neighbourhood",
    "room_type",
    "availability_bucket",
    "minimum_nights_bucket",
    "host_listing_count_bucket",
    "review_recency_bucket",
    "geo_cell",
    "room_type_neighbourhood_group",
    "room_type_availability_bucket",
    "room_type_minimum_nights_bucket",
]
TARGET_ENCODED_FEATURES = [
    "neighbourhood",
    "geo_cell",
    "room_type_neighbourhood_group",
    "room_type_neighbourhood",
]
NUMERIC_FEATURES = [
    "latitude",
    "longitude",
    "minimum_nights",
    "log_minimum_nights",
    "number_of_reviews",
    "reviews_per_month",
    "calculated_host_listings_count",
    "log_host_listing_count",
    "is_professional_host",
    "availability_365",
    "has_reviews",
    "days_since_last_review",
    "is_long_stay",
]

# Bucket edges (right-closed) and their labels.
RECENCY_EDGES = [-1, 30, 180, 365, 3651]
RECENCY_LABELS = ["last_30_days", "last_6_months", "last_year", "older_or_none"]
NIGHTS_EDGES = [0, 1, 3, 7, 30, float("inf")]
NIGHTS_LABELS = ["one_night", "two_to_three", "four_to_seven", "eight_to_thirty", "over_thirty"]
AVAILABILITY_EDGES = [-1, 0, 30, 180, 365]
AVAILABILITY_LABELS = ["unavailable", "low", "seasonal", "high"]
HOST_COUNT_EDGES = [0, 1, 5, 20, float("inf")]
HOST_COUNT_LABELS = ["single_listing", "small_portfolio", "medium_portfolio", "large_portfolio"]
NO_REVIEW_DAYS = 3650
NO_REVIEW_DAYS_FIRST_EDA = 9999
NO_REVIEW_TEXT = "No reviews"
MISSING_TEXT = "nan"
LONG_STAY_NIGHTS = 30
IQR_MULTIPLIER = 1.5

# Scope names of the price-cap audit.
SCOPE_BEFORE = "positive_price_rows_before_cap"
SCOPE_INCLUDED = "included_after_iqr_cap"
SCOPE_EXCLUDED = "excluded_above_iqr_cap"

# Splitting, folds, sampling and smoothing.
SEED = 42
TEST_SHARE = 0.2
FOLDS = 5
SMOOTHING = 10.0
LITE_ROWS = 800
SAMPLE_SHARE = 0.35
ENSEMBLE_WINDOW = 0.03

# Tuning budget per model and mode.
TRIALS = {
    "lite": {"ElasticNet": 1, "KNN": 1, "XGBoost": 1, "SVM": 1, "NeuralNetwork": 1, "RandomForest": 1,
             "VotingEnsembleWeighted": 1},
    "sample": {"ElasticNet": 10, "KNN": 6, "XGBoost": 14, "SVM": 8, "NeuralNetwork": 8, "RandomForest": 10,
               "VotingEnsembleWeighted": 15},
    "full": {"ElasticNet": 35, "KNN": 30, "XGBoost": 45, "SVM": 8, "NeuralNetwork": 25, "RandomForest": 35,
             "VotingEnsembleWeighted": 35},
}
