"""Registered queries: every operator over whole tables, with values rounded for comparison."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgecast import schema as S
from lodgecast.functions.quantiles import grouped_quantiles, with_bands
from lodgecast.functions.scalars import clip, sorted_params_json
from lodgecast.functions.lookups import sized
from lodgecast.operators import audit, charts, cleaning, diagnostics, dummies, encoding, features, metrics, neighbours
from lodgecast.operators import profile, splits, voting
from lodgecast.plans import predictions as P
from lodgecast.sources.star import read_table, star_listings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Categories of the star-schema listings, used as column names.
ROOM_TYPES = ["F", "O", "P"]
BOROUGHS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
STATS_COLUMNS = ["price", "minimum_nights", "number_of_reviews", "availability_365"]
NULLABLE_COLUMNS = ["reviews_per_month", "minimum_nights", "number_of_reviews"]
SCALED_COLUMNS = ["minimum_nights", "number_of_reviews", "reviews_per_month", "availability_365"]
TRIAL_COUNT = 15


def register(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def raw(spark: SparkSession, folder: str) -> DataFrame:
    return star_listings(spark, folder)


def kept(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.capped_listings(raw(spark, folder))


def kept_columns(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """A few columns of the kept listings, held for queries that pass over them more than once."""
    return kept(spark, folder).select(*columns).persist()


def train_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Training rows with what the strata need, held because bands, allocation and sample all read them."""
    rows = P.labelled(raw(spark, folder)).filter("split = 'train'")
    return rows.select("id", "neighbourhood_group", "room_type", "price", "label").persist()


# --- cleaning and audit -------------------------------------------------------------------------


@register
def clean_nulls(spark, folder):
    filled = cleaning.fill_review_rate(raw(spark, folder))
    day = F.coalesce(F.col("last_review").cast("string"), F.lit(S.NO_REVIEW_TEXT))
    return filled.select("id", "reviews_per_month", day.alias("last_review"))


@register
def clean_required(spark, folder):
    return cleaning.priced_listings(raw(spark, folder)).select("id", "name", "host_name", "price")


@register
def iqr_cap_filter(spark, folder):
    return kept(spark, folder).select("id", "price")


@register
def clean_listings(spark, folder):
    cleaned = cleaning.clean_listings(raw(spark, folder))
    return rounded(cleaned, 9, "log_minimum_nights", "log_host_listing_count")


@register
def median_impute(spark, folder):
    rows = raw(spark, folder)
    holes = {c: F.when(F.col("number_of_reviews") > 0, F.col(c)) for c in ("minimum_nights", "number_of_reviews")}
    holed = rows.select("id", *NULLABLE_COLUMNS).withColumns(holes)
    return rounded(cleaning.impute_medians(holed, NULLABLE_COLUMNS), 6, *NULLABLE_COLUMNS)


@register
def zero_price_rows(spark, folder):
    return cleaning.zero_price(raw(spark, folder).transform(cleaning.require_names)).select("id", "host_id", "room_type", "price")


@register
def price_cap_audit(spark, folder):
    scopes = audit.cap_scopes(cleaning.priced_listings(raw(spark, folder)))
    return rounded(rounded(scopes, 6, "share"), 3, "median_price", "mean_price")


@register
def cap_excluded_by_segment(spark, folder):
    segments = audit.excluded_segments(cleaning.priced_listings(raw(spark, folder)))
    return rounded(segments, 3, "median_price", "mean_price")


@register
def price_quantiles(spark, folder):
    return rounded(audit.price_quantiles(cleaning.priced_listings(raw(spark, folder))), 4, "q1", "median", "q3", "p90")


@register
def event_value_quantiles(spark, folder):
    """Exact quantiles of a continuous, heavy-tailed column per group."""
    events = read_table(spark, folder, "events")
    wanted = {"q1": ("value", 0.25), "median": ("value", 0.5), "q3": ("value", 0.75), "p90": ("value", 0.9)}
    return rounded(grouped_quantiles(events, ["event_type"], wanted), 6, *wanted)


@register
def finite_check(spark, folder):
    scored = P.test_predictions(raw(spark, folder)).withColumn("predicted_price", F.expm1("prediction"))
    return cleaning.finite_summary(scored, "predicted_price")


# --- scalar expressions and features ------------------------------------------------------------


@register
def log_target(spark, folder):
    return rounded(cleaning.log_target(kept(spark, folder).select("id", "price")), 9, "label")


@register
def clip_bounds(spark, folder):
    customer = read_table(spark, folder, "customer")
    v = F.col("c_acctbal")
    return customer.select(
        F.col("c_custkey").alias("id"),
        clip(v, low=0.0).alias("at_least_zero"),
        clip(v, low=1.0).alias("at_least_one"),
        clip(v, low=100.0, high=5000.0).alias("both_sides"),
    )


@register
def geo_cell(spark, folder):
    return raw(spark, folder).select("id", features.geo_cell(F.col("latitude"), F.col("longitude")).alias("geo_cell"))


@register
def geo_points(spark, folder):
    return charts.geo_points(kept(spark, folder))


@register
def interaction_keys(spark, folder):
    keyed = raw(spark, folder).withColumns(features.bucket_columns())
    return keyed.select("id", *[c.alias(n) for n, c in features.interaction_columns().items()])


@register
def review_recency(spark, folder):
    recent = features.review_recency(kept(spark, folder))
    return recent.select("id", "days_since_last_review", "has_reviews", "review_recency_bucket")


@register
def review_recency_first_eda(spark, folder):
    recent = features.review_recency(kept(spark, folder), missing_days=S.NO_REVIEW_DAYS_FIRST_EDA)
    return recent.select("id", "days_since_last_review")


@register
def flags(spark, folder):
    return raw(spark, folder).select("id", *[c.alias(n) for n, c in features.flag_columns().items()])


@register
def cut_buckets(spark, folder):
    return raw(spark, folder).select("id", *[c.alias(n) for n, c in features.bucket_columns().items()])


@register
def engineered_features(spark, folder):
    featured = features.add_features(kept(spark, folder)).drop(*S.DROPPED_COLUMNS)
    return rounded(featured, 9, "log_minimum_nights", "log_host_listing_count")


@register
def params_json(spark, folder):
    events = read_table(spark, folder, "events")
    params = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("event_type"), F.col("event_type")))
    return events.select("event_id", sorted_params_json(params).alias("params_json"))


# --- samples, splits, joins ---------------------------------------------------------------------


@register
def hash_split(spark, folder):
    return splits.assign_split(kept(spark, folder)).select("id", "split")


@register
def hash_split_exact(spark, folder):
    return splits.assign_split_exact(kept_columns(spark, folder, "id")).select("id", "split")


@register
def kfold_assign(spark, folder):
    return splits.assign_folds(kept_columns(spark, folder, "id"))


@register
def fraction_sample(spark, folder):
    return splits.fraction_sample(kept_columns(spark, folder, "id", "price"))


@register
def stratified_alloc(spark, folder):
    return splits.allocate(splits.with_strata(train_rows(spark, folder)), S.LITE_ROWS)


@register
def stratified_sample(spark, folder):
    return splits.stratified_sample(train_rows(spark, folder)).select("id", "neighbourhood_group", "room_type", "price")


@register
def group_capped_sample(spark, folder):
    active = kept(spark, folder).filter(F.col("number_of_reviews") > 0)
    return splits.capped_sample(active, "room_type", 8000).select("id", "room_type")


@register
def semi_display_rows(spark, folder):
    rows = raw(spark, folder)
    return charts.display_rows(rows, cleaning.capped_listings(rows)).select(
        "id", "name", "host_name", "price", "reviews_per_month", "last_review"
    )


@register
def anti_unsampled(spark, folder):
    train = train_rows(spark, folder)
    sampled = splits.stratified_sample(train).select("id")
    return train.select("id", "price").join(sampled, "id", "left_anti")


# --- encoders -----------------------------------------------------------------------------------


@register
def target_mean_encode(spark, folder):
    rows = sized(P.labelled(raw(spark, folder)).select("id", P.KEY, "neighbourhood", "label", "split"))
    columns = ["neighbourhood", P.KEY]
    means = encoding.target_means(rows.filter("split = 'train'"), columns)
    encoded = encoding.encode_target_means(rows, means, columns)
    outputs = [f"{c}_target_mean" for c in columns]
    return rounded(encoded.select("id", *outputs), 6, *outputs)


@register
def target_mean_by_fold(spark, folder):
    train = P.labelled(raw(spark, folder)).filter("split = 'train'").select("id", "neighbourhood", "room_type", "label")
    means = encoding.target_means_by_fold(sized(splits.assign_folds(train)), ["neighbourhood", "room_type"], S.FOLDS)
    return rounded(means, 6, "target_mean")


@register
def dummies_drop_first(spark, folder):
    rows = kept(spark, folder).select("id", "room_type")
    return dummies.indicators(rows, "room_type", drop_first=True, values=ROOM_TYPES)


@register
def dummies_full(spark, folder):
    rows = kept(spark, folder).select("id", "room_type", "neighbourhood_group")
    rooms = dummies.indicators(rows, "room_type", "room", values=ROOM_TYPES)
    return dummies.indicators(rooms, "neighbourhood_group", "borough", values=BOROUGHS)


@register
def standard_scale(spark, folder):
    rows = kept_columns(spark, folder, "id", *SCALED_COLUMNS)
    return rounded(encoding.scale_columns(rows, SCALED_COLUMNS), 6, *SCALED_COLUMNS)


@register
def scale_no_mean(spark, folder):
    rows = kept_columns(spark, folder, "id", *SCALED_COLUMNS).select("*", F.lit(1.0).alias("constant"))
    columns = [*SCALED_COLUMNS, "constant"]
    return rounded(encoding.scale_columns(rows, columns, centre=False), 6, *columns)


# --- bands, residuals, scores -------------------------------------------------------------------


@register
def qcut_bands(spark, folder):
    rows = kept_columns(spark, folder, "id", "price")
    out = rows
    for bands in (3, 5, 10):
        out = with_bands(out, "price", bands, f"band{bands}")
    ends = [f"band{b}_{side}" for b in (3, 5, 10) for side in ("lo", "hi")]
    return rounded(out, 4, *ends)


def _frame(spark, folder, model: str = "tme") -> DataFrame:
    scored = P.test_predictions(raw(spark, folder)).filter(F.col("model") == model)
    return diagnostics.cached_frame(scored)


RESIDUAL_COLUMNS = [
    "actual_log_price", "predicted_log_price", "log_residual", "absolute_log_residual", "actual_price",
    "predicted_price", "dollar_residual", "absolute_error", "predicted_to_actual_ratio", "absolute_percentage_error",
]


@register
def residual_frame(spark, folder):
    frame = diagnostics.residual_frame(P.test_predictions(raw(spark, folder)))
    return rounded(frame.select("id", "model", *RESIDUAL_COLUMNS), 4, *RESIDUAL_COLUMNS)


@register
def segment_summary(spark, folder):
    frame = diagnostics.cached_frame(P.test_predictions(raw(spark, folder)))
    return diagnostics.segment_summary(frame, "room_type", extra_keys=["model"])


@register
def segment_summary_borough(spark, folder):
    return diagnostics.segment_summary(_frame(spark, folder), "neighbourhood_group")


@register
def price_band_summary(spark, folder):
    return diagnostics.price_band_summary(_frame(spark, folder))


@register
def price_decile_summary(spark, folder):
    return diagnostics.price_decile_summary(_frame(spark, folder))


@register
def band_warning(spark, folder):
    return diagnostics.band_warning(diagnostics.price_band_summary(_frame(spark, folder)))


@register
def band_mean_p90(spark, folder):
    return diagnostics.band_mean_p90(_frame(spark, folder))


@register
def band_unpivot(spark, folder):
    summary = diagnostics.band_mean_p90(_frame(spark, folder))
    parts = [diagnostics.band_series(summary, s).withColumn("statistic", F.lit(s)) for s in ("mean", "p90")]
    return parts[0].unionByName(parts[1])


@register
def scatter_by_band(spark, folder):
    banded = diagnostics.with_price_bands(_frame(spark, folder))
    return rounded(banded.select("id", "actual_price", "predicted_price", "price_band"), 3, "actual_price", "predicted_price")


@register
def mispriced_topk(spark, folder):
    values = ["actual_price", "predicted_price", "pricing_gap", "absolute_gap", "percent_gap"]
    return rounded(diagnostics.mispriced(_frame(spark, folder)), 3, *values)


@register
def dollar_metrics(spark, folder):
    scores = metrics.dollar_metrics(P.test_predictions(raw(spark, folder)), ["model"])
    return rounded(rounded(scores, 4, "mae", "rmse"), 6, "r2")


@register
def ols_single(spark, folder):
    train = P.labelled(raw(spark, folder)).filter("split = 'train'")
    fit = train.agg(
        F.regr_slope("label", "number_of_reviews").alias("slope"),
        F.regr_intercept("label", "number_of_reviews").alias("intercept"),
        F.regr_r2("label", "number_of_reviews").alias("r2"),
    )
    return rounded(fit, 8, "slope", "intercept", "r2")


# --- ensembles and trials -----------------------------------------------------------------------


@register
def vote_equal(spark, folder):
    return rounded(voting.vote_equal(P.test_predictions(raw(spark, folder))), 6, "label", "prediction")


@register
def vote_weighted(spark, folder):
    weights = {"tme": 3.0, "ols": 1.0, "mean": 0.5}
    return rounded(voting.vote_weighted(P.test_predictions(raw(spark, folder)), weights), 6, "label", "prediction")


def _weight_scores(spark, folder) -> DataFrame:
    columns = P.out_of_fold_columns(raw(spark, folder))
    return voting.weight_scores(columns, P.MODELS, voting.weight_trials(spark, P.MODELS, TRIAL_COUNT, S.SEED))


@register
def weight_search(spark, folder):
    return rounded(_weight_scores(spark, folder), 7, "cv_rmse_log")


@register
def trial_best_so_far(spark, folder):
    scores = rounded(_weight_scores(spark, folder), 7, "cv_rmse_log").withColumnRenamed("cv_rmse_log", "value")
    return voting.best_so_far(scores.withColumn("model", F.lit("VotingEnsembleWeighted")))


def _scores(spark, folder) -> DataFrame:
    oof = P.out_of_fold_predictions(raw(spark, folder))
    position = F.array_position(F.array(*[F.lit(m) for m in P.MODELS]), F.col("model")).cast("int")
    return metrics.cv_log_rmse(oof).withColumn("position", position)


@register
def cv_scores(spark, folder):
    return rounded(_scores(spark, folder), 7, "cv_rmse_log")


@register
def ensemble_candidates(spark, folder):
    return rounded(voting.candidates(_scores(spark, folder)), 7, "cv_rmse_log")


@register
def model_comparison(spark, folder):
    rows = raw(spark, folder)
    test = metrics.dollar_metrics(P.test_predictions(rows), ["model"])
    cv = metrics.cv_log_rmse(P.out_of_fold_predictions(rows))
    feature = F.when(F.col("model") == "tme", P.KEY).when(F.col("model") == "ols", "number_of_reviews").otherwise("none")
    params = F.create_map(F.lit("seed"), F.lit(str(S.SEED)), F.lit("feature"), feature)
    table = test.join(cv, "model").select(
        "model",
        F.round("cv_rmse_log", 6).alias("cv_rmse_log"),
        F.round("mae", 4).alias("test_mae_dollars"),
        F.round("rmse", 4).alias("test_rmse_dollars"),
        F.round("r2", 6).alias("test_r2"),
        sorted_params_json(params).alias("best_params_json"),
    )
    return table.orderBy("cv_rmse_log")


# --- charts and profiles ------------------------------------------------------------------------


@register
def top_hosts(spark, folder):
    return profile.top_counts(kept(spark, folder), "host_name", 10)


@register
def borough_share(spark, folder):
    return rounded(profile.value_share(kept(spark, folder), "neighbourhood_group"), 4, "percent")


@register
def min_nights_counts(spark, folder):
    return profile.counts_in_order(kept(spark, folder).filter(F.col("minimum_nights") <= 30), "minimum_nights")


@register
def price_by_room_type(spark, folder):
    return rounded(profile.price_by(kept(spark, folder), "room_type"), 3, "mean_price", "median_price")


@register
def price_by_borough(spark, folder):
    return rounded(profile.price_by(kept(spark, folder), "neighbourhood_group"), 3, "mean_price", "median_price")


@register
def room_by_borough(spark, folder):
    return profile.two_way_counts(kept(spark, folder), "neighbourhood_group", "room_type")


@register
def room_mix_share(spark, folder):
    return rounded(
        profile.two_way_share(kept(spark, folder), "neighbourhood_group", "room_type", ROOM_TYPES), 4, *ROOM_TYPES
    )


@register
def top_neighbourhoods(spark, folder):
    return rounded(profile.top_neighbourhoods(
        kept_columns(spark, folder, "id", "neighbourhood", "neighbourhood_group", "price")), 3, "median_price")


@register
def present_boroughs(spark, folder):
    rows = kept_columns(spark, folder, "id", "neighbourhood", "neighbourhood_group", "price")
    return profile.boroughs_of(rows, profile.top_neighbourhoods(rows))


@register
def review_activity(spark, folder):
    return rounded(charts.review_activity(kept(spark, folder)), 4, "reviews")


@register
def review_heatmap(spark, folder):
    heat = charts.activity_heatmap(charts.review_activity(kept(spark, folder)))
    return rounded(heat, 4, *[c for c in heat.columns if c != "year"])


@register
def ecdf_by_room(spark, folder):
    return rounded(charts.cumulative_points(kept(spark, folder), "room_type", "price"), 9, "cdf")


@register
def ecdf_steps(spark, folder):
    return charts.cumulative_steps(kept(spark, folder), "room_type", "price")


@register
def hist_equal_width(spark, folder):
    return rounded(charts.histogram(kept_columns(spark, folder, "price"), "price"), 4, "bin_lo", "bin_hi")


@register
def hist_log_price(spark, folder):
    rows = kept_columns(spark, folder, "price").select(F.log1p(F.col("price").cast("double")).alias("price_log"))
    return rounded(charts.histogram(rows, "price_log"), 6, "bin_lo", "bin_hi")


@register
def hist_log_width(spark, folder):
    return rounded(charts.log_histogram(kept_columns(spark, folder, "reviews_per_month"), "reviews_per_month"), 6, "bin_lo", "bin_hi", "median")


@register
def kde_by_room(spark, folder):
    return rounded(rounded(charts.density(kept(spark, folder), "room_type", "availability_365"), 6, "x"), 9, "density")


@register
def violin_density(spark, folder):
    curve = charts.density(kept(spark, folder), "neighbourhood_group", "price", points=100, cut=2.0)
    return rounded(rounded(curve, 3, "x"), 12, "density")


@register
def violin_quartiles(spark, folder):
    return rounded(charts.quartiles_by(kept(spark, folder), "neighbourhood_group", "price"), 3, "q1", "median", "q3")


@register
def box_stats(spark, folder):
    ends = ["q1", "median", "q3", "whisker_lo", "whisker_hi"]
    return rounded(charts.box_stats(kept(spark, folder), "room_type", "price"), 3, *ends)


@register
def describe_numeric(spark, folder):
    columns = [*STATS_COLUMNS, "reviews_per_month"]
    table = profile.describe(kept_columns(spark, folder, *columns), columns)
    return rounded(table, 4, "mean", "std", "min", "q25", "q50", "q75", "max")


@register
def null_counts(spark, folder):
    return profile.null_counts(raw(spark, folder))


@register
def profile_table(spark, folder):
    return profile.table_profile(raw(spark, folder))


@register
def first_rows(spark, folder):
    return profile.first_rows(raw(spark, folder))


@register
def corr_matrix(spark, folder):
    return rounded(profile.correlations(kept(spark, folder), STATS_COLUMNS), 6, "r")


@register
def corr_matrix_encoded(spark, folder):
    rows = features.review_recency(kept(spark, folder), missing_days=S.NO_REVIEW_DAYS_FIRST_EDA)
    rows = rows.withColumn("price_log", F.log1p(F.col("price").cast("double")))
    columns = ["price_log", "minimum_nights", "number_of_reviews", "calculated_host_listings_count",
               "availability_365", "days_since_last_review"]
    marked = dummies.indicators(rows, "room_type", "room", values=ROOM_TYPES)
    return rounded(profile.correlations(marked, [*columns, *[f"room_{r}" for r in ROOM_TYPES]]), 6, "r")


@register
def geo_density(spark, folder):
    return charts.geo_density(kept(spark, folder))


@register
def jitter_points(spark, folder):
    return rounded(charts.price_review_points(kept(spark, folder), room_types=ROOM_TYPES), 4, "x", "y")


# --- nearest neighbours -------------------------------------------------------------------------


def _embedding_neighbours(spark, folder, k: int) -> DataFrame:
    table = read_table(spark, folder, "embeddings").repartition(spark.sparkContext.defaultParallelism, "vec_id")
    found = neighbours.nearest_neighbours(table, table, k + 1, "vec_id", "vec_id", "embedding")
    return neighbours.without_self(found, k)


@register
def knn_exact(spark, folder):
    return rounded(_embedding_neighbours(spark, folder, 5), 6, "distance")


@register
def knn_uniform(spark, folder):
    return rounded(neighbours.neighbour_regression(_embedding_neighbours(spark, folder, 10), 10), 6, "prediction")


@register
def knn_distance_weighted(spark, folder):
    found = _embedding_neighbours(spark, folder, 10)
    return rounded(neighbours.neighbour_regression(found, 10, "distance"), 6, "prediction")
