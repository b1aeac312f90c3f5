"""Residuals in log and currency units, and their summaries by segment, band and decile."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgecast.functions.lookups import join_lookup, sized
from lodgecast.functions.quantiles import grouped_quantiles, with_bands
from lodgecast.operators.cleaning import require_finite

# Labels of the three-band report and texts of the band warning.
BAND_LABELS = ["Low", "Mid", "High"]
NO_BANDS_TEXT = "No price-band rows available for high-end compression check."
UNDERPREDICTED_TEXT = (
    "Top actual-price band is underpredicted: median predicted/actual ratio is %.3f, mean residual is $%,.2f."
)
NOT_UNDERPREDICTED_TEXT = "Top actual-price band does not show median underprediction in this run."


def residual_frame(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Add the ten error columns to rows that carry label and prediction on the log scale."""
    actual, predicted = F.col("actual_price"), F.col("predicted_price")
    safe = F.greatest(actual, F.lit(1.0))
    priced = scored.withColumns(
        {
            "actual_log_price": F.col(label).cast("double"),
            "predicted_log_price": F.col(prediction).cast("double"),
            "actual_price": F.expm1(F.col(label)),
            "predicted_price": F.expm1(F.col(prediction)),
        }
    ).transform(lambda df: require_finite(df, "predicted_price"))
    return (
        priced.withColumns(
            {
                "log_residual": F.col("actual_log_price") - F.col("predicted_log_price"),
                "dollar_residual": actual - predicted,
                "predicted_to_actual_ratio": predicted / safe,
            }
        )
        .withColumns(
            {
                "absolute_log_residual": F.abs("log_residual"),
                "absolute_error": F.abs("dollar_residual"),
                "absolute_percentage_error": F.abs("dollar_residual") / safe,
            }
        )
        .drop(*({label, prediction} - {"actual_log_price", "predicted_log_price"}))
    )


def _root_mean_square(column: str) -> Column:
    return F.sqrt(F.avg(F.col(column) * F.col(column)))


def _summary(frame: DataFrame, keys: Sequence[str], measures: dict[str, Column], medians: dict[str, str]) -> DataFrame:
    """Means in the first mergeable pass over the frame, exact medians in the second."""
    means = [F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in measures.items()]]
    wanted = {name: (column, 0.5) for name, column in medians.items()}
    return grouped_quantiles(frame.dropna(subset=list(keys)), keys, wanted, means)


def segment_summary(frame: DataFrame, column: str, min_rows: int = 30, extra_keys: Sequence[str] = ()) -> DataFrame:
    """Error size, bias and ratio per segment value, the worst first; small segments are left out."""
    keys = [*extra_keys, column]
    measures = {
        "mae": F.avg("absolute_error"),
        "rmse": _root_mean_square("dollar_residual"),
        "bias": F.avg("dollar_residual"),
        "log_rmse": _root_mean_square("log_residual"),
        "mean_abs_log_error": F.avg("absolute_log_residual"),
        "mape": F.avg("absolute_percentage_error"),
    }
    medians = {
        "actual_median": "actual_price",
        "predicted_median": "predicted_price",
        "prediction_ratio": "predicted_to_actual_ratio",
    }
    order = ["rows", "actual_median", "predicted_median", "mae", "rmse", "bias", "log_rmse", "mean_abs_log_error",
             "prediction_ratio", "mape"]
    summary = _summary(frame, keys, measures, medians).filter(F.col("rows") >= min_rows)
    rounded = summary.select(*keys, "rows", *[F.round(c, 3).alias(c) for c in order[1:]])
    return rounded.orderBy(F.desc("rmse"), *keys)


def price_band_summary(frame: DataFrame, bands: int = 5) -> DataFrame:
    """Segment summary over equal-count bands of the actual price: band number and its edges."""
    banded = with_bands(frame, "actual_price", bands).withColumn("band", F.struct("band", "band_lo", "band_hi"))
    banded = banded.filter(F.col("band.band").isNotNull())
    summary = segment_summary(banded, "band", min_rows=1)
    edges = [
        F.col("band.band").alias("band"),
        F.round("band.band_lo", 3).alias("band_lo"),
        F.round("band.band_hi", 3).alias("band_hi"),
    ]
    return summary.select(*edges, *[c for c in summary.columns if c != "band"])


def price_decile_summary(frame: DataFrame) -> DataFrame:
    """Calibration per decile of the actual price, in decile order."""
    banded = with_bands(frame, "actual_price", 10, "decile")
    measures = {
        "decile_lo": F.min("decile_lo"),
        "decile_hi": F.max("decile_hi"),
        "actual_mean": F.avg("actual_price"),
        "predicted_mean": F.avg("predicted_price"),
        "residual_mean": F.avg("dollar_residual"),
        "mae": F.avg("absolute_error"),
        "log_rmse": _root_mean_square("log_residual"),
        "mape": F.avg("absolute_percentage_error"),
    }
    summary = _summary(banded, ["decile"], measures, {"prediction_ratio_median": "predicted_to_actual_ratio"})
    rounded = [F.round(c, 3).alias(c) for c in [*measures, "prediction_ratio_median"]]
    return summary.select("decile", "rows", *rounded).orderBy("decile")


def band_warning(summary: DataFrame) -> DataFrame:
    """One row ``warning`` about the band with the highest actual median."""
    top = summary.agg(
        F.max_by(F.struct("bias", "prediction_ratio"), F.struct("actual_median", "band")).alias("top")
    )
    low = (F.col("top.bias") > 0) & (F.col("top.prediction_ratio") < 1)
    text = (
        F.when(F.col("top").isNull(), F.lit(NO_BANDS_TEXT))
        .when(low, F.format_string(UNDERPREDICTED_TEXT, F.col("top.prediction_ratio"), F.col("top.bias")))
        .otherwise(F.lit(NOT_UNDERPREDICTED_TEXT))
    )
    return top.select(text.alias("warning"))


def with_price_bands(frame: DataFrame) -> DataFrame:
    """Add ``price_band`` Low, Mid or High; equal edges are an error."""
    banded = with_bands(frame, "actual_price", len(BAND_LABELS), "__band", drop_equal=False)
    labels = F.array(*[F.lit(text) for text in BAND_LABELS])
    return banded.withColumn("price_band", F.get(labels, F.col("__band"))).drop("__band", "__band_lo", "__band_hi")


def band_mean_p90(frame: DataFrame) -> DataFrame:
    """Mean and 90th percentile of actual and predicted price; every band has its row, in order."""
    banded = with_price_bands(frame)
    means = [F.avg("actual_price").alias("actual_mean"), F.avg("predicted_price").alias("predicted_mean")]
    tails = {"actual_p90": ("actual_price", 0.9), "predicted_p90": ("predicted_price", 0.9)}
    found = grouped_quantiles(banded, ["price_band"], tails, means)
    order = F.posexplode(F.array(*[F.lit(text) for text in BAND_LABELS])).alias("band_order", "price_band")
    names = frame.sparkSession.range(1).select(order)
    joined = join_lookup(names, found, ["price_band"])
    values = ["actual_mean", "predicted_mean", "actual_p90", "predicted_p90"]
    return joined.orderBy("band_order").select("price_band", *[F.round(v, 3).alias(v) for v in values])


def band_series(summary: DataFrame, statistic: str) -> DataFrame:
    """Long form of one statistic of the three-band report: band, series (Actual, Predicted), price."""
    wide = summary.select(
        "price_band",
        F.col(f"actual_{statistic}").alias("Actual"),
        F.col(f"predicted_{statistic}").alias("Predicted"),
    )
    return wide.unpivot("price_band", ["Actual", "Predicted"], "series", "price")


def mispriced(frame: DataFrame, rows: int = 20) -> DataFrame:
    """The largest gaps in both directions; each side is a top-k that never sorts the table."""
    gap = F.col("predicted_price") - F.col("actual_price")
    gaps = with_price_bands(frame).select(
        "id",
        "price_band",
        "actual_price",
        "predicted_price",
        gap.alias("pricing_gap"),
        F.abs(gap).alias("absolute_gap"),
        F.when(F.col("actual_price") > 0, gap / F.col("actual_price") * 100).alias("percent_gap"),
    )
    under = gaps.orderBy(F.desc("pricing_gap"), "id").limit(rows)
    over = gaps.orderBy(F.asc("pricing_gap"), "id").limit(rows)
    both = under.withColumn("pricing_direction", F.lit("under_priced_candidate")).unionByName(
        over.withColumn("pricing_direction", F.lit("over_priced_candidate"))
    )
    return both.orderBy("pricing_direction", F.desc("absolute_gap"), "id")


def cached_frame(scored: DataFrame) -> DataFrame:
    """Residual frame kept for several summaries of the same predictions."""
    return sized(residual_frame(scored))
