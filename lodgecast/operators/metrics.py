"""Scores in currency units, from labels and predictions on the log scale."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgecast.operators.cleaning import require_finite

# Range of a median prediction on the log scale that makes sense for a nightly price.
LOG_SCALE_RANGE = (2.0, 7.0)


def align_predictions(labels: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Labels and predictions of the same rows; a row on one side only fails the job."""
    left = labels.withColumn("__l", F.lit(True))
    right = predictions.withColumn("__r", F.lit(True))
    unmatched = F.raise_error(F.lit("labels and predictions are not the same rows")).cast("boolean")
    both = F.when(F.col("__l") & F.col("__r"), F.lit(True)).otherwise(unmatched)
    return left.join(right, key, "full").filter(both).drop("__l", "__r")


def dollar_metrics(scored: DataFrame, by: Sequence[str] = (), label: str = "label", prediction: str = "prediction") -> DataFrame:
    """MAE, RMSE and R2 in one mergeable pass, for all rows or per group."""
    priced = scored.select(
        *by,
        F.expm1(label).alias("actual"),
        F.expm1(prediction).alias("predicted_price"),
    ).transform(lambda df: require_finite(df, "predicted_price"))
    error = F.col("actual") - F.col("predicted_price")
    sums = priced.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.sum(error * error).alias("residual"),
        (F.var_pop("actual") * F.count(F.lit(1))).alias("spread"),
    )
    r2 = (
        F.when(F.col("spread") > 0, 1 - F.col("residual") / F.col("spread"))
        .when(F.col("residual") == 0, F.lit(1.0))
        .otherwise(F.lit(0.0))
    )
    broken = F.raise_error(F.lit("RMSE must not be below MAE")).cast("double")
    rmse = F.when(F.col("rmse") + 1e-12 * F.greatest(F.col("mae"), F.lit(1.0)) < F.col("mae"), broken)
    return sums.select(*by, "rows", "mae", rmse.otherwise(F.col("rmse")).alias("rmse"), r2.alias("r2"))


def log_rmse(scored: DataFrame, by: Sequence[str] = (), label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Root mean square error on the log scale."""
    error = F.col(label) - F.col(prediction)
    return scored.groupBy(*by).agg(F.sqrt(F.avg(error * error)).alias("rmse_log"))


def cv_log_rmse(scored: DataFrame, by: Sequence[str] = ("model",), fold: str = "fold") -> DataFrame:
    """Mean of the folds' log RMSE."""
    return log_rmse(scored, [*by, fold]).groupBy(*by).agg(F.avg("rmse_log").alias("cv_rmse_log"))


def check_log_scale(scored: DataFrame, prediction: str = "prediction", allowed: tuple[float, float] = LOG_SCALE_RANGE) -> float:
    """Median prediction; raises when it cannot be the logarithm of a nightly price.

    A sketch is enough here: the allowed range is far wider than its rank error.
    """
    middle = scored.agg(F.percentile_approx(prediction, 0.5).alias("m")).first()["m"]
    low, high = allowed
    if middle is None or not low <= middle <= high:
        raise ValueError(f"predictions are not on the log1p scale: median {middle}")
    return middle
