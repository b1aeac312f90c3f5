"""Ensembles over a long prediction table ``id, model, label, prediction``."""

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodgecast.functions.scalars import hash_uniform
from lodgecast.schema import ENSEMBLE_WINDOW


def prediction_columns(predictions: DataFrame, models: Sequence[str], keep: Sequence[str] = ("id", "label")) -> DataFrame:
    """One row per listing with a column per model; a listing without some model's prediction fails."""
    picks = [F.max(F.when(F.col("model") == m, F.col("prediction"))) for m in models]
    missing = F.raise_error(F.lit("a model has no prediction for some listing")).cast("double")
    return predictions.groupBy(*keep).agg(*[F.coalesce(p, missing).alias(m) for m, p in zip(models, picks)])


def candidates(scores: DataFrame, window: float = ENSEMBLE_WINDOW, at_least: int = 2) -> DataFrame:
    """Models within a relative window of the best score, or else the two best.

    ``scores`` has one row per model: ``model, position, cv_rmse_log``.
    """
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy("cv_rmse_log", "position"))
    near = (F.col("cv_rmse_log") <= F.col("best") * (1.0 + window)).cast("int")
    marked = (
        scores.withColumn("best", F.min("cv_rmse_log").over(everything))
        .withColumn("near", near)
        .withColumn("place", place)
        .withColumn("n_near", F.sum("near").over(everything))
    )
    chosen = ((F.col("n_near") >= at_least) & (F.col("near") == 1)) | (
        (F.col("n_near") < at_least) & (F.col("place") <= at_least)
    )
    return marked.filter(chosen).select("model", "position", "cv_rmse_log").orderBy("position")


def vote_equal(predictions: DataFrame) -> DataFrame:
    """Mean of the models' predictions per listing."""
    return predictions.groupBy("id").agg(F.first("label").alias("label"), F.avg("prediction").alias("prediction"))


def weight_shares(weights: Mapping[str, float]) -> dict[str, float]:
    """Weights as shares of one; all the same where no weight is above zero."""
    values = np.array([*weights.values()], dtype=float)
    shares = values / values.sum() if (values > 0).any() else np.full(len(values), 1.0 / len(values))
    return dict(zip(weights, shares.tolist()))


def weighted_sum(columns: Mapping[str, float]) -> Column:
    terms = [F.col(m) * F.lit(float(w)) for m, w in columns.items()]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def vote_weighted(predictions: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Weighted mean of the models' predictions per listing."""
    shares = weight_shares(weights)
    weight = F.lit(None).cast("double")
    for m, w in shares.items():
        weight = F.when(F.col("model") == m, F.lit(float(w))).otherwise(weight)
    chosen = predictions.filter(F.col("model").isin(*shares))
    return chosen.groupBy("id").agg(
        F.first("label").alias("label"), F.sum(weight * F.col("prediction")).alias("prediction")
    )


def weight_trials(spark, models: Sequence[str], trials: int, seed: int) -> DataFrame:
    """Seeded random weights in [0, 1): ``trial, model, weight``."""
    names = F.explode(F.array(*[F.lit(m) for m in models])).alias("model")
    drawn = spark.range(trials).select(F.col("id").cast("int").alias("trial"), names)
    return drawn.withColumn("weight", hash_uniform(F.concat_ws(":", F.col("trial").cast("string"), F.col("model")), seed))


def _normalised(trials: DataFrame) -> DataFrame:
    within = Window.partitionBy("trial")
    total = F.sum("weight").over(within)
    share = F.when(total > 0, F.col("weight") / total).otherwise(1.0 / F.count(F.lit(1)).over(within))
    return trials.withColumn("weight", share)


def weight_scores(columns: DataFrame, models: Sequence[str], trials: DataFrame, fold: str = "fold") -> DataFrame:
    """Cross-validated log RMSE of every weight trial, in a single pass over the predictions.

    Weights add up to one, so an ensemble's error is the weighted sum of the models' errors and its
    mean square follows from the mean products of those errors. The pass over the listings makes one
    small matrix per fold; trials only meet the matrix.
    """
    pairs = [(a, b) for a in models for b in models]
    error = {m: F.col(m) - F.col("label") for m in models}
    upper = {(a, b): F.avg(error[a] * error[b]) for i, a in enumerate(models) for b in list(models)[i:]}
    wide = columns.groupBy(fold).agg(*[v.alias(f"{a}|{b}") for (a, b), v in upper.items()])
    entries = [
        F.struct(
            F.lit(a).alias("a"),
            F.lit(b).alias("b"),
            F.col(f"`{a}|{b}`" if (a, b) in upper else f"`{b}|{a}`").alias("product"),
        )
        for a, b in pairs
    ]
    products = wide.select(fold, F.inline(F.array(*entries)))
    shares = _normalised(trials)
    first = shares.select("trial", F.col("model").alias("a"), F.col("weight").alias("wa"))
    second = shares.select("trial", F.col("model").alias("b"), F.col("weight").alias("wb"))
    by_fold = (
        products.join(first, "a")
        .join(second, ["trial", "b"])
        .groupBy("trial", fold)
        .agg(F.sqrt(F.greatest(F.sum(F.col("wa") * F.col("wb") * F.col("product")), F.lit(0.0))).alias("rmse_log"))
    )
    return by_fold.groupBy("trial").agg(F.avg("rmse_log").alias("cv_rmse_log")).orderBy("trial")


def best_so_far(trials: DataFrame) -> DataFrame:
    """Add the lowest score up to each trial; trials without a finite score do not count."""
    order = Window.partitionBy("model").orderBy("trial").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return trials.withColumn("best", F.min("value").over(order))
