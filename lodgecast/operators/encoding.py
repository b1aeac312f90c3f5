"""Smoothed target means and scaling as plain DataFrame steps."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgecast.functions.lookups import join_lookup, sized
from lodgecast.schema import SMOOTHING


def _smoothed(total: Column, rows: Column, overall: Column, smoothing: float) -> Column:
    return (total + overall * smoothing) / (rows + smoothing)


def target_means(train: DataFrame, columns: Sequence[str], label: str = "label", smoothing: float = SMOOTHING) -> DataFrame:
    """Per feature and category: rows and label mean pulled toward the overall mean.

    All features are counted in one pass over the rows. A missing category is a category of its own.
    The row with feature ``*`` holds the overall mean, which unseen categories get.
    """
    entries = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category")) for c in columns]
    overall_entry = F.struct(F.lit("*").alias("feature"), F.lit(None).cast("string").alias("category"))
    sums = sized(
        train.select(F.explode(F.array(overall_entry, *entries)).alias("e"), F.col(label).alias("y"))
        .groupBy("e.feature", "e.category")
        .agg(F.sum("y").alias("total"), F.count("y").alias("rows"))
    )
    overall = sums.filter(F.col("feature") == "*").select(F.col("total") / F.col("rows")).first()[0]
    whole = F.col("feature") == "*"
    mean = F.when(whole, F.col("total") / F.col("rows")).otherwise(
        _smoothed(F.col("total"), F.col("rows"), F.lit(overall), smoothing)
    )
    return sums.select("feature", "category", "rows", mean.alias("target_mean"))


def encode_target_means(df: DataFrame, means: DataFrame, columns: Sequence[str], suffix: str = "_target_mean") -> DataFrame:
    """Add each feature's target mean; categories the means do not know get the overall mean."""
    means = sized(means)
    overall = means.filter(F.col("feature") == "*").first()["target_mean"]
    encoded = df
    for c in columns:
        own = means.filter(F.col("feature") == c)
        own = own.select(F.col("category").alias(c), F.col("target_mean").alias(f"{c}{suffix}"))
        encoded = join_lookup(encoded, own, [c])
    return encoded.withColumns({f"{c}{suffix}": F.coalesce(F.col(f"{c}{suffix}"), F.lit(overall)) for c in columns})


def target_means_by_fold(df: DataFrame, columns: Sequence[str], folds: int, label: str = "label",
                         fold: str = "fold", smoothing: float = SMOOTHING) -> DataFrame:
    """Target means of every training side of a cross-validation, from one pass.

    Sums per (feature, category, held-out fold) are enough: the training side of a fold is the total
    minus the fold's own sums.
    """
    entries = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category")) for c in columns]
    overall_entry = F.struct(F.lit("*").alias("feature"), F.lit(None).cast("string").alias("category"))
    by_fold = df.select(
        F.explode(F.array(overall_entry, *entries)).alias("e"), F.col(fold).alias("f"), F.col(label).alias("y")
    ).groupBy("e.feature", "e.category", "f").agg(F.sum("y").alias("total"), F.count("y").alias("rows"))
    sides = by_fold.select(
        "feature", "category", "total", "rows", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias(fold), "f"
    ).filter(F.col("f") != F.col(fold))
    sums = sized(sides.groupBy(fold, "feature", "category").agg(F.sum("total").alias("total"), F.sum("rows").alias("rows")))
    overall = sums.filter(F.col("feature") == "*").select(fold, (F.col("total") / F.col("rows")).alias("overall"))
    joined = sums.filter(F.col("feature") != "*").join(overall, fold)
    mean = _smoothed(F.col("total"), F.col("rows"), F.col("overall"), smoothing)
    return joined.select(fold, "feature", "category", "rows", mean.alias("target_mean"))


def scale_columns(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None, centre: bool = True) -> DataFrame:
    """Divide by the population deviation, after centring if asked; a constant column is not divided."""
    fitted = df if fit_on is None else fit_on
    parts = [F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns]
    one = fitted.agg(*parts).select(F.struct(*columns).alias("p")).scalar()
    marked = df.withColumn("__p", one)
    scaled = {}
    for c in columns:
        spread = F.when(F.col("__p")[c]["s"] > 0, F.col("__p")[c]["s"]).otherwise(F.lit(1.0))
        shift = F.col("__p")[c]["m"] if centre else F.lit(0.0)
        scaled[c] = (F.col(c) - shift) / spread
    return marked.withColumns(scaled).drop("__p")
