"""Predictions simple enough for SQL to repeat: target mean, one-feature least squares, overall mean."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgecast import schema as S
from lodgecast.functions.lookups import join_lookup, sized
from lodgecast.operators.cleaning import capped_listings
from lodgecast.operators.encoding import encode_target_means, target_means, target_means_by_fold
from lodgecast.operators.features import interaction_columns
from lodgecast.operators.splits import assign_folds, assign_split

KEY = "room_type_neighbourhood"
MODELS = ["tme", "ols", "mean"]


def labelled(raw: DataFrame) -> DataFrame:
    """Capped listings with label, split and the one category key the predictions need."""
    kept = capped_listings(raw).withColumn("label", F.log1p(F.col("price").cast("double")))
    return assign_split(kept).withColumn(KEY, interaction_columns()[KEY])


def _long(wide: DataFrame, keep: list[str]) -> DataFrame:
    entries = [F.struct(F.lit(m).alias("model"), F.col(m).alias("prediction")) for m in MODELS]
    return wide.select(*keep, F.inline(F.array(*entries)))


def _line(x: Column, slope: Column, intercept: Column) -> Column:
    return intercept + slope * x


def test_predictions(raw: DataFrame) -> DataFrame:
    """Long prediction table of the test rows; everything is fitted on the training rows."""
    rows = labelled(raw).select("id", "neighbourhood_group", "room_type", KEY, "number_of_reviews", "price", "label", "split")
    rows = sized(rows)
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'").drop("split")
    line = train.agg(
        F.struct(
            F.regr_slope("label", "number_of_reviews").alias("slope"),
            F.regr_intercept("label", "number_of_reviews").alias("intercept"),
            F.avg("label").alias("mean"),
        )
    ).scalar()
    encoded = encode_target_means(test, target_means(train, [KEY]), [KEY], "_m").withColumn("__fit", line)
    wide = encoded.withColumns(
        {
            "tme": F.col(f"{KEY}_m"),
            "ols": _line(F.col("number_of_reviews"), F.col("__fit.slope"), F.col("__fit.intercept")),
            "mean": F.col("__fit.mean"),
        }
    )
    return _long(wide, ["id", "neighbourhood_group", "room_type", "price", "label"])


def out_of_fold_columns(raw: DataFrame, folds: int = S.FOLDS) -> DataFrame:
    """Training rows with fold, label and each model's out-of-fold prediction as a column.

    Means and lines of all training sides come from one pass each, not from one pass per fold.
    """
    # Held, since finding where the folds start passes over the rows twice before they are read.
    rows = sized(labelled(raw).filter("split = 'train'").select("id", KEY, "number_of_reviews", "label"))
    train = sized(assign_folds(rows, folds))
    means = sized(
        target_means_by_fold(train, [KEY], folds).select("fold", F.col("category").alias(KEY), F.col("target_mean").alias("m"))
    )
    sides = []
    for f in range(folds):
        y, x = F.when(F.col("fold") != f, F.col("label")), F.when(F.col("fold") != f, F.col("number_of_reviews"))
        sides.append(
            F.struct(
                F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.avg(y).alias("mean")
            )
        )
    lines = train.agg(F.array(*sides)).scalar()
    fitted = join_lookup(train, means, ["fold", KEY]).withColumn("__fit", lines).withColumn("__fit", F.get("__fit", F.col("fold")))
    return fitted.select(
        "id",
        "fold",
        "label",
        F.coalesce("m", F.col("__fit.mean")).alias("tme"),
        _line(F.col("number_of_reviews"), F.col("__fit.slope"), F.col("__fit.intercept")).alias("ols"),
        F.col("__fit.mean").alias("mean"),
    )


def out_of_fold_predictions(raw: DataFrame, folds: int = S.FOLDS) -> DataFrame:
    return _long(out_of_fold_columns(raw, folds), ["id", "fold", "label"])
