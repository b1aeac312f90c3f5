"""Residual diagnostics of a saved model: load it, score the test rows, write the summaries and the mispriced listings.

    python -m lodgecast.plans.diagnose --csv listings.csv --model-folder models --model RandomForest --output reports
"""

import argparse

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgecast.functions.stored import stored
from lodgecast.learning.features import prepare
from lodgecast.operators import diagnostics
from lodgecast.operators.cleaning import clean_listings, log_target
from lodgecast.operators.metrics import align_predictions
from lodgecast.operators.splits import assign_split
from lodgecast.sources.tables import read_listings, read_metadata, write_report

MISPRICED_VALUES = ["actual_price", "predicted_price", "pricing_gap", "absolute_gap", "percent_gap"]


def test_rows(raw: DataFrame) -> DataFrame:
    """Prepared test rows of a listing table, split as the training job splits them."""
    rows = assign_split(log_target(clean_listings(raw)))
    return prepare(rows).filter("split = 'test'").drop("split")


def residuals(pipeline: PipelineModel, rows: DataFrame) -> DataFrame:
    """Residual frame of a fitted pipeline; a row without prediction, or a prediction without row, fails the job."""
    labels = rows.select("id", "label", "neighbourhood_group", "room_type")
    return diagnostics.residual_frame(align_predictions(labels, pipeline.transform(rows).select("id", "prediction")))


def mispriced_report(frame: DataFrame) -> DataFrame:
    return diagnostics.mispriced(frame).withColumns({c: F.round(c, 3) for c in MISPRICED_VALUES})


def reports(frame: DataFrame) -> dict[str, DataFrame]:
    """Report tables by name."""
    bands = diagnostics.price_band_summary(frame)
    return {
        "boroughs": diagnostics.segment_summary(frame, "neighbourhood_group"),
        "room_types": diagnostics.segment_summary(frame, "room_type"),
        "price_bands": bands,
        "deciles": diagnostics.price_decile_summary(frame),
        "band_mean_p90": diagnostics.band_mean_p90(frame),
        "warning": diagnostics.band_warning(bands),
        "mispriced": mispriced_report(frame),
    }


def diagnose(pipeline: PipelineModel, rows: DataFrame, folder: str) -> list[str]:
    """Write every report as one small CSV below ``folder``; the paths."""
    # All reports read the frame, so the model scores the rows once.
    frame = stored(residuals(pipeline, rows), "residuals")
    paths = []
    for name, table in reports(frame).items():
        paths.append(f"{folder}/{name}.csv")
        write_report(table, paths[-1])
    return paths


def main() -> None:
    arguments = argparse.ArgumentParser(description=__doc__)
    arguments.add_argument("--csv", required=True, help="listing file or folder")
    arguments.add_argument("--format", default="csv", help="csv, or any format Spark reads")
    arguments.add_argument("--model-folder", required=True)
    arguments.add_argument("--model", required=True, help="name of a finished stage")
    arguments.add_argument("--output", required=True, help="folder of the reports")
    given = arguments.parse_args()
    spark = SparkSession.builder.appName("lodgecast").getOrCreate()
    saved = read_metadata(spark, given.model_folder, given.model).first()
    if saved is None:
        raise ValueError(f"no finished stage {given.model} in {given.model_folder}")
    rows = test_rows(read_listings(spark, given.csv, given.format))
    for path in diagnose(PipelineModel.load(saved["artifact"]), rows, given.output):
        print(path)


if __name__ == "__main__":
    main()
