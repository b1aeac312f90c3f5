"""Diagnostics of a saved model as a run."""

import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from lodgecast.plans import diagnose
from lodgecast.sources.star import star_listings


def test_reports_of_a_saved_model(spark, small, tmp_path):
    rows = diagnose.test_rows(star_listings(spark, small)).persist()
    stages = [VectorAssembler(inputCols=["number_of_reviews", "minimum_nights"], outputCol="features"), LinearRegression()]
    Pipeline(stages=stages).fit(rows).write().save(f"{tmp_path}/model")
    paths = diagnose.diagnose(PipelineModel.load(f"{tmp_path}/model"), rows, f"file://{tmp_path}/reports")
    read = {p.rsplit("/", 1)[1]: pd.concat(map(pd.read_csv, (tmp_path / "reports" / p.rsplit("/", 1)[1]).glob("*.csv"))) for p in paths}
    assert len(read) == 7 and read["deciles.csv"]["rows"].sum() == read["room_types.csv"]["rows"].sum() == rows.count()
    worst = read["mispriced.csv"]
    assert len(worst) == 40 and set(worst["pricing_direction"]) == {"under_priced_candidate", "over_priced_candidate"}
    gap = worst["predicted_price"] - worst["actual_price"]
    assert (abs(gap - worst["pricing_gap"]) < 0.01).all() and read["warning.csv"]["warning"].str.len().min() > 20


def test_a_missing_prediction_fails(spark):
    class Forgetful:
        def transform(self, rows):
            return rows.filter("id <> 2").withColumn("prediction", F.lit(4.0))

    rows = spark.createDataFrame([(i, 4.5, "Q", "P") for i in range(4)], "id long, label double, neighbourhood_group string, room_type string")
    with pytest.raises(Exception, match="not the same rows"):
        diagnose.residuals(Forgetful(), rows).collect()
