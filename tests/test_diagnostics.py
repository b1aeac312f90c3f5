import numpy as np
import pytest

from lodgecast.operators import diagnostics as D
from lodgecast.operators.metrics import align_predictions, check_log_scale, dollar_metrics


def scored(spark, actual, predicted, room=None):
    rows = [
        (i, room[i] if room else "A", float(np.log1p(a)), float(np.log1p(p)))
        for i, (a, p) in enumerate(zip(actual, predicted))
    ]
    return spark.createDataFrame(rows, "id bigint, room_type string, label double, prediction double")


def test_residual_columns(spark):
    actual, predicted = np.array([40.0, 64.0, 250.0]), np.array([50.0, 16.0, 250.0])
    rows = D.residual_frame(scored(spark, actual, predicted)).orderBy("id").toPandas()
    np.testing.assert_allclose(rows["dollar_residual"], actual - predicted, atol=1e-9)
    np.testing.assert_allclose(rows["absolute_error"], abs(actual - predicted), atol=1e-9)
    np.testing.assert_allclose(rows["predicted_to_actual_ratio"], predicted / actual)
    np.testing.assert_allclose(rows["absolute_percentage_error"], abs(actual - predicted) / actual, atol=1e-9)
    np.testing.assert_allclose(rows["log_residual"], np.log((1 + actual) / (1 + predicted)), atol=1e-12)


def test_bands_and_warning(spark):
    actual, predicted = np.array([20.0, 30, 40, 60, 80, 400]), np.array([22.0, 27, 44, 54, 88, 160])
    frame = D.residual_frame(scored(spark, actual, predicted))
    found = {r["band"]: r for r in D.price_band_summary(frame, 3).collect()}
    assert {k: r["rows"] for k, r in found.items()} == {0: 2, 1: 2, 2: 2}
    error = np.log1p(actual) - np.log1p(predicted)
    for k, r in found.items():
        own = slice(2 * k, 2 * k + 2)
        # The summary is rounded for the report.
        assert r["log_rmse"] == pytest.approx(np.sqrt((error[own] ** 2).mean()), abs=1e-3)
        assert r["mean_abs_log_error"] == pytest.approx(abs(error[own]).mean(), abs=1e-3)
    # The widest gap is in the last band, where predictions stay behind by (240 - 8) / 2.
    warning = D.band_warning(D.price_band_summary(frame, 3)).first()["warning"]
    assert "underpredicted" in warning and "$116.00" in warning


def test_warning_texts(spark):
    over = D.residual_frame(scored(spark, [50.0, 75, 100, 200], [55.0, 80, 120, 240]))
    assert D.band_warning(D.price_band_summary(over, 2)).first()["warning"] == D.NOT_UNDERPREDICTED_TEXT
    flat = D.residual_frame(scored(spark, [50.0, 50.0], [55.0, 70.0]))
    assert D.band_warning(D.price_band_summary(flat, 2)).first()["warning"] == D.NO_BANDS_TEXT


def test_deciles(spark):
    """Three rows to a decile; the middle one has the decile's median ratio."""
    actual = 10.0 + np.arange(30.0)
    ratio = np.tile([0.5, 1.25, 2.0], 10)
    summary = D.price_decile_summary(D.residual_frame(scored(spark, actual, actual * ratio))).toPandas()
    assert len(summary) == 10
    np.testing.assert_allclose(summary["prediction_ratio_median"], 1.25)


def test_segments_hide_small_groups_and_sort_by_rmse(spark):
    room = ["A"] * 30 + ["B"] * 29 + ["C"] * 31
    actual = [100.0] * 90
    predicted = [90.0] * 30 + [10.0] * 29 + [50.0] * 31
    summary = D.segment_summary(D.residual_frame(scored(spark, actual, predicted, room)), "room_type").collect()
    assert [(r["room_type"], r["rows"], r["rmse"]) for r in summary] == [("C", 31, 50.0), ("A", 30, 10.0)]


def test_mispriced_ties_take_the_lower_id(spark):
    prices = [(0, 10.0, 20.0), (1, 20.0, 30.0), (2, 30.0, 40.0), (3, 40.0, 30.0), (4, 50.0, 40.0), (5, 60.0, 50.0)]
    frame = spark.createDataFrame(prices, "id bigint, actual_price double, predicted_price double")
    rows = D.mispriced(frame, 2).collect()
    assert [(r["pricing_direction"][:4], r["id"]) for r in rows] == [("over", 3), ("over", 4), ("unde", 0), ("unde", 1)]


def test_metrics_of_constant_labels(spark):
    exact = dollar_metrics(scored(spark, [100.0, 100.0], [100.0, 100.0])).first()
    wrong = dollar_metrics(scored(spark, [100.0, 100.0], [90.0, 110.0])).first()
    assert (exact["r2"], wrong["r2"]) == (1.0, 0.0)
    assert wrong["mae"] == pytest.approx(10.0) and wrong["rmse"] == pytest.approx(10.0)


def test_not_finite_predictions_fail(spark):
    rows = spark.createDataFrame([(1, 1.0, 2000.0)], "id int, label double, prediction double")
    with pytest.raises(Exception, match="not finite"):
        dollar_metrics(rows).collect()


def test_alignment_and_scale_checks(spark):
    labels = spark.createDataFrame([(1, 2.0), (2, 3.0)], "id int, label double")
    assert align_predictions(labels, labels.selectExpr("id", "label as prediction")).count() == 2
    with pytest.raises(Exception, match="same rows"):
        align_predictions(labels, labels.filter("id = 1").selectExpr("id", "label as prediction")).collect()
    assert check_log_scale(labels.selectExpr("label as prediction")) == 2.0
    with pytest.raises(ValueError):
        check_log_scale(labels.selectExpr("label * 100 as prediction"))
