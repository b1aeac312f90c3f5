import numpy as np
import pytest

from lodgecast.operators import voting
from lodgecast.operators.metrics import cv_log_rmse


def predictions(spark, n=40):
    random = np.random.default_rng(2)
    label = random.normal(4, 1, n)
    models = {"a": label + random.normal(0, 0.3, n), "b": label + random.normal(0.2, 0.2, n)}
    rows = [(i, i % 5, float(label[i]), m, float(p[i])) for m, p in models.items() for i in range(n)]
    return label, models, spark.createDataFrame(rows, "id int, fold int, label double, model string, prediction double")


def scores(spark, *values):
    rows = [(f"m{i}", i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "model string, position int, cv_rmse_log double")


def test_candidates(spark):
    names = lambda df: [r["model"] for r in df.collect()]
    assert names(voting.candidates(scores(spark, 1.0, 1.02, 1.5))) == ["m0", "m1"]
    assert names(voting.candidates(scores(spark, 2.0, 1.0, 1.5))) == ["m1", "m2"]
    assert names(voting.candidates(scores(spark, 1.01, 1.02, 1.0))) == ["m0", "m1", "m2"]
    assert names(voting.candidates(scores(spark, 1.0, float("inf"), 1.5))) == ["m0", "m2"]


def test_votes(spark):
    label, models, table = predictions(spark)
    equal = voting.vote_equal(table).orderBy("id").toPandas()["prediction"]
    np.testing.assert_allclose(equal, (models["a"] + models["b"]) / 2)
    weighted = voting.vote_weighted(table, {"a": 3.0, "b": 1.0}).orderBy("id").toPandas()["prediction"]
    np.testing.assert_allclose(weighted, 0.75 * models["a"] + 0.25 * models["b"])
    assert voting.weight_shares({"a": 0.0, "b": 0.0, "c": 0.0, "d": 0.0}) == dict.fromkeys("abcd", 0.25)
    assert voting.weight_shares({"a": 6.0, "b": 2.0}) == {"a": 0.75, "b": 0.25}


def test_weight_scores_equal_scoring_each_trial(spark):
    label, models, table = predictions(spark)
    columns = voting.prediction_columns(table, ["a", "b"], ("id", "fold", "label"))
    trials = spark.createDataFrame([(0, "a", 0.0), (0, "b", 0.0), (1, "a", 3.0), (1, "b", 1.0)], "trial int, model string, weight double")
    got = {r["trial"]: r["cv_rmse_log"] for r in voting.weight_scores(columns, ["a", "b"], trials).collect()}
    fold = np.arange(len(label)) % 5
    for trial, w in {0: 0.5, 1: 0.75}.items():
        error = w * models["a"] + (1 - w) * models["b"] - label
        assert got[trial] == pytest.approx(np.mean([np.sqrt((error[fold == f] ** 2).mean()) for f in range(5)]))


def test_a_missing_prediction_fails(spark):
    _, _, table = predictions(spark)
    with pytest.raises(Exception, match="no prediction"):
        voting.prediction_columns(table.filter("not (id = 3 and model = 'b')"), ["a", "b"]).collect()


def test_cv_score_is_the_mean_of_folds(spark):
    label, models, table = predictions(spark)
    got = {r["model"]: r["cv_rmse_log"] for r in cv_log_rmse(table).collect()}
    fold = np.arange(len(label)) % 5
    expected = np.mean([np.sqrt(((models["a"] - label)[fold == f] ** 2).mean()) for f in range(5)])
    assert got["a"] == pytest.approx(expected)


def test_best_so_far_skips_failed_trials(spark):
    rows = [("m", k, v) for k, v in enumerate([None, 0.9, 0.4, 0.7, None, 0.3])] + [("n", 0, 5.0)]
    found = voting.best_so_far(spark.createDataFrame(rows, "model string, trial int, value double"))
    best = {(r["model"], r["trial"]): r["best"] for r in found.collect()}
    assert [best["m", k] for k in range(6)] == [None, 0.9, 0.4, 0.4, 0.4, 0.3]
    assert best["n", 0] == 5.0
