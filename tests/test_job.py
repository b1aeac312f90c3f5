import math

import pandas as pd
import pytest

from lodgecast.plans.job import Settings, run
from lodgecast.sources.star import star_listings
from lodgecast.sources.tables import load_checkpoint, read_listings_csv, results_table, write_report

OVERRIDES = {
    "ElasticNet": {"alpha": 0.01},
    "KNN": {"n_neighbors": 9},
    "RandomForest": {"n_estimators": 5, "max_depth": 4},
}


def test_job_runs_reports_and_resumes(spark, small, tmp_path):
    raw = star_listings(spark, small)
    settings = Settings(
        lite_rows=200,
        overrides=OVERRIDES,
        models=list(OVERRIDES),
        output_csv=f"file://{tmp_path}/new/metrics.csv",
        model_folder=f"file://{tmp_path}/models",
        columns={"categorical": ["room_type"], "target_encoded": ["neighbourhood"]},
    )
    lines = []
    results = run(raw, settings, "small", lines.append)
    names = [*OVERRIDES, "VotingEnsembleEqual", "VotingEnsembleWeighted", "StackingEnsemble"]
    assert [r.name for r in results] == names
    assert all(math.isfinite(r.cv_rmse_log) and r.metrics["rmse"] >= r.metrics["mae"] for r in results)
    report = pd.concat(pd.read_csv(p) for p in (tmp_path / "new" / "metrics.csv").glob("*.csv"))
    assert report["model"].tolist() == names
    assert any("trial 1 of 1" in line for line in lines)

    settings.resume = True
    lines.clear()
    again = run(raw, settings, "small", lines.append)
    assert sum("Loaded checkpoint" in line for line in lines) == len(names)
    assert [(r.name, r.cv_rmse_log, r.params) for r in again] == [(r.name, r.cv_rmse_log, r.params) for r in results]
    context = {"mode": "lite", "source": "small", "train_rows": 200, "test_rows": 1, "trial_count": 2}
    assert load_checkpoint(spark, settings.model_folder, "ElasticNet", context) is None
    assert load_checkpoint(spark, settings.model_folder, "Nothing", context) is None


def test_settings_are_checked(spark, small):
    raw = star_listings(spark, small)
    with pytest.raises(ValueError, match="model folder"):
        run(raw, Settings(resume=True))
    with pytest.raises(ValueError, match="positive"):
        run(raw, Settings(lite_rows=0))
    assert Settings(mode="full").trial_count("XGBoost") == 45
    assert Settings(mode="sample", trials={"KNN": 2}).trial_count("KNN") == 2


class Result:
    name, cv_rmse_log, params, metrics = "SVM", 0.4187516, {"epsilon": 0.375}, {"mae": 31.5, "rmse": 47.25, "r2": 0.61}


def test_report_rounds_and_makes_its_folder(spark, tmp_path):
    write_report(results_table(spark, [Result]), f"file://{tmp_path}/nested/deeper/metrics.csv")
    row = pd.concat(pd.read_csv(p) for p in (tmp_path / "nested" / "deeper" / "metrics.csv").glob("*.csv")).iloc[0]
    assert (row["model"], row["cv_rmse_log"], row["best_params_json"]) == ("SVM", 0.418752, '{"epsilon": 0.375}')


def test_csv_with_breaks_quotes_and_missing_texts(spark, tmp_path):
    text = (
        "id,name,host_id,host_name,neighbourhood_group,neighbourhood,latitude,longitude,room_type,price,minimum_nights,"
        "number_of_reviews,last_review,reviews_per_month,calculated_host_listings_count,availability_365\n"
        '1,"two\nlines, ""quoted""",7,Ann,Queens,Astoria,40.7,-73.9,Private room,100,2,3,2019-06-01,0.5,1,365\n'
        "2,NA,8,null,Bronx,nan,40.8,-73.8,Shared room,oops,1,0,,,1,0\n"
    )
    (tmp_path / "l.csv").write_text(text)
    rows = {r["id"]: r for r in read_listings_csv(spark, f"file://{tmp_path}/l.csv").collect()}
    assert rows[1]["name"] == 'two\nlines, "quoted"' and rows[1]["price"] == 100
    assert rows[2]["name"] is None and rows[2]["host_name"] is None and rows[2]["neighbourhood"] is None
    assert rows[2]["price"] is None and rows[2]["reviews_per_month"] is None and rows[2]["availability_365"] == 0
