"""Voting and stacking of fitted pipelines."""

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import combinations

from pyspark.ml import Model, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgecast import schema as S
from lodgecast.learning.features import feature_pipeline
from lodgecast.learning.regressors import SCALED_MODELS, build, ridge
from lodgecast.learning.search import Tuned, out_of_fold_table, test_metrics, written
from lodgecast.learning.tables import TableState
from lodgecast.operators.metrics import cv_log_rmse
from lodgecast.operators.voting import (
    candidates,
    weight_shares,
    prediction_columns,
    weight_scores,
    weight_trials,
    weighted_sum,
)


def base_columns(rows: DataFrame, models: Mapping[str, PipelineModel]) -> DataFrame:
    """Score rows with every model in turn; each adds one column, and the rows are never regrouped."""
    keep = list(rows.columns)
    for name, model in models.items():
        scored = model.transform(rows)
        rows = scored.select(*keep, F.col("prediction").alias(name))
        keep.append(name)
    return rows


class VotingModel(Model, TableState):
    """Weighted mean of the predictions of fitted pipelines."""

    def __init__(self, models: Mapping[str, PipelineModel] | None = None, weights: Mapping[str, float] | None = None):
        super().__init__()
        self.models, self.weights = dict(models or {}), dict(weights or {})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scored = base_columns(dataset, self.models)
        return scored.withColumn("prediction", weighted_sum(self.weights)).drop(*self.models)

    def state(self) -> dict[str, DataFrame]:
        rows = [(i, n, float(w)) for i, (n, w) in enumerate(self.weights.items())]
        return {"weights": SparkSession.getActiveSession().createDataFrame(rows, "place int, model string, weight double")}

    def save_parts(self, path: str) -> None:
        for name, model in self.models.items():
            model.write().overwrite().save(f"{path}/base/{name}")

    def restore(self, spark, folder: str) -> None:
        rows = sorted(spark.read.parquet(f"{folder}/weights").collect(), key=lambda r: r["place"])
        self.weights = {r["model"]: r["weight"] for r in rows}
        base = folder.rsplit("/state", 1)[0] + "/base"
        self.models = {name: PipelineModel.load(f"{base}/{name}") for name in self.weights}


class StackingModel(VotingModel):
    """A linear model over the predictions of fitted pipelines."""

    def __init__(self, models: Mapping[str, PipelineModel] | None = None, final: LinearRegressionModel | None = None):
        super().__init__(models, dict.fromkeys(models or {}, 1.0))
        self.final = final

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scored = stack_vector(base_columns(dataset, self.models), list(self.models))
        return self.final.transform(scored).drop("stack", *self.models)

    def save_parts(self, path: str) -> None:
        super().save_parts(path)
        self.final.write().overwrite().save(f"{path}/final")

    def restore(self, spark, folder: str) -> None:
        super().restore(spark, folder)
        self.final = LinearRegressionModel.load(folder.rsplit("/state", 1)[0] + "/final")


def stack_vector(columns: DataFrame, models: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=models, outputCol="stack").transform(columns)


def choose(results: list[Tuned], window: float = S.ENSEMBLE_WINDOW) -> list[Tuned]:
    """Base models close to the best cross-validation score, at least two."""
    spark = SparkSession.getActiveSession()
    rows = [(r.name, i, float(r.cv_rmse_log)) for i, r in enumerate(results)]
    table = candidates(spark.createDataFrame(rows, "model string, position int, cv_rmse_log double"), window)
    chosen = {row["model"] for row in table.collect()}
    return [r for r in results if r.name in chosen]


def vote_equally(chosen: list[Tuned], test: DataFrame) -> Tuned:
    models = {r.name: r.pipeline for r in chosen}
    model = VotingModel(models, weight_shares(dict.fromkeys(models, 1.0)))
    columns = _columns(chosen)
    voted = columns.withColumn("prediction", weighted_sum(model.weights)).withColumn("model", F.lit("v"))
    value = cv_log_rmse(voted).first()["cv_rmse_log"]
    params = {"estimators": ",".join(models)}
    return _scored("VotingEnsembleEqual", value, params, model, test)


def vote_by_weight(chosen: list[Tuned], test: DataFrame, trials: int, seed: int = S.SEED) -> Tuned:
    """Search voting weights. Base predictions do not depend on the weights, so no model is fitted again
    and all trials are scored in one pass."""
    models = {r.name: r.pipeline for r in chosen}
    spark = test.sparkSession
    draws = weight_trials(spark, list(models), trials, seed)
    scores = weight_scores(_columns(chosen), list(models), draws)
    best = scores.orderBy("cv_rmse_log", "trial").first()
    raw = {r["model"]: r["weight"] for r in draws.filter(F.col("trial") == best["trial"]).collect()}
    weights = weight_shares({name: raw[name] for name in models})
    params = {**{f"weight_{n}": round(w, 6) for n, w in weights.items()}, "estimators": ",".join(models)}
    tuned = _scored("VotingEnsembleWeighted", best["cv_rmse_log"], params, VotingModel(models, weights), test)
    tuned.trials = [
        ("VotingEnsembleWeighted", r["trial"], r["cv_rmse_log"], 0.0, {}) for r in scores.orderBy("trial").collect()
    ]
    return tuned


def nested_predictions(
    train: DataFrame, chosen: list[Tuned], folds: int = S.FOLDS, parallelism: int = S.FOLDS, **columns
) -> DataFrame:
    """``outer, id, fold, label, model, prediction``: out-of-fold predictions inside the training side of each outer fold.

    What is fitted without two folds serves both: it predicts the second for the first as outer fold, and the other way
    round. So encoders and models are fitted once for each pair of folds, and each pair's rows are written once.
    """
    if folds < 3:
        raise ValueError("nested folds need three folds or more")

    def pair(without: tuple[int, int]) -> DataFrame:
        left_out = F.col("fold").isin(*without)
        scored = []
        for scale in sorted({r.name in SCALED_MODELS for r in chosen}):
            encoder = feature_pipeline(scale, **columns).fit(train.filter(~left_out))
            rows = written(encoder.transform(train).select("id", "fold", "label", "features"), "nested-rows")
            inside, outside = rows.filter(~left_out), rows.filter(left_out)
            for r in chosen:
                if (r.name in SCALED_MODELS) == scale:
                    fitted = build(r.name, r.params, inside).fit(inside).transform(outside)
                    scored.append(fitted.select("id", "fold", "label", F.lit(r.name).alias("model"), "prediction"))
        table = reduce(DataFrame.unionByName, scored)
        return written(table.withColumn("outer", F.lit(sum(without)) - F.col("fold")), "nested")

    with ThreadPoolExecutor(max_workers=max(parallelism, 1)) as pool:
        return reduce(DataFrame.unionByName, pool.map(pair, combinations(range(folds), 2)))


def stack(chosen: list[Tuned], test: DataFrame, train: DataFrame, folds: int = S.FOLDS, parallelism: int = S.FOLDS,
          **columns) -> Tuned:
    """Ridge over out-of-fold predictions.

    Its own score is nested: for each outer fold the final model learns from predictions that encoders and base models
    made without that fold, and is judged on the fold. ``train`` carries ``id, label, fold`` and the prepared columns.
    """
    models = {r.name: r.pipeline for r in chosen}
    rows = stack_vector(_columns(chosen), list(models))
    nested = nested_predictions(train, chosen, folds, parallelism, **columns)
    inner = prediction_columns(nested, list(models), ("outer", "id", "fold", "label"))
    inner = stack_vector(inner, list(models)).persist()

    def final(train: DataFrame) -> LinearRegressionModel:
        return ridge(1.0, train).setFeaturesCol("stack").fit(train)

    def held_out(f: int) -> DataFrame:
        part = final(inner.filter(F.col("outer") == f)).transform(rows.filter(F.col("fold") == f))
        return part.select("fold", "label", "prediction", F.lit("s").alias("model"))

    value = cv_log_rmse(reduce(DataFrame.unionByName, map(held_out, range(folds)))).first()["cv_rmse_log"]
    inner.unpersist()
    params = {"estimators": ",".join(models), "meta_model": "Ridge(alpha=1.0)"}
    return _scored("StackingEnsemble", value, params, StackingModel(models, final(rows)), test)


def _columns(chosen: list[Tuned]) -> DataFrame:
    return prediction_columns(out_of_fold_table(chosen), [r.name for r in chosen], ("id", "fold", "label")).persist()


def _scored(name: str, value: float, params: dict, model: Model, test: DataFrame) -> Tuned:
    pipeline = PipelineModel([model])
    scored = written(pipeline.transform(test).select("id", "label", "prediction"), name)
    return Tuned(name, value, params, test_metrics(scored), pipeline)
