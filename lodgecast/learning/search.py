"""Parameter search with K-fold cross-validation on encoded folds that are written once."""

import math
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.feature import ElementwiseProduct
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgecast import schema as S
from lodgecast.functions.scalars import sorted_params_json
from lodgecast.learning.features import PopulationScaler, feature_pipeline
from lodgecast.learning.parzen import propose
from lodgecast.learning.regressors import SPACES, build, converged
from lodgecast.learning.neighbour_model import vectors
from lodgecast.operators.metrics import dollar_metrics
from lodgecast.operators.neighbours import neighbour_regression
from lodgecast.operators.sparse_neighbours import nearest_vectors
from lodgecast.session import shared_folder

#: Feature stages cost far more than reading, and adaptive execution may have left the rows in a few files.
ROW_GROUP_BYTES = 4 << 20
TRIAL_SCHEMA = "model string, trial int, value double, elapsed_seconds double, params map<string,string>"


@dataclass
class Encoded:
    """Training rows, test rows and cross-validation folds as feature vectors."""

    train: DataFrame
    test: DataFrame
    folds: list[tuple[DataFrame, DataFrame]]
    encoder: PipelineModel


@dataclass
class Tuned:
    """Outcome of a stage: score, parameters, test metrics, the fitted pipeline, out-of-fold rows."""

    name: str
    cv_rmse_log: float
    params: dict
    metrics: dict[str, float]
    pipeline: PipelineModel
    out_of_fold: DataFrame | None = None
    trials: list[tuple] = field(default_factory=list)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write rows to the shared folder and read them back: later jobs start from files, not from the
    whole history, and lost executors cost only a read. Row groups are small, so that a file is read by many tasks."""
    path = f"{shared_folder(df.sparkSession)}/lodgecast/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return df.sparkSession.read.parquet(path)


def encode(train: DataFrame, test: DataFrame, folds: int = S.FOLDS, parallelism: int = S.FOLDS, **columns) -> Encoded:
    """Fit the feature stages per fold and on all training rows, and write what they produce.

    Encoders depend on the fold but not on the trial, so every trial of every model reuses these tables:
    one copy of the training rows per fold. ``train`` carries ``id, label, fold`` and the prepared columns.
    """
    keep = ["id", "label", "fold", "features"]

    def fold_pair(f: int) -> tuple[DataFrame, DataFrame]:
        encoder = feature_pipeline(**columns).fit(train.filter(F.col("fold") != f))
        rows = written(encoder.transform(train).select(*keep), f"fold{f}")
        return rows.filter(F.col("fold") != f), rows.filter(F.col("fold") == f)

    def whole() -> tuple[DataFrame, DataFrame, PipelineModel]:
        encoder = feature_pipeline(**columns).fit(train)
        rows = written(encoder.transform(train).select(*keep), "train")
        return rows, written(encoder.transform(test).select("id", "label", "features"), "test"), encoder

    with ThreadPoolExecutor(max_workers=max(parallelism, 1)) as pool:
        everything = pool.submit(whole)
        pairs = list(pool.map(fold_pair, range(folds)))
    rows, test_rows, encoder = everything.result()
    return Encoded(rows, test_rows, pairs, encoder)


def scaled(encoded: Encoded, parallelism: int = S.FOLDS) -> Encoded:
    """The same rows with scaled features. Factors are fitted on each training side; the scaling itself
    happens when the written rows are read, so nothing is stored twice."""

    def factors(inside: DataFrame) -> ElementwiseProduct:
        return PopulationScaler(inputCol="features", outputCol="scaled").fit(inside)

    def apply(scaler: ElementwiseProduct, rows: DataFrame) -> DataFrame:
        return scaler.transform(rows).drop("features").withColumnRenamed("scaled", "features")

    with ThreadPoolExecutor(max_workers=max(parallelism, 1)) as pool:
        scalers = list(pool.map(factors, [encoded.train, *[inside for inside, _ in encoded.folds]]))
    *stages, assembler = encoded.encoder.stages
    last = [
        assembler.copy().setOutputCol("unscaled"),
        scalers[0].copy().setInputCol("unscaled").setOutputCol("features"),
    ]
    return Encoded(
        apply(scalers[0], encoded.train),
        apply(scalers[0], encoded.test),
        [(apply(s, inside), apply(s, outside)) for s, (inside, outside) in zip(scalers[1:], encoded.folds)],
        PipelineModel([*stages, *last]),
    )


def cross_validate(encoded: Encoded, make: Callable[[DataFrame], Estimator], params: dict,
                   parallelism: int = S.FOLDS) -> tuple[float, DataFrame]:
    """Mean of the folds' log RMSE, and the out-of-fold predictions it was measured on.

    A fit that did not settle makes the score infinite.
    """

    def fit(pair: tuple[DataFrame, DataFrame]):
        inside, outside = pair
        fitted = make(inside).fit(inside)
        scored = fitted.transform(outside).select("id", "fold", "label", "prediction")
        return scored, converged(fitted, params)

    with ThreadPoolExecutor(max_workers=max(parallelism, 1)) as pool:
        results = list(pool.map(fit, encoded.folds))
    scored = results[0][0]
    for other, _ in results[1:]:
        scored = scored.unionByName(other)
    value = mean_fold_rmse(scored)
    if not all(settled for _, settled in results) or value is None or not math.isfinite(value):
        value = float("inf")
    return value, scored


def neighbour_search(encoded: Encoded, furthest: int, parallelism: int = S.FOLDS) -> Callable[[dict], tuple[float, DataFrame]]:
    """Cross-validation of nearest-neighbour trials that share one neighbour list per fold.

    The lists reach as far as any trial may; a trial only averages over a prefix of them.
    """

    def lists(pair: tuple[DataFrame, DataFrame]) -> DataFrame:
        inside, outside = pair
        found = nearest_vectors(vectors(outside), vectors(inside, "label"), furthest)
        rows = outside.select(F.col("id").alias("query_id"), "fold", F.col("label").alias("y"))
        return found.join(rows, "query_id")

    with ThreadPoolExecutor(max_workers=max(parallelism, 1)) as pool:
        parts = list(pool.map(lists, encoded.folds))
    table = parts[0]
    for other in parts[1:]:
        table = table.unionByName(other)
    table = written(table, "neighbours")
    labels = table.filter("rank = 1").select(F.col("query_id").alias("id"), "fold", F.col("y").alias("label"))

    def run(params: dict) -> tuple[float, DataFrame]:
        predicted = neighbour_regression(table, int(params["n_neighbors"]), str(params["weights"]))
        scored = labels.join(predicted.withColumnRenamed("query_id", "id"), "id")
        return mean_fold_rmse(scored), scored

    return run


def mean_fold_rmse(scored: DataFrame) -> float:
    error = F.col("label") - F.col("prediction")
    per_fold = scored.groupBy("fold").agg(F.sqrt(F.avg(error * error)).alias("rmse"))
    return per_fold.agg(F.avg("rmse")).first()[0]


def test_metrics(scored: DataFrame) -> dict[str, float]:
    row = dollar_metrics(scored).first()
    return {name: float(row[name]) for name in ("mae", "rmse", "r2")}


def tune(model: str, encoded: Encoded, trials: int, seed: int = S.SEED, parallelism: int = S.FOLDS,
         overrides: dict | None = None, log: Callable[[str], None] = print, batch: int = 1) -> Tuned:
    """Try ``trials`` parameter sets, keep the best by cross-validation, refit, score the test rows.

    Each batch of trials is proposed from all trials finished before it.
    """
    best, kept, finished = None, [], []
    fixed = overrides or {}
    shared = None
    if model == "KNN":
        furthest = int(fixed.get("n_neighbors", SPACES["KNN"]["n_neighbors"][2]))
        shared = neighbour_search(encoded, furthest, parallelism)
    for trial in range(trials):
        if trial % batch == 0:
            asked = [propose(model, finished, t, seed) for t in range(trial, min(trial + batch, trials))]
        proposed = asked[trial % batch]
        params = {**proposed, **fixed}
        log(f"[{model}] trial {trial + 1}/{trials} started")
        started = time.perf_counter()
        if shared is not None:
            value, scored = shared(params)
        else:
            value, scored = cross_validate(encoded, lambda rows: build(model, params, rows), params, parallelism)
        elapsed = time.perf_counter() - started
        finished.append((proposed, value))
        if best is None or value < best[0]:
            best = (value, params, scored)
        kept.append((model, trial, value if math.isfinite(value) else None, elapsed, {k: str(v) for k, v in params.items()}))
        log(finish_line(model, trial, trials, value, best[0], elapsed, params))
    value, params, scored = best
    regressor = build(model, params, encoded.train, refit=True).fit(encoded.train)
    scores = test_metrics(regressor.transform(encoded.test))
    pipeline = PipelineModel([encoded.encoder, regressor])
    return Tuned(model, value, params, scores, pipeline, written(scored, f"oof-{model}"), kept)


def finish_line(model: str, trial: int, trials: int, value: float, best: float, elapsed: float, params: dict) -> str:
    lowest = f"{best:.4f}" if math.isfinite(best) else "none"
    return f"{model}: trial {trial + 1} of {trials}, log RMSE {value:.4f} (lowest {lowest}), {elapsed:.1f} s, {params}"


def trial_table(spark: SparkSession, trials: list[tuple]) -> DataFrame:
    table = spark.createDataFrame(trials, TRIAL_SCHEMA)
    return table.withColumn("params_json", sorted_params_json(F.col("params")))


def out_of_fold_table(results: list[Tuned]) -> DataFrame:
    """Long table ``id, fold, label, model, prediction`` of the tuned base models."""
    tables = [r.out_of_fold.withColumn("model", F.lit(r.name)) for r in results]
    table = tables[0]
    for other in tables[1:]:
        table = table.unionByName(other)
    return table
