"""The whole job: read, clean, split, tune six models, build three ensembles, report.

    spark-submit --py-files lodgecast.zip -m lodgecast.plans.job --csv listings.csv --mode lite
"""

import argparse
import json
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgecast import schema as S
from lodgecast.learning import ensembles
from lodgecast.learning.features import prepare
from lodgecast.learning.regressors import BASE_MODELS, SCALED_MODELS, build
from lodgecast.learning.search import Encoded, Tuned, cross_validate, encode, scaled, tune, written
from lodgecast.operators.cleaning import clean_listings, log_target
from lodgecast.operators.splits import assign_folds, assign_split_exact, training_rows
from lodgecast.sources.tables import load_checkpoint, read_listings, results_table, save_checkpoint, write_report


@dataclass
class Settings:
    mode: str = "lite"
    lite_rows: int = S.LITE_ROWS
    trials: dict[str, int] = field(default_factory=dict)
    overrides: dict[str, dict] = field(default_factory=dict)
    models: list[str] = field(default_factory=lambda: list(BASE_MODELS))
    parallelism: int = S.FOLDS
    output_csv: str | None = None
    model_folder: str | None = None
    resume: bool = False
    columns: dict = field(default_factory=dict)

    def trial_count(self, model: str) -> int:
        return self.trials.get(model, S.TRIALS[self.mode][model])


def prepared(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cleaned training and test rows with label; written once, since everything below reads them often."""
    rows = assign_split_exact(log_target(clean_listings(raw)))
    table = written(prepare(rows), "listings")
    return table.filter("split = 'train'").drop("split"), table.filter("split = 'test'").drop("split")


def run(raw: DataFrame, settings: Settings, source: str = "", log=print) -> list:
    """Run or resume every stage; the results table is refreshed after each one."""
    if settings.resume and settings.model_folder is None:
        raise ValueError("resuming needs a model folder")
    if settings.lite_rows <= 0:
        raise ValueError("lite rows must be positive")
    spark = raw.sparkSession
    full, test = prepared(raw)
    train = written(assign_folds(training_rows(full, settings.mode, settings.lite_rows)), "train")
    sizes = {"train_rows": train.count(), "test_rows": test.count()}
    log(f"Mode: {settings.mode}; train rows: {sizes['train_rows']}, test rows: {sizes['test_rows']}")
    encoded: dict[bool, Encoded] = {}
    done: list[Tuned] = []

    def tables(model: str) -> Encoded:
        if False not in encoded:
            encoded[False] = encode(train, test, parallelism=settings.parallelism, **settings.columns)
        if model in SCALED_MODELS and True not in encoded:
            encoded[True] = scaled(encoded[False], settings.parallelism)
        return encoded[model in SCALED_MODELS]

    def stage(name: str, trials: int | None, work) -> Tuned:
        context = {"mode": settings.mode, "source": source, **sizes, "trial_count": trials}
        found = load_checkpoint(spark, settings.model_folder, name, context) if settings.resume else None
        if found is not None:
            row, pipeline = found
            log(f"Loaded checkpoint {name}")
            result = Tuned(name, row["best_cv_rmse_log"], json.loads(row["best_params"]), row["test_metrics"].asDict(), pipeline)
        else:
            if settings.resume:
                log(f"No matching checkpoint for {name}; training")
            result = work()
            if settings.model_folder is not None:
                save_checkpoint(spark, settings.model_folder, result, context)
        done.append(result)
        if settings.output_csv is not None:
            write_report(results_table(spark, done), settings.output_csv)
        return result

    base = []
    for model in settings.models:
        trials = settings.trial_count(model)
        base.append(
            stage(model, trials, lambda: tune(model, tables(model), trials, parallelism=settings.parallelism,
                                              overrides=settings.overrides.get(model), log=log))
        )
    chosen = ensembles.choose(base)
    log("Ensemble candidates: " + ", ".join(r.name for r in chosen))

    def with_folds() -> list[Tuned]:
        """Out-of-fold rows of resumed stages are made again from their parameters."""
        for r in chosen:
            if r.out_of_fold is None:
                _, scored = cross_validate(tables(r.name), lambda rows: build(r.name, r.params, rows), {}, settings.parallelism)
                r.out_of_fold = written(scored, f"oof-{r.name}")
        return chosen

    weights = settings.trial_count("VotingEnsembleWeighted")
    stage("VotingEnsembleEqual", None, lambda: ensembles.vote_equally(with_folds(), test))
    stage("VotingEnsembleWeighted", weights, lambda: ensembles.vote_by_weight(with_folds(), test, weights))
    stage("StackingEnsemble", None, lambda: ensembles.stack(
        with_folds(), test, train, parallelism=settings.parallelism, **settings.columns))
    return done


def score(pipeline: PipelineModel, rows: DataFrame) -> DataFrame:
    """Predictions of a saved pipeline for prepared rows, on the log scale and in currency."""
    return pipeline.transform(rows).withColumn("predicted_price", F.expm1("prediction"))


def main() -> None:
    arguments = argparse.ArgumentParser(description=__doc__)
    arguments.add_argument("--csv", required=True, help="listing file or folder")
    arguments.add_argument("--format", default="csv", help="csv, or any format Spark reads")
    arguments.add_argument("--mode", default="lite", choices=list(S.TRIALS))
    arguments.add_argument("--lite-rows", type=int, default=S.LITE_ROWS)
    arguments.add_argument("--trials", action="append", default=[], metavar="MODEL=N", help="override a trial budget")
    arguments.add_argument("--parallelism", type=int, default=S.FOLDS, help="folds fitted at the same time")
    arguments.add_argument("--output-csv")
    arguments.add_argument("--model-folder")
    arguments.add_argument("--resume", action="store_true")
    given = arguments.parse_args()
    spark = SparkSession.builder.appName("lodgecast").getOrCreate()
    settings = Settings(
        mode=given.mode,
        lite_rows=given.lite_rows,
        trials={m: int(n) for m, n in (t.split("=") for t in given.trials)},
        parallelism=given.parallelism,
        output_csv=given.output_csv,
        model_folder=given.model_folder,
        resume=given.resume,
    )
    results = run(read_listings(spark, given.csv, given.format), settings, given.csv)
    results_table(spark, results).show(truncate=False)


if __name__ == "__main__":
    main()
