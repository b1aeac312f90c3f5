"""Listing files in, result tables and checkpoints out."""

import json
import uuid

from pyspark.ml import PipelineModel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodgecast.schema import LISTING_SCHEMA
from lodgecast.sources.quoted_csv import csv_records

# Texts that stand for a missing value in a listing file.
MISSING_TEXTS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
                 "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

RESULT_SCHEMA = (
    "position int, model string, cv_rmse_log double, mae double, rmse double, r2 double, best_params_json string"
)
CONTEXT_FIELDS = "mode string, source string, train_rows bigint, test_rows bigint, trial_count int"
METADATA_SCHEMA = (
    "name string, artifact string, best_cv_rmse_log double, best_params string, "
    f"test_metrics struct<mae:double,rmse:double,r2:double>, context struct<{CONTEXT_FIELDS.replace(' ', ':').replace(',:', ',')}>"
)


def read_listings_csv(spark: SparkSession, path: str, loose_quotes: bool = False) -> DataFrame:
    """Listing file with a header, quoted line breaks and doubled quotes; the schema is stated, not guessed.

    Every column is read as text first, so that all missing-value texts count and a malformed number
    becomes NULL instead of failing the job. Many tasks read one file; ``loose_quotes`` is for files with bare
    quotes in unquoted fields, which say where a record ends only when read from the start, one task for each file.
    """
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in LISTING_SCHEMA])
    if loose_quotes:
        reader = spark.read.schema(texts).options(header=True, multiLine=True, quote='"', escape='"', enforceSchema=False)
        rows = reader.csv(path)
    else:
        records = csv_records(spark, path, texts.fieldNames())
        ddl = ", ".join(f"`{name}` string" for name in texts.fieldNames())
        rows = records.select(F.from_csv("record", ddl, {"quote": '"', "escape": '"'}).alias("r")).select("r.*")
    typed = []
    for field in LISTING_SCHEMA:
        value = F.when(~F.col(field.name).isin(*MISSING_TEXTS), F.col(field.name))
        if isinstance(field.dataType, (T.IntegerType, T.LongType)):
            value = value.try_cast("double").try_cast(field.dataType.simpleString())
        elif not isinstance(field.dataType, T.StringType):
            value = value.try_cast(field.dataType.simpleString())
        typed.append(value.alias(field.name))
    return rows.select(*typed)


def read_listings(spark: SparkSession, path: str, file_format: str = "csv") -> DataFrame:
    if file_format == "csv":
        return read_listings_csv(spark, path)
    return spark.read.format(file_format).load(path)


def write_listings_csv(listings: DataFrame, path: str) -> None:
    ordered = listings.select(*LISTING_SCHEMA.fieldNames())
    ordered.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_report(table: DataFrame, path: str) -> None:
    """One small CSV with a header, for reading by people: a comparison table or a top-k list."""
    table.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def results_table(spark: SparkSession, results: list) -> DataFrame:
    """One row per finished model, rounded for reporting, parameters as JSON with sorted keys."""
    rows = [
        (i, r.name, float(r.cv_rmse_log), *[float(r.metrics[m]) for m in ("mae", "rmse", "r2")],
         json.dumps(r.params, sort_keys=True))
        for i, r in enumerate(results)
    ]
    table = spark.createDataFrame(rows, RESULT_SCHEMA)
    return table.orderBy("position").select(
        "model",
        F.round("cv_rmse_log", 6).alias("cv_rmse_log"),
        F.round("mae", 4).alias("test_mae_dollars"),
        F.round("rmse", 4).alias("test_rmse_dollars"),
        F.round("r2", 6).alias("test_r2"),
        "best_params_json",
    )


def save_checkpoint(spark: SparkSession, folder: str, result, context: dict) -> str:
    """Save a fitted pipeline to a fresh place, then its metadata row, which is what a load looks for."""
    artifact = f"{folder}/{result.name}/{uuid.uuid4().hex}"
    result.pipeline.write().overwrite().save(artifact)
    row = (
        result.name,
        artifact,
        float(result.cv_rmse_log),
        json.dumps(result.params, sort_keys=True),
        tuple(float(result.metrics[m]) for m in ("mae", "rmse", "r2")),
        tuple(context[f.split()[0]] for f in CONTEXT_FIELDS.split(", ")),
    )
    metadata = spark.createDataFrame([row], METADATA_SCHEMA)
    metadata.coalesce(1).write.mode("overwrite").json(f"{folder}/{result.name}/metadata")
    return artifact


def read_metadata(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(METADATA_SCHEMA).json(f"{folder}/{name}/metadata")


def load_checkpoint(spark: SparkSession, folder: str, name: str, context: dict):
    """Metadata row and pipeline of a finished stage, or None when its context is another one."""
    try:
        matches = read_metadata(spark, folder, name)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    for field in CONTEXT_FIELDS.split(", "):
        column = field.split()[0]
        matches = matches.filter(F.col(f"context.{column}").eqNullSafe(F.lit(context[column])))
    row = matches.first()
    if row is None:
        return None
    return row, PipelineModel.load(row["artifact"])
