"""Corpus pipeline: quality rules, near-duplicate removal, substring removal, decontamination, packing.

Each stage takes the documents that its predecessor kept and reads them as they were written. All but the last return
the columns of documents; extra columns of the input are carried along. Rows without an id are judged by their text in
all stages but near-duplicate removal, which keeps them; of equal rows that share an id, that stage keeps one. A document
whose words are all repeated elsewhere has no text after the third stage and goes there.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgecast.llm.decontamination import clean
from lodgecast.llm.near_dedup import near_dedup
from lodgecast.llm.packing import pack_documents
from lodgecast.llm.quality_rules import quality_filter
from lodgecast.llm.substring_dedup import remove_repeats
from lodgecast.session import shared_folder

TOKENIZER = "byte_bpe_50k.json"
#: SQL cannot state MinHash components or tokenizer ids.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality rules reject; the verdict is computed in the row, without a join."""
    return quality_filter(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id. A repeated row goes too.

    Different texts under one id are one document and stay or go together.
    """
    kept = near_dedup(docs).filter("kept").select("doc_id").distinct()
    stay = docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    return stay.dropDuplicates(["doc_id", "text"]).unionByName(docs.filter("doc_id is null"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that occur elsewhere; untouched texts keep their spaces, texts with nothing left go."""
    return remove_repeats(docs).filter("length(text) > 0").withColumn("n_chars", F.length("text").cast("long"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item within the error budget."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return clean(docs, items)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining texts in sequences of at most 1024 tokens."""
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-pipeline-{uuid.uuid4().hex}"
    for at, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{at}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


PIPELINE_QUERIES = {"pipeline": run}
PIPELINE_ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
