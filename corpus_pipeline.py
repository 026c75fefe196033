"""Corpus pipeline: language identification, exact and near de-duplication, decontamination, packing.

Every stage is a function ``(spark, docs, sf_dir) -> DataFrame`` over all rows its predecessor kept. The
first four return the columns of ``docs``; the last returns one row per packed piece.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tomeworks
from tomeworks.llm import decontam, exact, langid, neardup, packing
from tomeworks.llm.queries import fold, table, tokenizer
from tomeworks.operators.settle import shared_folder

cloudpickle.register_pickle_by_value(tomeworks)

#: Bytes of rows that go to a Python worker at once, whatever the length of texts.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def bounded(stage):
    """The stage with small batches: what its workers hold adds to what executors keep from the stages before.
    Results are evaluated after a stage returns, so the session keeps the setting."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name, value in BATCH.items():
            spark.conf.set(name, value)
        return stage(spark, docs, sf_dir)

    return run


@bounded
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; texts without a letter go."""
    model = langid.train(docs.where(fold("doc_id", 5) != 0))
    return langid.identify(model, docs).where(F.col("lang_pred") != langid.UNKNOWN).select(docs.columns)


@bounded
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the smallest id."""
    return exact.drop_copies(docs)


@bounded
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the smallest id."""
    return neardup.drop_near_copies(docs)


@bounded
def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~decontam.contaminated()).select(docs.columns)


@bounded
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 1024 tokens."""
    return packing.pack(packing.pieces(docs.select("doc_id", "text"), tokenizer()))


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontamination", contaminated),
    ("packing", packed),
]

#: Trained language models, similarity search and packing have no SQL form; the tests compare each
#: stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
