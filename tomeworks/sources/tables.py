"""Chunk and item-name tables on Parquet."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeworks.functions.rendering import item_key
from tomeworks.functions.text import strip, text_or_empty

TEXT_FIELDS = ("content", "title", "parent_title", "file_title", "item_name")
FIELDS = {name: name for name in ("chunk_id", *TEXT_FIELDS)}


def load_chunks(
    spark: SparkSession, path: str, fields: Mapping[str, str] = FIELDS, where: str | Column | None = None
) -> DataFrame:
    """Scan a chunk table; the filter and the column list reach the Parquet reader."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return normalize_chunks(df, fields)


def normalize_chunks(df: DataFrame, fields: Mapping[str, str] = FIELDS) -> DataFrame:
    """Physical columns under their logical names, text NULLs as empty strings."""
    return df.select([
        (text_or_empty(F.col(actual)) if logical in TEXT_FIELDS else F.col(actual)).alias(logical)
        for logical, actual in fields.items()
    ])


def has_content() -> Column:
    return strip(F.col("content")) != ""


def export_chunks(df: DataFrame, fields: Mapping[str, str] = FIELDS) -> tuple[DataFrame, DataFrame]:
    """Rows with content, and their one-row statistics."""
    rows = normalize_chunks(df, fields)
    kept = has_content()
    stats = rows.agg(
        F.count_if(kept).alias("total_exported"),
        F.count_if(~kept).alias("empty_content_skipped"),
        F.count_distinct(F.when(kept, item_key())).alias("distinct_items"),
    ).withColumn("enough_items", F.col("distinct_items") >= 2)
    return rows.where(kept), stats


def load_chunk_table(df: DataFrame, dim: int, order: Sequence[str] = ("doc_id", "file_title", "pos")) -> tuple[DataFrame, DataFrame]:
    """Rows with both vectors and the right dimension, and the rejects with a reason.

    A chunk keeps the id it has. Others get a hash of document, title and position, so a repeated load
    writes the same ids, and documents of one title do not share them.
    """
    checked = df.withColumn(
        "reason",
        F.when(F.coalesce(F.size("dense_vector"), F.lit(0)) < 1, "no dense vector")
        .when(F.coalesce(F.size("sparse_vector"), F.lit(0)) < 1, "no sparse vector")
        .when(F.size("dense_vector") != dim, "wrong dimension"),
    )
    rows = checked.where(F.col("reason").isNull()).drop("reason")
    made = F.xxhash64(*[c for c in order if c in df.columns])
    own = F.coalesce(F.col("chunk_id").cast("bigint"), made) if "chunk_id" in df.columns else made
    return rows.withColumn("chunk_id", own), checked.where(F.col("reason").isNotNull())


def append_chunks(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def append_item_names(names: DataFrame, path: str) -> None:
    """Append only; repeated imports are folded on read."""
    names.write.mode("append").parquet(path)


def read_item_names(spark: SparkSession, path: str) -> DataFrame:
    return distinct_item_names(spark.read.parquet(path))


def distinct_item_names(df: DataFrame) -> DataFrame:
    return df.dropDuplicates(["file_title", "item_name"])
