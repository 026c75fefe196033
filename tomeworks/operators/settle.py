"""Cutting lineage so that an intermediate result is computed once."""

from __future__ import annotations

import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_written: dict[str, list[str]] = defaultdict(list)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; in a session without that setting
    (a test), one in the warehouse, which all executors share as well."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/settled").rstrip("/")


def settle(df: DataFrame, batch_rows: int | None = None, codec: str | None = None) -> DataFrame:
    """The rows of ``df`` as a written table in the shared folder.

    It survives lost executors, later steps read only the columns they need, and its known size
    lets Spark choose a broadcast join where the table is small. ``release`` deletes it. With
    ``batch_rows`` the functions in its plan get Arrow batches of at most so many rows, for wide rows. ``codec``
    is another compression than the session's, for tables of many long texts.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    _written[spark.sparkContext.applicationId].append(path)
    before = spark.conf.get(BATCH_ROWS)
    try:
        if batch_rows is not None:
            spark.conf.set(BATCH_ROWS, batch_rows)
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(BATCH_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables this application has settled, once their results are no longer read."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    context = spark.sparkContext
    for path in paths:
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)
