"""Files: JSONL in and out, statistics, Markdown documents, chunk backups, traces."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomeworks import schemas

CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, schema: str, corrupt: bool = False) -> DataFrame:
    """One JSON object per line. Blank lines are skipped, a missing path is an empty table, and
    broken lines are kept in ``_corrupt_record`` on request instead of failing the job."""
    full = f"{schema}, {CORRUPT} string" if corrupt else schema
    try:
        return spark.read.schema(full).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", keep_nulls: bool = False) -> None:
    """JSON lines in UTF-8 without escapes; NULL fields are left out unless kept."""
    df.write.mode(mode).option("ignoreNullFields", str(not keep_nulls).lower()).json(path)


def write_stats(stats: DataFrame, path: str) -> None:
    """A one-row table of counters as a single JSON object; a table of more rows is an error."""
    whole = stats.withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(1))))
    checked = F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("statistics must have one row")))
    whole.where(checked).drop("_n").coalesce(1).write.mode("overwrite").json(path)


def _decoded(name: Column) -> Column:
    """A file name as it is on disk; Spark reports it percent-encoded."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def _suffix(name: Column) -> Column:
    """Like a path suffix: empty for names that only start with a dot."""
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, file_title, suffix, accepted, reason`` of every file, without reading contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = files.select("path", _decoded(F.col("_metadata.file_name")).alias("name"))
    suffix = _suffix(F.col("name"))
    return named.select(
        "path",
        F.when(suffix == "", F.col("name")).otherwise(
            F.expr("substring(name, 1, length(name) - length(regexp_extract(name, '^.+([.][^.]+)$', 1)))")
        ).alias("file_title"),
        suffix.alias("suffix"),
        suffix.isin(".md", ".pdf").alias("accepted"),
        F.when(suffix == ".md", None)
        .when(suffix == ".pdf", "text has to be extracted upstream")
        .otherwise(F.concat(F.lit("unsupported file type: "), suffix)).alias("reason"),
    )


def scan_documents(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files as one row each: ``doc_id, path, file_title, md_content``."""
    texts = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    )
    name = _decoded(F.col("_metadata.file_name"))
    return texts.select(
        F.xxhash64(F.col("_metadata.file_path")).alias("doc_id"),
        F.col("_metadata.file_path").alias("path"),
        F.regexp_replace(name, r"\.md$", "").alias("file_title"),
        F.col("value").alias("md_content"),
    )


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Backup of the chunks. The chunks of a title stay together inside a file; there is no directory
    per title, of which a large import has too many."""
    chunks.repartition("file_title").sortWithinPartitions("file_title").write.mode("overwrite").json(path)


def append_traces(traces: DataFrame, path: str, enabled: bool = True) -> None:
    """Append one line per answer; nothing is written when tracing is off."""
    if enabled:
        traces.write.mode("append").json(path)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, schemas.TRACE)
