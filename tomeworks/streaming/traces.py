"""Bad-case mining on a stream of answer traces.

Traces arrive as append-only JSON files. Flagging is stateless and uses the batch functions;
only the latest-per-query table and the windowed counts keep state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tomeworks import schemas
from tomeworks.operators.traces import TraceLimits, flag_bad_cases, latest_bad_cases, number_candidates


def read_trace_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.TRACE)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def bad_case_stream(traces: DataFrame, limits: TraceLimits = TraceLimits()) -> DataFrame:
    return flag_bad_cases(traces, limits)


def append_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> DataStreamWriter:
    """Append-only file sink; the checkpoint makes it exactly-once."""
    return df.writeStream.outputMode("append").format(fmt).option("path", path).option("checkpointLocation", checkpoint)


def latest_updates(bad: DataFrame, min_severity: int = 2) -> DataFrame:
    """Per query the latest severe bad case, for update mode. One row of state per query."""
    eligible = bad.where((F.col("severity") >= min_severity) & (F.col("query_hash") != ""))
    newest = F.struct("ts", (-F.col("severity")).alias("s"), (-F.col("latency_ms")).alias("l"), "trace_id")
    row = F.struct(*[c for c in bad.columns if c != "query_hash"])
    return eligible.groupBy("query_hash").agg(F.max_by(row, newest).alias("r")).select("query_hash", "r.*")


def write_latest(updates: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Each micro-batch overwrites its own directory, so a repeated batch changes nothing."""
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return updates.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)


def current_candidates(spark: SparkSession, path: str, min_severity: int = 2) -> DataFrame:
    """Golden candidates from the updates written so far."""
    return number_candidates(latest_bad_cases(spark.read.parquet(path).drop("batch"), min_severity))


def windowed_counts(bad: DataFrame, window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Bad cases per window and type; rows later than the watermark are dropped."""
    timed = bad.withColumn("event_time", F.to_timestamp("ts")).withWatermark("event_time", watermark)
    typed = timed.select("event_time", F.explode("bad_types").alias("bad_type"))
    counts = typed.groupBy(F.window("event_time", window), "bad_type").agg(F.count("*").alias("cases"))
    return counts.select(F.col("window.start").alias("window_start"), "bad_type", "cases")
