"""Task progress from node events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeworks.operators.sampling import join_counted

PDF_NODES = 8
MARKDOWN_NODES = 7


def node_states(events: DataFrame) -> DataFrame:
    """Per task and node: first and last end, the start from which it runs, last duration.

    A node that is started again while it runs keeps its place: ``since`` is the first start after the
    last end, NULL for a node that does not run. Partially aggregated, so one busy task costs a few
    rows per map task.
    """
    phase = F.col("phase")
    narrow = events.where(phase.isin("start", "end")).select(F.struct("task_id", "node").alias("_key"), "phase", "ts", "seconds")
    end = F.when(phase == "end", F.col("ts"))
    ends = narrow.groupBy("_key").agg(
        F.min(end).alias("first_end"), F.max(end).alias("last_end"), F.count_if(phase == "start").alias("_starts"),
        F.round(F.max_by("seconds", F.when(phase == "end", F.struct("ts", "seconds"))), 2).alias("seconds"),
    )
    later = join_counted(narrow.where(phase == "start").select("_key", "ts"), ends.where("_starts > 0"), "_key", "_starts", F.col("ts"))
    since = later.where(F.col("last_end").isNull() | (F.col("ts") > F.col("last_end"))).groupBy("_key").agg(F.min("ts").alias("since"))
    return ends.join(since, "_key", "left").select("_key.*", "first_end", "last_end", "since", "seconds")


def task_progress(events: DataFrame, pdf_tasks: DataFrame | None = None) -> DataFrame:
    """``task_id, status, running, done, seconds, node_seconds, percent``.

    A node runs from its first start after its last end and is done once it ended. ``node_seconds``
    maps nodes to their last duration, ``seconds`` is the sum. Of equally late states the greatest
    counts. Percent counts done nodes and half of a running one over 7 steps (8 for PDF tasks) and
    shows 95 until the task is completed. A task has few nodes: they are its steps.
    """
    states = events.where(F.col("phase") == "status").groupBy("task_id")
    return progress_of(node_states(events), states.agg(F.max_by("status", F.struct("ts", "status")).alias("status")), pdf_tasks)


def progress_of(nodes: DataFrame, status: DataFrame, pdf_tasks: DataFrame | None = None) -> DataFrame:
    """``task_progress`` from the states of nodes and one ``status`` per task."""
    nodes = nodes.groupBy("task_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("since").isNotNull(), F.struct("since", "node")))).alias("_running"),
        F.array_sort(F.collect_list(F.when(F.col("first_end").isNotNull(), F.struct("first_end", "node")))).alias("_done"),
        F.array_sort(F.collect_list(F.when(F.col("seconds").isNotNull(), F.struct("node", "seconds")))).alias("_each"),
        F.round(F.sum("seconds"), 2).alias("seconds"),
    ).withColumn("node_seconds", F.map_from_entries("_each")).drop("_each")
    joined = nodes.join(status, "task_id", "full")
    if pdf_tasks is not None:
        joined = joined.join(pdf_tasks.select("task_id", F.lit(PDF_NODES).alias("_steps")), "task_id", "left")
        steps = F.coalesce("_steps", F.lit(MARKDOWN_NODES))
    else:
        steps = F.lit(MARKDOWN_NODES)
    share = F.coalesce(F.size("_done"), F.lit(0)) + F.when(F.size("_running") > 0, 0.5).otherwise(0.0)
    percent = 100 * share / steps
    empty = F.array().cast("array<string>")
    return joined.select(
        "task_id",
        F.coalesce("status", F.lit("")).alias("status"),
        F.coalesce(F.transform("_running", lambda r: r["node"]), empty).alias("running"),
        F.coalesce(F.transform("_done", lambda r: r["node"]), empty).alias("done"),
        "seconds",
        "node_seconds",
        F.when(F.col("status") == "completed", 100.0).when(percent >= 100, 95.0).otherwise(percent).alias("percent"),
    )
