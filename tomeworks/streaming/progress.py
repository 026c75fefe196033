"""Task progress on a stream of node events.

Nodes are dealt by the hash of task and node to ``buckets`` groups, each one piece of state, since a call of
Python for every single node costs milliseconds; a busy task is still spread over tasks of the job. A node's
state holds the first and last end and the starts after the last end. An end later than the watermark can still come;
of the starts up to the watermark it would undo all or none, so only the first of these is kept and
state is bounded by the starts within the watermark's delay. A batch rewrites the buckets that it touches, so
``buckets`` should grow with the number of nodes; a stream keeps the number with which its checkpoint began.

Every change is written as one row with a version; ``current_progress`` reads the last version of
each node and computes the same columns as ``task_progress`` does on the whole table. A node
that has run for longer than ``limit_seconds`` of event time is reported by a timer. Events later than the
watermark are dropped. Events without task, node or time are left out, and so is any other phase
than start, end and status.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tomeworks.operators.progress import progress_of

#: What is kept of one node.
NODE = pa.schema([("first_end", pa.int64()), ("last_end", pa.int64()), ("seconds", pa.float64()), ("starts", pa.list_(pa.int64())), ("status_at", pa.int64()),
                  ("status", pa.string()), ("version", pa.int64()), ("overdue", pa.bool_())])
#: The state of a bucket: its nodes as an Arrow table.
STATE = "nodes binary"
BUCKET = pa.schema([("task_id", pa.string()), ("node", pa.string()), *NODE])
UPDATE = ("task_id string, node string, first_end bigint, last_end bigint, since bigint, seconds double, status_at bigint, status string, "
          "version bigint, overdue boolean")
FIELDS = NODE.names
#: The node of a task's own status rows.
TASK = ""


def _later(old: tuple[int, Any] | None, at: int, value: Any) -> tuple[int, Any]:
    """The later of two values, the greater of equally late ones; no value is less than any."""
    if old is None or (at, value is not None) > (old[0], old[1] is not None):
        return at, value
    return (at, value) if at == old[0] and value is not None and value > old[1] else old


def _events(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """``phase, at, seconds, status`` of each row, missing values as None."""
    for frame in frames:
        plain = frame[["seconds", "status"]].astype(object).where(frame[["seconds", "status"]].notna(), None)
        yield from zip(frame["phase"].tolist(), frame["at"].tolist(), plain["seconds"].tolist(), plain["status"].tolist())


def _after(state: dict[str, Any], events: Iterable[tuple], watermark: int) -> dict[str, Any]:
    """The state of one node after more events in any order; times are microseconds."""
    first, starts = state["first_end"], set(state["starts"])
    end = None if state["last_end"] is None else (state["last_end"], state["seconds"])
    status = None if state["status_at"] is None else (state["status_at"], state["status"])
    for phase, at, seconds, said in events:
        if phase == "start":
            starts.add(at)
        elif phase == "end":
            first = at if first is None else min(first, at)
            end = _later(end, at, seconds)
        else:
            status = _later(status, at, said)
    kept = sorted(s for s in starts if end is None or s > end[0])
    settled = [s for s in kept if s <= watermark]
    last_end, seconds = end or (None, None)
    status_at, said = status or (None, None)
    return {**state, "first_end": first, "last_end": last_end, "seconds": seconds, "starts": settled[:1] + kept[len(settled) :], "status_at": status_at,
            "status": said}


def advance(state: dict[str, Any], frames: Iterator[pd.DataFrame], watermark: int) -> dict[str, Any]:
    """The state of one node after frames of its events."""
    for frame in frames:
        state = _after(state, _events(iter([frame])), watermark)
    return state


def _pack(nodes: dict[tuple, dict[str, Any]]) -> bytes:
    columns = [[key[0] for key in nodes], [key[1] for key in nodes], *([state[f] for state in nodes.values()] for f in FIELDS)]
    table = pa.table([pa.array(values, field.type) for values, field in zip(columns, BUCKET)], schema=BUCKET)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, BUCKET) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(packed: bytes) -> dict[tuple, dict[str, Any]]:
    rows = zip(*(column.to_pylist() for column in pa.ipc.open_stream(packed).read_all().columns))
    return {row[:2]: dict(zip(FIELDS, row[2:])) for row in rows}


def _progress_of_bucket(limit: int):
    """The update rows of one bucket of nodes, for ``applyInPandasWithState``; ``limit`` in microseconds."""
    kinds = {"bigint": "Int64", "double": "float64", "boolean": "bool", "string": "object"}

    def run(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        watermark = kept.getCurrentWatermarkMs() * 1000
        nodes = _unpack(bytes(kept.get[0])) if kept.exists else {}
        changed = set()
        for frame in [] if kept.hasTimedOut else frames:
            arrived: dict[tuple, list] = {}
            for node, event in zip(zip(frame["task_id"].tolist(), frame["node"].tolist()), _events(iter([frame]))):
                arrived.setdefault(node, []).append(event)
            for node, events in arrived.items():
                old = nodes.get(node) or {**dict.fromkeys(FIELDS), "starts": [], "version": 0, "overdue": False}
                nodes[node] = _after(old, events, watermark)
            changed.update(arrived)
        waiting = None
        for node, state in nodes.items():
            since = state["starts"][0] if state["starts"] else None
            overdue = since is not None and since + limit <= watermark
            if node in changed or overdue != state["overdue"]:
                changed.add(node)
                state["overdue"] = overdue
                state["version"] += 1
            if since is not None and not overdue:
                waiting = since if waiting is None else min(waiting, since)
        kept.update((_pack(nodes),))
        if waiting is not None:
            # whole milliseconds, and always ahead of the watermark
            kept.setTimeoutTimestamp(max(-(-(waiting + limit) // 1000), watermark // 1000 + 1))
        rows = [{"task_id": node[0], "node": node[1], "since": min(nodes[node]["starts"], default=None), **nodes[node]} for node in changed]
        yield pd.DataFrame({name: pd.Series([row[name] for row in rows], dtype=kinds[kind]) for name, kind in (f.split() for f in UPDATE.split(", "))})

    return run


def progress_updates(events: DataFrame, limit_seconds: float, delay: str = "10 minutes", buckets: int = 1024) -> DataFrame:
    """One row for every change of a node on a stream of ``task_id, node, phase, status, seconds, ts``."""
    node = F.when(F.col("phase") == "status", TASK).otherwise(F.col("node"))
    timed = events.where(F.col("phase").isin("start", "end", "status")).select(
        F.col("task_id").cast("string").alias("task_id"), node.alias("node"), "phase", "status", F.col("seconds").cast("double").alias("seconds"),
        F.col("ts").cast("timestamp").alias("ts")).where("task_id IS NOT NULL AND node IS NOT NULL AND ts IS NOT NULL")
    timed = timed.withColumn("at", F.unix_micros("ts")).withWatermark("ts", delay)
    timed = timed.withColumn("bucket", F.pmod(F.xxhash64("task_id", "node"), F.lit(buckets)).cast("int"))
    run = _progress_of_bucket(int(limit_seconds * 1_000_000))
    return timed.groupBy("bucket").applyInPandasWithState(run, UPDATE, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def write_progress(updates: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Each micro-batch overwrites its own directory, so a repeated batch changes nothing."""
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return updates.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)


def run_available(writer: DataStreamWriter) -> None:
    """Process what has arrived, and the timers that it sets off."""
    writer.trigger(availableNow=True).start().awaitTermination()


def latest_nodes(spark: SparkSession, path: str) -> DataFrame:
    """The last version of every node, from the updates written so far."""
    updates = spark.read.schema(UPDATE).parquet(path)
    names = [f.split()[0] for f in UPDATE.split(", ")]
    return updates.groupBy("task_id", "node").agg(F.max_by(F.struct(*names), "version").alias("r")).select("r.*")


def current_progress(spark: SparkSession, path: str, pdf_tasks: DataFrame | None = None) -> DataFrame:
    """The columns of ``task_progress``, from the updates written so far."""
    latest = latest_nodes(spark, path)
    nodes = latest.where(F.col("node") != TASK).withColumn("seconds", F.round("seconds", 2))
    return progress_of(nodes, latest.where(F.col("node") == TASK).select("task_id", "status"), pdf_tasks)


def overdue_nodes(spark: SparkSession, path: str) -> DataFrame:
    """``task_id, node, since`` of the nodes that run for too long."""
    late = latest_nodes(spark, path).where("overdue")
    return late.select("task_id", "node", F.timestamp_micros("since").alias("since"))
