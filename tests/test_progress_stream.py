import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tomeworks.operators.progress import task_progress
from tomeworks.operators.settle import shared_folder
from tomeworks.streaming.progress import FIELDS, advance, current_progress, overdue_nodes, progress_updates, run_available, write_progress

EVENTS = "task_id string, node string, phase string, status string, seconds double, ts string"


def empty_state():
    return {**dict.fromkeys(FIELDS), "starts": [], "version": 0, "overdue": False}


def run(spark, loads, limit=1800, delay="10 minutes"):
    folder = f"{shared_folder(spark)}/progress-{uuid.uuid4().hex}"
    for rows in loads:
        load = spark.createDataFrame(rows, EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
        load.write.mode("append").parquet(f"{folder}/events")
        arrived = spark.readStream.schema(load.schema).parquet(f"{folder}/events")
        run_available(write_progress(progress_updates(arrived, limit, delay), f"{folder}/updates", f"{folder}/state"))
    return f"{folder}/updates"


def test_any_order_and_any_cut_give_the_state_of_all_events():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 25))
        events = [(str(rng.choice(["start", "end", "status"])), int(rng.integers(0, 12)), float(rng.integers(0, 4)) if rng.random() < 0.8 else None,
                   str(rng.choice(["a", "b"]))) for _ in range(n)]
        state, cut = empty_state(), int(rng.integers(0, n + 1))
        for part in (events[:cut], events[cut:]):
            frame = pd.DataFrame(part, columns=["phase", "at", "seconds", "status"])
            state = advance(state, iter([frame]), -1)
        ends = [(at, s is not None, s) for phase, at, s, _ in events if phase == "end"]
        last = max(ends, key=lambda e: (e[0], e[1], e[2] or 0.0), default=(None, False, None))
        starts = {at for phase, at, *_ in events if phase == "start" and (last[0] is None or at > last[0])}
        said = max(((at, t) for phase, at, _, t in events if phase == "status"), default=(None, None))
        assert (state["first_end"], state["last_end"], state["seconds"]) == (min((e[0] for e in ends), default=None), last[0], last[2])
        assert set(state["starts"]) == starts and (state["status_at"], state["status"]) == said


def test_state_is_bounded_by_the_delay():
    frame = pd.DataFrame([("start", i, None, None) for i in range(1000)], columns=["phase", "at", "seconds", "status"])
    state = advance(empty_state(), iter([frame]), 989)
    assert state["starts"] == [0, *range(990, 1000)]
    late = pd.DataFrame([("end", 994, 1.0, None)], columns=["phase", "at", "seconds", "status"])
    assert advance(state, iter([late]), 989)["starts"] == [995, 996, 997, 998, 999]


def test_two_loads_equal_the_batch_and_timers_report(spark):
    first = [("t1", "parse", "start", None, None, "2024-01-01 10:00:00"), ("t1", "parse", "end", None, 2.345, "2024-01-01 10:01:00"),
             ("t1", "embed", "start", None, None, "2024-01-01 10:02:00"), ("t1", None, "status", "processing", None, "2024-01-01 10:00:00"),
             ("t2", "parse", "start", None, None, "2024-01-01 10:05:00"), ("t3", "parse", "other", None, None, "2024-01-01 10:05:00"),
             (None, "parse", "start", None, None, "2024-01-01 10:05:00"), ("t2", "x", "start", None, None, None)]
    second = [("t1", "embed", "end", None, None, "2024-01-01 10:20:00"), ("t1", None, "status", "completed", None, "2024-01-01 11:00:00"),
              ("t4", "parse", "start", None, None, "2024-01-01 10:59:00"), ("t4", "parse", "start", None, None, "2024-01-01 10:59:00")]
    updates = run(spark, [first, second])
    whole = spark.createDataFrame(first + second, EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    whole = whole.where("task_id IS NOT NULL AND ts IS NOT NULL AND phase <> 'other'")
    key = lambda r: r.task_id
    assert sorted(current_progress(spark, updates).collect(), key=key) == sorted(task_progress(whole).collect(), key=key)
    assert [(r.task_id, r.node, str(r.since)) for r in overdue_nodes(spark, updates).collect()] == [("t2", "parse", "2024-01-01 10:05:00")]


def test_a_reported_node_that_ends_is_taken_back(spark):
    start = [("t", "parse", "start", None, None, "2024-01-01 10:00:00"), ("u", "parse", "start", None, None, "2024-01-01 12:00:00")]
    updates = run(spark, [start])
    assert [r.task_id for r in overdue_nodes(spark, updates).collect()] == ["t"]
    updates = run(spark, [start, [("t", "parse", "end", None, 1.0, "2024-01-01 12:10:00")]])
    assert overdue_nodes(spark, updates).count() == 0


def test_no_events(spark):
    assert current_progress(spark, run(spark, [[]])).count() == 0


def test_nodes_share_buckets_and_only_changed_ones_are_written(spark):
    rows = [(f"t{i}", "parse", "start", None, None, f"2024-01-01 10:00:{i % 60:02d}") for i in range(300)]
    second = [("t7", "parse", "end", None, 1.5, "2024-01-01 10:09:00"), ("t8", "parse", "status", "x", None, "2024-01-01 10:09:00")]
    folder = f"{shared_folder(spark)}/progress-{uuid.uuid4().hex}"
    for load in (rows, second):
        events = spark.createDataFrame(load, EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
        events.write.mode("append").parquet(f"{folder}/events")
        updates = progress_updates(spark.readStream.schema(events.schema).parquet(f"{folder}/events"), 3600, "10 minutes", buckets=2)
        run_available(write_progress(updates, f"{folder}/updates", f"{folder}/state"))
    # two buckets of state hold 301 nodes; the second load writes its two only
    assert spark.read.format("statestore").load(f"{folder}/state").count() == 2
    assert spark.read.parquet(f"{folder}/updates").count() == 302
    whole = spark.createDataFrame(rows + second, EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(current_progress(spark, f"{folder}/updates").collect()) == sorted(task_progress(whole).collect())
