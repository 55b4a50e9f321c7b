"""The job engine against a plain loop: one batch, many batches, and a stop in between."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from holdfast.streaming import engine
from holdfast.streaming.jobs import event_stream

START = datetime(2024, 1, 1)
SCHEMA = "seq long, ts timestamp, job_id long, action string, progress double, message string"
LEASE, LATE = timedelta(minutes=30), timedelta(minutes=5)


def replay(rows):
    """Status, progress, error, attempts and refusals of each job; leases end up to the last time less LATE."""
    jobs, paused = {}, False
    last = max(r[1] for r in rows) - LATE
    for _, ts, job_id, action, progress, message in sorted(rows, key=lambda r: (r[1], r[0])):
        if job_id is None:
            paused = action == "pause" if action in ("pause", "resume") else paused
            continue
        j = jobs.setdefault(job_id, {"status": None, "progress": 0.0, "error": None, "attempts": 0, "refused": 0, "until": None})
        if j["until"] and j["until"] <= ts:
            j.update(status="queued", progress=0.0, until=None)
        s = j["status"]
        if action == "queue" and s not in ("queued", "running"):
            j.update(status="queued", progress=0.0, error=None)
        elif action == "start" and s == "queued" and not paused:
            j.update(status="running", progress=0.0, error=None, attempts=j["attempts"] + 1, until=ts + LEASE)
        elif action == "progress" and s == "running":
            j.update(until=ts + LEASE, progress=j["progress"] if progress is None else max(0.0, min(1.0, progress)))
        elif action == "finish" and s == "running":
            j.update(status="done", progress=1.0, error=None, until=None)
        elif action == "fail" and s == "running":
            j.update(status="failed", error=message, until=None)
        elif action == "cancel" and s in ("queued", "running"):
            j.update(status="done", progress=0.0, error="cancelled", until=None)
        else:
            j["refused"] += 1
    for j in jobs.values():
        if j["until"] and j["until"] <= last:
            j.update(status="queued", progress=0.0)
    return {i: (j["status"], j["progress"], j["error"], j["attempts"], j["refused"]) for i, j in jobs.items()}


def made(n, seed):
    rng = random.Random(seed)
    actions = ["queue", "start", "start", "progress", "progress", "finish", "fail", "cancel", "nonsense", None]
    rows = []
    for i in range(n):
        ts = START + timedelta(seconds=40 * (i // 2), microseconds=1500 * (i % 2))
        if rng.random() < 0.04:
            rows.append((i, ts, None, rng.choice(["pause", "resume", "resume", "other"]), None, None))
        else:
            rows.append((i, ts, rng.randrange(25), rng.choice(actions), rng.choice([None, -1.0, 0.25, 7.0]), rng.choice([None, "", "CUDA out of memory"])))
    return rows


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def result(spark, path, folder, files=1):
    changes = engine.job_changes(event_stream(spark, f"{path}/", files), LEASE, LATE, lanes=3)
    got = engine.run_available(changes, folder).collect()
    assert len({r.job_id for r in got}) == len(got)
    return {r.job_id: (r.status, r.progress, r.error, r.attempts, r.refused) for r in got}


def test_a_restart_from_the_checkpoint_gives_the_states_of_one_run(spark, tmp_path):
    rows = made(600, 1)
    path, folder = str(tmp_path / "commands"), f"file://{tmp_path}/stopped"
    put(spark, path, rows[:250])
    assert result(spark, path, folder) == replay(rows[:250])
    put(spark, path, rows[250:430])
    put(spark, path, rows[430:])
    assert result(spark, path, folder) == replay(rows)
    assert result(spark, path, f"file://{tmp_path}/once", None) == replay(rows)


def test_leases_pause_and_cancel(spark, tmp_path):
    steps = [
        (0, 1, "queue"), (0, 2, "queue"), (0, 3, "queue"), (0, 4, "queue"), (1, 1, "start"), (2, 2, "start"), (3, None, "pause"), (4, 3, "start"), (5, 4, "cancel"),
        (20, 2, "progress", 0.5), (45, 2, "progress", 2.0), (50, None, "resume"), (60, 2, "fail", None, "CUDA out of memory"), (61, 5, "start"),
    ]
    rows = [(i, START + timedelta(minutes=minutes), job, action, *rest, *[None] * (2 - len(rest))) for i, (minutes, job, action, *rest) in enumerate(steps)]
    put(spark, str(tmp_path / "c"), rows)
    changes = engine.job_changes(event_stream(spark, f"{tmp_path}/c/", None), LEASE, LATE)
    got = {r.job_id: r for r in engine.shown(engine.run_available(changes, f"file://{tmp_path}/s")).collect()}
    # nobody renewed the lease of 1: a timer queued it again
    assert (got[1].status, got[1].progress, got[1].attempts, got[1].item_status) == ("queued", 0.0, 1, "pending")
    assert (got[2].status, got[2].progress, got[2].item_status) == ("failed", 1.0, "failed") and got[2].error != "CUDA out of memory"
    assert (got[3].status, got[3].refused) == ("queued", 1)
    assert (got[4].status, got[4].error, got[4].item_status) == ("done", "cancelled", "ready")
    assert (got[5].status, got[5].refused) == (None, 1)


def test_no_commands_and_null_times(spark, tmp_path):
    put(spark, str(tmp_path / "c"), [(1, None, 1, "queue", None, None)])
    assert result(spark, str(tmp_path / "c"), f"file://{tmp_path}/s") == {}
    assert spark.conf.get(engine.PROVIDER, "").endswith("HDFSBackedStateStoreProvider") or spark.conf.get(engine.PROVIDER, None) is None
