"""A job engine as one stateful stream: commands move jobs, a lease that runs out queues a job again, and a pause stops starts.

Commands have seq (long, orders equal times), ts (timestamp), job_id (long, null for `pause` and `resume`), action, progress (double) and message:

| action | from | to |
|---|---|---|
| queue | no job, done, failed | queued, progress 0, no message |
| start | queued, if not paused | running with a lease of its own, progress 0, one attempt more |
| progress | running | running, progress between 0 and 1, the lease begins anew |
| finish | running | done, progress 1 |
| fail | running | failed with the message |
| cancel | queued, running | done, progress 0, message `cancelled` |
| pause, resume | all jobs | no start, starts again; running jobs go on |

All else is refused and counted: other actions, a null job but for a pause, and what may not follow. A lease ends by event time: a command at or
after its end finds the job queued, and a timer queues jobs that get no command. Rows older than the watermark are dropped, null times too.

Jobs lie in lanes by a hash of their ids. A lane's state is a map of jobs, a map of leases, its timer and the pause flag, all in the
RocksDB store; a batch reads and writes only the jobs that it names, and the leases of running ones when a timer fires. The commands of a
batch are put in order inside their lane, so a batch has to fit: `files_per_batch` bounds it, and `lanes` divides it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from holdfast.operators.library import CANCELLED, friendly_error, item_status
from holdfast.sources.store import latest

LANES, LEASE, LATE = 64, timedelta(minutes=10), timedelta(hours=1)
JOB = "status string, progress double, error string, attempts long, refused long, version long, until long"
CHANGED = "job_id long, status string, progress double, error string, attempts long, refused long, version long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NO_JOB = (None, 0.0, None, 0, 0, 0, None)


def queued_again(job: tuple) -> tuple:
    """A running job whose lease has ended."""
    _, _, error, attempts, refused, version, _ = job
    return "queued", 0.0, error, attempts, refused, version + 1, None


def moved(job: tuple, at: int, action: str | None, progress: float | None, message: str | None, paused: bool, lease: int) -> tuple:
    """The job after a command at a time in milliseconds."""
    if job[6] is not None and job[6] <= at:
        job = queued_again(job)
    status, done, error, attempts, refused, version, until = job
    version += 1
    if action == "queue" and status in (None, "done", "failed"):
        return "queued", 0.0, None, attempts, refused, version, None
    if action == "start" and status == "queued" and not paused:
        return "running", 0.0, None, attempts + 1, refused, version, at + lease
    if action == "progress" and status == "running":
        return status, done if progress is None else min(max(progress, 0.0), 1.0), error, attempts, refused, version, at + lease
    if action == "finish" and status == "running":
        return "done", 1.0, None, attempts, refused, version, None
    if action == "fail" and status == "running":
        return "failed", done, message, attempts, refused, version, None
    if action == "cancel" and status in ("queued", "running"):
        return "done", 0.0, CANCELLED, attempts, refused, version, None
    return status, done, error, attempts, refused + 1, version, until


class Engine(StatefulProcessor):
    """One lane."""

    def __init__(self, lease_ms: int):
        self.lease = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "job_id long", JOB)
        self.leases = handle.getMapState("leases", "job_id long", "until long")
        self.paused = handle.getValueState("paused", "paused boolean")

    def _put(self, job_id: int, job: tuple, before: tuple) -> None:
        self.jobs.updateValue((job_id,), job)
        if job[6] is not None:
            self.leases.updateValue((job_id,), (job[6],))
        elif before[6] is not None:
            self.leases.removeKey((job_id,))

    def _frame(self, changed: dict[int, tuple]) -> pd.DataFrame:
        names = [c.split()[0] for c in CHANGED.split(", ")]
        frame = pd.DataFrame([(i, *job[:6]) for i, job in changed.items()], columns=names)
        return frame.astype({"error": object, "status": object})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        paused = was = bool(self.paused.get()[0]) if self.paused.exists() else False
        before: dict[int, tuple] = {}
        now: dict[int, tuple] = {}
        batch = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        # missing values of any type become None
        values = [[None if missing else v for v, missing in zip(batch[c].tolist(), batch[c].isna(), strict=True)] for c in ("job_id", "at_ms", "action", "progress", "message")]
        for job_id, at, action, progress, message in zip(*values, strict=True):
            if job_id is None:
                paused = {"pause": True, "resume": False}.get(action, paused)
                continue
            job_id = int(job_id)
            if job_id not in now:
                before[job_id] = now[job_id] = tuple(self.jobs.getValue((job_id,))) if self.jobs.containsKey((job_id,)) else NO_JOB
            now[job_id] = moved(now[job_id], int(at), action, progress, message, paused, self.lease)
        for job_id, job in now.items():
            self._put(job_id, job, before[job_id])
        if paused != was:
            self.paused.update((paused,))
        if ends := [job[6] for job in now.values() if job[6] is not None]:
            self.handle.registerTimer(min(ends))
        yield self._frame(now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = timerValues.getCurrentWatermarkInMs()
        leases = [(int(k[0]), int(v[0])) for k, v in self.leases.iterator()]
        ended = {}
        for job_id, until in leases:
            if until <= at:
                before = tuple(self.jobs.getValue((job_id,)))
                ended[job_id] = queued_again(before)
                self._put(job_id, ended[job_id], before)
        if left := [until for _, until in leases if until > at]:
            self.handle.registerTimer(min(left))
        yield self._frame(ended)


def job_changes(commands: DataFrame, lease: timedelta = LEASE, late: timedelta = LATE, lanes: int = LANES) -> DataFrame:
    """The jobs that a batch changed, with a version that grows; the stream has to run in `rocks`."""
    control = F.col("job_id").isNull() & F.col("action").isin("pause", "resume")
    own = F.when(F.col("job_id").isNotNull(), F.array(F.pmod(F.xxhash64("job_id"), F.lit(lanes)))).when(control, F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long")))
    rows = commands.select("seq", "ts", F.unix_millis("ts").alias("at_ms"), F.col("job_id").cast("long").alias("job_id"), "action", F.col("progress").cast("double").alias("progress"), "message")
    rows = rows.withWatermark("ts", f"{int(late.total_seconds() * 1000)} milliseconds").where(F.col("ts").isNotNull())
    rows = rows.withColumn("lane", F.explode(own))
    return rows.groupBy("lane").transformWithStateInPandas(Engine(int(lease.total_seconds() * 1000)), CHANGED, "update", "EventTime")


@contextmanager
def rocks(spark: SparkSession):
    """The session keeps state in RocksDB, which the engine's maps and timers need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def run_available(changes: DataFrame, folder: str) -> DataFrame:
    """Takes all commands that are there and ends; a later call with the same folder goes on from its checkpoint. A batch is a folder
    that its repetition overwrites. The result has each job's last version."""
    spark = changes.sparkSession

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")

    with rocks(spark):
        spark.createDataFrame([], changes.schema).write.mode("overwrite").parquet(f"{folder}/out/batch=-1")
        changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(changes.schema).option("basePath", f"{folder}/out").parquet(f"{folder}/out")
    return latest(rows, ["job_id"], [F.desc("version")]).select(*changes.columns)


def shown(jobs: DataFrame) -> DataFrame:
    """Jobs with the state of their item, and errors as a user reads them."""
    return jobs.withColumn("item_status", item_status(F.col("status"), F.col("error"))).withColumn("error", friendly_error(F.col("error")))
