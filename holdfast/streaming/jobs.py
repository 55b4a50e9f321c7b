"""Jobs as a stream of events: states, counts, and Spark's own event-time operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from holdfast.sources.scratch import scratch_path
from holdfast.sources.store import latest

#: Which state may follow which.
NEXT = {None: {"queued", "running", "done", "failed"}, "queued": {"running", "done", "failed"}, "running": {"done", "failed", "queued"}, "failed": {"queued"}, "done": {"queued"}}


def event_stream(spark: SparkSession, path: str, files_per_batch: int | None = 1) -> DataFrame:
    """Events of a folder of Parquet files; times without a zone become timestamps, as watermarks need them. None takes all files
    that are there as one batch."""
    schema = spark.read.parquet(path).schema
    # a path of one file is a pattern that it alone matches
    one = re.sub(r"(\w)$", r"[\1]", path)
    reader = spark.readStream.schema(schema)
    rows = (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(one)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def latest_state(jobs: DataFrame) -> DataFrame:
    """The last state of each item; ties go to the larger event id."""
    return jobs.groupBy("item_id").agg(F.max_by(F.struct("status", "progress"), F.struct("updated_at", "id")).alias("s")).select("item_id", "s.status", "s.progress")


def recovered(jobs: DataFrame) -> DataFrame:
    """After a crash running jobs are queued again."""
    return jobs.withColumn("status", F.when(F.col("status") == "running", "queued").otherwise(F.col("status")))


def states(events: DataFrame) -> DataFrame:
    """item_id, status, n_events, n_refused after each batch: a state machine that refuses steps that may not follow. Events of a
    batch are taken in order of time, those of a later batch after them: a table whose files overlap in time has to be one batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, n, refused = state.get if state.exists else (None, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for to in rows["status"]:
            n += 1
            if to == status or to in NEXT[status]:
                status = to
            else:
                refused += 1
        state.update((status, n, refused))
        yield pd.DataFrame({"item_id": [key[0]], "status": [status], "n_events": [n], "n_refused": [refused]})

    return events.groupBy("item_id").applyInPandasWithState(step, "item_id long, status string, n_events long, n_refused long", "status string, n long, refused long", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events by type and window of event time."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")


def without_repeats(events: DataFrame, keys: list[str], late: str | None = None) -> DataFrame:
    """The first row of each key. With `late` keys are forgotten after that time and older rows go, which suits live events only:
    the files of a replayed table may come in any order of time."""
    return events.dropDuplicates(keys) if late is None else events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run_once(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Takes all that is there and ends. Every batch is a folder that a repeated batch overwrites; with keys the last row of each counts."""
    spark = stream.sparkSession
    path, columns = scratch_path(spark, "stream"), stream.columns
    schema = stream.schema

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={n}")

    write(spark.createDataFrame([], schema), -1)
    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.option("basePath", f"{path}/out").parquet(f"{path}/out")
    if mode == "complete":
        return rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]).select(*columns)
    return latest(rows, keys, [F.desc("batch")]).select(*columns) if keys else rows.select(*columns)
