"""Tables that change a few items at a time: immutable segments, deletions beside them, and a numbered log of manifests.

An edit of some items writes one small segment with their new rows and a list of the items that it replaces; nothing else is rewritten. A row is
live unless a later segment's list has its item. Segments of one size tier are merged when there are enough of them, without their dead rows, so a table
has about MERGE segments a tier however often it changes.

A change is a new manifest: its data are written first, then the file with the next number is created if it isn't there yet. Who finds it there
has lost the race, reads the newer manifest and does it again; the changes of both land.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Segments of a tier that are merged, how much larger each tier is, the smallest tier's rows, and deletions up to which their ids are broadcast.
MERGE, GROWTH, LEAST, BROADCAST = 4, 8, 1000, 1_000_000
TRIES = 20


class Conflict(RuntimeError):
    """Another writer was first, again and again."""


@dataclass(frozen=True)
class Segment:
    """number: its place in the order of changes; folder of the rows, and how many; gone: folder of the ids of items it replaces, and how many."""

    number: int
    rows: str | None
    n_rows: int
    gone: str | None = None
    n_gone: int = 0


class Segments:
    """A table of rows with a column that names their item."""

    def __init__(self, spark: SparkSession, root: str, item: str = "item_id"):
        self.spark, self.root, self.item = spark, root.rstrip("/"), item
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p) if not s.getPath().getName().startswith(".")) if self._fs.exists(p) else []

    def manifest(self) -> tuple[int, list[Segment]]:
        """The number of the newest manifest, and its segments. One that is being written has no end yet and doesn't count."""
        for name in reversed(self._names("log")):
            lines = [r.value for r in self.spark.read.text(f"{self.root}/log/{name}").collect()]
            if lines and lines[-1] == "end":
                return int(name), [Segment(**json.loads(x)) for x in lines[:-1]]
        return 0, []

    def _commit(self, number: int, segments: list[Segment]) -> bool:
        try:
            out = self._fs.create(self._path("log", f"{number:012d}"), False)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        out.write("\n".join([*[json.dumps(asdict(s)) for s in segments], "end"]).encode())
        out.close()
        return True

    def _change(self, change: Callable[[int, list[Segment]], list[Segment] | None]) -> bool:
        """change: from the next number and the segments in force to those after it, or None to leave them."""
        for _ in range(TRIES):
            n, segments = self.manifest()
            after = change(n + 1, segments)
            if after is None:
                return False
            if self._commit(n + 1, after):
                return True
        raise Conflict(f"{self.root}: other writers were first {TRIES} times")

    def _written(self, rows: DataFrame) -> tuple[str, int]:
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{folder}")
        return folder, self.spark.read.parquet(f"{self.root}/{folder}").count()

    def replace(self, rows: DataFrame, ids: DataFrame | None = None) -> None:
        """Adds rows; with ids (one column), in place of all older rows of these items. ids without rows: deletes the items."""
        folder, n = self._written(rows)
        gone, n_gone = self._written(ids.toDF("id").where("id is not null").distinct()) if ids is not None else (None, 0)
        self._change(lambda number, segments: [*segments, Segment(number, folder, n, gone, n_gone)])

    def delete(self, ids: DataFrame) -> None:
        gone, n_gone = self._written(ids.toDF("id").where("id is not null").distinct())
        self._change(lambda number, segments: [*segments, Segment(number, None, 0, gone, n_gone)])

    def _live(self, chosen: list[Segment], all_: list[Segment]) -> DataFrame | None:
        rows = None
        for s in chosen:
            if s.rows is None:
                continue
            own = self.spark.read.parquet(f"{self.root}/{s.rows}").withColumn("__number", F.lit(s.number))
            rows = own if rows is None else rows.unionByName(own)
        first = min((s.number for s in chosen if s.rows), default=0)
        lists = [s for s in all_ if s.n_gone and s.number > first]
        if rows is None or not lists:
            return rows.drop("__number") if rows is not None else None
        gone = None
        for s in lists:
            own = self.spark.read.parquet(f"{self.root}/{s.gone}").select(F.col("id").alias("__gone"), F.lit(s.number).alias("__from"))
            gone = own if gone is None else gone.unionByName(own)
        gone = gone.groupBy("__gone").agg(F.max("__from").alias("__from"))
        gone = F.broadcast(gone) if sum(s.n_gone for s in lists) <= BROADCAST else gone
        return rows.join(gone, (F.col(self.item) == F.col("__gone")) & (F.col("__number") < F.col("__from")), "left_anti").drop("__number")

    def table(self) -> DataFrame:
        """All live rows."""
        _, segments = self.manifest()
        found = self._live(segments, segments)
        if found is None:
            raise LookupError(f"{self.root} has no rows yet")
        return found

    def merge(self) -> bool:
        """Merges the segments of the smallest tier that has MERGE of them; whether there was one."""
        _, segments = self.manifest()
        tiers: dict[int, list[Segment]] = {}
        for s in (s for s in segments if s.rows):
            tier = 0
            while s.n_rows > LEAST * GROWTH**tier:
                tier += 1
            tiers.setdefault(tier, []).append(s)
        full = [tiers[t] for t in sorted(tiers) if len(tiers[t]) >= MERGE]
        if not full:
            return False
        old = full[0]
        live = self._live(old, segments)
        folder, n = self._written(live) if live is not None else (None, 0)
        numbers = {s.number for s in old}

        def change(_: int, now: list[Segment]) -> list[Segment] | None:
            if not numbers <= {s.number for s in now if s.rows}:
                return None  # another one merged them
            # the merged rows are as new as the newest of them; a list stays as long as an older segment has rows
            newest = max(numbers)
            after = {s.number: (Segment(s.number, None, 0, s.gone, s.n_gone) if s.number in numbers else s) for s in now}
            if n:
                after[newest] = Segment(newest, folder, n, after[newest].gone, after[newest].n_gone)
            oldest = min((s.number for s in after.values() if s.rows), default=newest)
            return [s for _, s in sorted(after.items()) if s.rows or (s.n_gone and s.number > oldest)]

        return self._change(change)

    def orphans(self) -> list[str]:
        """Folders of data that no manifest names: what a writer left that failed, and what was merged."""
        _, segments = self.manifest()
        used = {f.removeprefix("data/") for s in segments for f in (s.rows, s.gone) if f}
        return [n for n in self._names("data") if n not in used]

    def sweep(self) -> int:
        """Deletes orphans and all manifests but the newest. Not while others write or read older manifests."""
        orphans, (newest, _) = self.orphans(), self.manifest()
        for name in orphans:
            self._fs.delete(self._path("data", name), True)
        for name in self._names("log"):
            if int(name) < newest:
                self._fs.delete(self._path("log", name), False)
        return len(orphans)
