"""Tables as immutable versions with a pointer: updates, upserts, cascades, snapshots, restores, migrations."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA_VERSION, SNAPSHOTS = 2, 5


def update_rows(rows: DataFrame, where: Column, **values) -> DataFrame:
    """rows with new values where the condition holds."""
    for name in values:
        if name not in rows.columns:
            raise ValueError(f"no such column: {name}")
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return rows.withColumns({k: F.when(where, lit(v)).otherwise(F.col(k)) for k, v in values.items()})


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that comes last."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` in place of old ones with the same key; of several new ones any that is largest in all its columns' order."""
    best = new.groupBy(*keys).agg(F.max(F.struct(*[c for c in new.columns if c not in keys])).alias("__v")).select(*keys, "__v.*")
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(best.select(*old.columns))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def cascade_delete(tables: dict[str, DataFrame], ids: DataFrame, parent: str = "items") -> dict[str, DataFrame]:
    """Every table without the rows of the ids: the parent by id, children by item_id."""
    gone = ids.select(F.col("id").alias("__gone")).distinct()
    key = {name: "id" if name == parent else "item_id" for name in tables}
    return {name: rows.join(gone, F.col(key[name]) == F.col("__gone"), "left_anti") if key[name] in rows.columns else rows for name, rows in tables.items()}


def drop_space(embeddings: DataFrame, items: DataFrame, space: str) -> tuple[DataFrame, DataFrame]:
    """Embeddings without the space, and a job for every item."""
    return embeddings.where(F.col("space") != space), requeued(items)


def requeued(items: DataFrame) -> DataFrame:
    return items.select(F.col("id").alias("item_id"), F.concat(F.lit("index_"), "kind").alias("type"), F.lit("queued").alias("status"), F.lit(0.0).alias("progress"))


class Store:
    """Versions of a set of tables below a folder. A small text table `current` names the version in force."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _names(self, *parts: str) -> list[str]:
        p = self._path(*parts)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _note(self, name: str, value: str) -> None:
        out = self._fs.create(self._path(name), True)
        out.write(value.encode())
        out.close()

    def _noted(self, name: str) -> str | None:
        if not self._fs.exists(self._path(name)):
            return None
        return self.spark.read.text(f"{self.root}/{name}").first()[0]

    @property
    def version(self) -> str | None:
        return self._noted("current")

    @property
    def schema_version(self) -> int:
        return int(self._noted("schema_version") or 1)

    def write(self, tables: dict[str, DataFrame], version: str) -> None:
        """All tables are written before the pointer moves."""
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.root}/versions/{version}/{name}")
        self._note("current", version)

    def read(self, version: str | None = None) -> dict[str, DataFrame]:
        version = version or self.version
        return {n: self.spark.read.parquet(f"{self.root}/versions/{version}/{n}") for n in self._names("versions", version)} if version else {}

    def snapshots(self) -> list[str]:
        return [n for n in self._names("snapshots") if n.startswith("library-")]

    def snapshot(self, moment: str, reason: str, keep: int = SNAPSHOTS) -> str:
        """moment: YYYYMMDD-HHMMSSmmm. Verified by counts; the newest `keep` stay."""
        if not re.fullmatch(r"\d{8}-\d{9}", moment) or not re.fullmatch(r"[\w-]+", reason):
            raise ValueError("a snapshot needs a moment YYYYMMDD-HHMMSSmmm and a plain reason")
        name = f"library-{moment}-{reason}"
        for table, rows in self.read().items():
            path = f"{self.root}/snapshots/{name}/{table}"
            rows.write.mode("overwrite").parquet(path)
            if self.spark.read.parquet(path).count() != rows.count():
                raise RuntimeError(f"snapshot of {table} is not whole")
        for old in self.snapshots()[:-keep]:
            self._fs.delete(self._path("snapshots", old), True)
        return name

    def request_restore(self, name: str) -> None:
        if name not in self.snapshots():
            raise KeyError(name)
        self._note("restore", name)

    def cancel_restore(self) -> bool:
        return self._fs.delete(self._path("restore"), False)

    def apply_restore(self) -> str | None:
        """At the start of a session: the requested snapshot becomes a version of its own; the replaced one stays on disk."""
        name = self._noted("restore")
        if name is None:
            return None
        tables = {t: self.spark.read.parquet(f"{self.root}/snapshots/{name}/{t}") for t in self._names("snapshots", name)}
        self.write(tables, f"restored-{name}")
        self.cancel_restore()
        return name

    def migrate(self, steps: dict[int, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]], moment: str) -> int:
        """Runs the steps above the schema's version in order; a failing step leaves the version in force as it was."""
        have, want = self.schema_version, max(steps, default=1)
        if have > want:
            raise RuntimeError(f"the tables have schema {have}, newer than {want}")
        for n in sorted(k for k in steps if k > have):
            self.snapshot(moment, f"before-{n}")
            self.write(steps[n](self.read()), f"schema-{n}-{moment}")
            self._note("schema_version", str(n))
        return want
