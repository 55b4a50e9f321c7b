"""The folder that driver and executors share, and tables written there to cut a lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of the warehouse, and a temporary folder in local mode, which goes with the process."""
    if found := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        folder = tempfile.mkdtemp(prefix="holdfast-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        own = f"file://{folder}"
    else:
        own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: Folders made by this process that are still there.
MADE: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    MADE.append(f"{shared_dir(spark)}/holdfast/{uuid.uuid4().hex}")
    return f"{MADE[-1]}/{label}"


def remove(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if folder in MADE:
            MADE.remove(folder)


def clear_scratch(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Deletes what this process has written after its first `since` folders, but for the paths in keep; DataFrames that read
    the rest can't be used any more."""
    remove(spark, [f for f in MADE[since:] if not any(k.startswith(f) for k in keep)])


def write_table(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts the lineage, and a lost executor costs only tasks."""
    return write_table(df, label)[0]


class Scope:
    """The scratch tables of one run of an operator. `write` is materialise; `release` deletes all tables but those whose
    labels are given, which the operator's result still reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made = spark, []

    def write(self, df: DataFrame, label: str) -> DataFrame:
        table, path = write_table(df, label)
        self.made.append(path)
        return table

    def release(self, *kept: str, newest: bool = False) -> None:
        """newest: of several tables with one label only the last is kept."""
        last = {p.rsplit("/", 1)[1]: p for p in self.made}
        stay = [p for p in self.made if p.rsplit("/", 1)[1] in kept and (not newest or last[p.rsplit("/", 1)[1]] == p)]
        remove(self.spark, [p.rsplit("/", 1)[0] for p in self.made if p not in stay])
        self.made = stay
