"""Tags, jobs, counts, and changes of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.scoring import clamp, out_of_memory
from holdfast.sources.store import insert_ignore, update_rows

JOB_ORDER = ("running", "failed", "queued", "done")
LISTED, SHOWN_PROGRESS = 100, 20
NO_AUDIO, CANCELLED = "no audio track", "cancelled"
FRIENDLY_MEMORY = "not enough memory: close other programs and try again"


def tag_usage(tags: DataFrame, item_tags: DataFrame) -> DataFrame:
    """name, n_items of every tag, also unused ones; in order without regard to case."""
    counts = item_tags.groupBy("tag_id").agg(F.count("item_id").alias("n_items"))
    return tags.join(counts, "tag_id", "left").select("name", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items")).orderBy(F.lower("name"), "name")


def tags_of_items(tags: DataFrame, item_tags: DataFrame) -> DataFrame:
    names = item_tags.join(tags, "tag_id").groupBy("item_id").agg(F.collect_list("name").alias("n"))
    key = F.transform("n", lambda x: F.struct(F.lower(x).alias("k"), x.alias("v")))
    return names.select("item_id", F.transform(F.array_sort(key), lambda s: s["v"]).alias("tags"))


def create_tag(tags: DataFrame, name: str) -> DataFrame:
    """Raises if the name is blank or taken (names differ by case)."""
    name = name.strip()
    if not name:
        raise ValueError("a tag needs a name")
    if not tags.where(F.col("name") == name).isEmpty():
        raise FileExistsError(name)
    return tags.unionByName(tags.sparkSession.range(1).select(F.lit(name).alias("tag_id"), F.lit(name).alias("name")))


def rename_tag(tags: DataFrame, old: str, new: str) -> DataFrame:
    new = new.strip()
    if new != old and not tags.where(F.col("name") == new).isEmpty():
        raise FileExistsError(new)
    return update_rows(tags, F.col("name") == old, name=new)


def delete_tag(tags: DataFrame, item_tags: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    gone = tags.where(F.col("name") == name).select("tag_id")
    return tags.join(gone, "tag_id", "left_anti"), item_tags.join(gone, "tag_id", "left_anti")


def set_tags(tags: DataFrame, item_tags: DataFrame, item_id: int, names: list[str]) -> DataFrame:
    """Replaces an item's tags; unknown names are left out."""
    own = tags.where(F.col("name").isin(names)).select(F.lit(item_id).cast("long").alias("item_id"), "tag_id")
    return item_tags.where(F.col("item_id") != item_id).unionByName(own.select(*item_tags.columns))


def add_tag(item_tags: DataFrame, tag_id: str, ids: DataFrame) -> DataFrame:
    return insert_ignore(item_tags, ids.select(F.col("id").alias("item_id"), F.lit(tag_id).alias("tag_id")), ["item_id", "tag_id"])


def patch_item(items: DataFrame, item_id: int, label: str | None = None, transcript: str | None = None) -> DataFrame:
    """A blank label keeps the old one; a new transcript is marked as edited."""
    here = F.col("id") == item_id
    if label is not None and label.strip():
        items = update_rows(items, here, label=label.strip())
    if transcript is not None:
        changed = here & ~F.col("transcript").eqNullSafe(F.lit(transcript))
        items = update_rows(items, changed, transcript_edited=True, transcript=transcript)
    return items


def job_rank(status: Column) -> Column:
    rank = F.lit(len(JOB_ORDER))
    for i, s in enumerate(JOB_ORDER):
        rank = F.when(status == s, i).otherwise(rank)
    return rank


def job_list(jobs: DataFrame, items: DataFrame, limit: int = LISTED) -> DataFrame:
    """Running, failed, queued, done; then by id. The limit comes before the join, which keeps every job."""
    first = jobs.orderBy(job_rank(F.col("status")), "id").limit(limit)
    return first.join(items.select(F.col("id").alias("__id"), "label"), F.col("item_id") == F.col("__id"), "left").drop("__id")


def job_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def next_job(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'queued'").orderBy("id").limit(1)


def running_progress(jobs: DataFrame, shown: int = SHOWN_PROGRESS) -> DataFrame:
    """The mean progress of the running jobs among the first that are listed; 0 if there are none."""
    first = jobs.orderBy(job_rank(F.col("status")), "id").limit(shown).where("status = 'running'")
    return first.agg(F.coalesce(F.avg(clamp(F.col("progress"))), F.lit(0.0)).alias("progress"))


def unfinished_first(added: DataFrame, jobs: DataFrame) -> DataFrame:
    """Items added in a session, then unfinished jobs that aren't among them."""
    rest = jobs.where("status in ('queued', 'running')").join(added, "item_id", "left_anti").select("item_id").distinct()
    return added.select("item_id", F.lit(0).alias("part")).unionByName(rest.select("item_id", F.lit(1).alias("part")))


def stats(items: DataFrame, embeddings: DataFrame) -> DataFrame:
    one = items.agg(F.count(F.lit(1)).alias("n_items"), F.coalesce(F.sum(F.when(F.col("stored_path").isNotNull(), F.col("size_bytes"))), F.lit(0)).alias("stored_bytes"))
    return one.crossJoin(embeddings.agg(F.count(F.lit(1)).alias("n_vectors")))


def item_status(job_status: Column, error: Column) -> Column:
    """The state of an item after its last job."""
    soft = error.isin(NO_AUDIO, CANCELLED)
    return F.when(job_status == "running", "processing").when((job_status == "failed") & ~F.coalesce(soft, F.lit(False)), "failed").when(job_status.isin("done", "failed"), "ready").otherwise("pending")


def friendly_error(error: Column) -> Column:
    return F.when(out_of_memory(error), FRIENDLY_MEMORY).otherwise(error)


def best_language(rows: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """Of each item the likeliest language among the known ones."""
    return rows.where(F.col("lang").isin(*known)).groupBy("item_id").agg(F.max_by("lang", F.struct("probability", "lang")).alias("lang"))


def merged_fields(server: DataFrame, local: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows of the server with the fields that were edited here (edited: array of names)."""
    own = local.select(F.col(key).alias("__k"), "edited", *[F.col(f).alias(f"__{f}") for f in fields])
    rows = server.join(own, F.col(key) == F.col("__k"), "left")
    value = lambda f: F.when(F.coalesce(F.array_contains("edited", f), F.lit(False)), F.col(f"__{f}")).otherwise(F.col(f)).alias(f)
    return rows.select(*[value(c) if c in fields else F.col(c) for c in server.columns])
