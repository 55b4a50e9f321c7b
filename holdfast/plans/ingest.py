"""Ingest: files and notes to items, jobs, chunks and embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.embed import Registry, prefixed
from holdfast.functions.text import chunk_array, default_label, first_filled, segment_chunks, stem


def deduplicated(new: DataFrame, items: DataFrame) -> DataFrame:
    """new rows with `duplicate`: true if an item, or an earlier row, has the content hash; a null hash is never a duplicate."""
    known = items.where("content_hash is not null").select(F.col("content_hash").alias("__h")).distinct().withColumn("__known", F.lit(True))
    n = F.row_number().over(Window.partitionBy("content_hash").orderBy("id"))
    rows = new.withColumn("__n", n).join(known, F.col("content_hash") == F.col("__h"), "left")
    return rows.withColumn("duplicate", F.col("content_hash").isNotNull() & (F.coalesce("__known", F.lit(False)) | (F.col("__n") > 1))).drop("__n", "__h", "__known")


def dedup_by_hash(items: DataFrame) -> DataFrame:
    """content_hash, first_id, n of items with equal content."""
    return items.where("content_hash is not null").groupBy("content_hash").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")


def new_jobs(items: DataFrame) -> DataFrame:
    return items.select(F.col("id").alias("item_id"), F.concat(F.lit("index_"), "kind").alias("type"), F.lit("queued").alias("status"), F.lit(0.0).alias("progress"))


def transcript_chunks(items: DataFrame, segments: DataFrame) -> DataFrame:
    """item_id, chunk_ix, chunk_text, ts_s: by segments; items without any, and edited ones, by words and without times."""
    spoken = segments.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("ix", "start", "text"))).alias("s"))
    parts = F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["text"].alias("text")))
    rows = items.select(F.col("id").alias("item_id"), first_filled(F.col("transcript"), F.col("text_content")).alias("body"), "transcript_edited").join(spoken, "item_id", "left")
    timed = F.when(F.col("s").isNotNull() & ~F.coalesce("transcript_edited", F.lit(False)), segment_chunks(parts))
    plain = F.transform(chunk_array(F.col("body")), lambda t: F.struct(F.lit(None).cast("double").alias("ts_s"), t.alias("text")))
    return rows.select("item_id", F.posexplode(F.coalesce(timed, plain)).alias("chunk_ix", "c")).select("item_id", "chunk_ix", F.col("c.text").alias("chunk_text"), F.col("c.ts_s").alias("ts_s"))


def embedded(chunks: DataFrame, registry: Registry, space: str = "text") -> DataFrame:
    return chunks.withColumn("space", F.lit(space)).withColumn("embedding", registry.column(space, prefixed(F.col("chunk_text"), False)))


def frame_embeddings(frames: DataFrame, registry: Registry, spaces=("image_a", "image_b")) -> DataFrame:
    """A row for each frame and space; the stand-in embeds the path."""
    rows = None
    for s in spaces:
        own = frames.select("item_id", F.col("id").alias("frame_id"), "ts_s", F.lit(s).alias("space"), registry.column(s, F.col("path")).alias("embedding"))
        rows = own if rows is None else rows.unionByName(own)
    return rows


def relabelled(label: Column, source_path: Column, transcript: Column) -> Column:
    """A recording that still has its file's name gets the first words of its transcript."""
    return F.when((label == stem(source_path)) & (F.length(F.trim(transcript)) > 0), default_label(transcript)).otherwise(label)


def needs_recognition(edited: Column, transcript: Column) -> Column:
    return ~(F.coalesce(edited, F.lit(False)) & (F.length(F.trim(F.coalesce(transcript, F.lit("")))) > 0))
