"""Files as rows: kinds by suffix, hashes, metadata, query pairs, a synthetic library, and sinks."""

from __future__ import annotations

import time
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.functions.text import content_hash, default_label, parse_moment, safe_name, stem, unique_names

#: Suffixes by kind.
SUFFIXES = {
    "image": ("jpg", "jpeg", "png", "webp", "bmp", "gif", "tif", "tiff"),
    "video": ("mp4", "mov", "mkv", "avi", "webm", "m4v"),
    "audio": ("mp3", "wav", "m4a", "ogg", "opus", "flac", "aac"),
    "text": ("txt", "md"),
}


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def kind_of(path: Column) -> Column:
    """The kind by suffix; null for files that are not supported."""
    found = F.lit(None).cast("string")
    for kind, known in SUFFIXES.items():
        found = F.when(suffix(path).isin(*known), kind).otherwise(found)
    return found


def scan(spark: SparkSession, path: str, content: bool = True) -> tuple[DataFrame, DataFrame]:
    """Prepared rows of supported files, and rejected paths with the reason."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).withColumn("kind", kind_of(F.col("path")))
    if not content:
        return files.select("path", "kind", "length", "modificationTime"), files.where("kind is null").select("path")
    text = F.when(F.col("kind") == "text", F.make_valid_utf8(F.col("content").cast("string")))
    good = files.where("kind is not null").select(
        "kind",
        stem(F.col("path")).alias("label"),
        F.col("path").alias("source_path"),
        F.sha2("content", 256).alias("content_hash"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("created_at"),
        text.alias("text_content"),
    )
    return good, files.where("kind is null").select("path", F.lit("unsupported file").alias("error"))


def stored_path(content_hash: Column, source_path: Column) -> Column:
    """Content-addressed: the folder is the hash's first two digits."""
    return F.concat(F.lit("originals/"), F.left(content_hash, F.lit(2)), F.lit("/"), content_hash, F.lit("."), suffix(source_path))


def prepare_texts(texts: DataFrame, text_col: str = "text", label_col: str | None = None) -> DataFrame:
    """Pasted notes: trimmed, blank ones left out."""
    text = F.regexp_replace(F.col(text_col), r"^\s+|\s+$", "")
    label = default_label(text) if label_col is None else F.coalesce(F.nullif(F.trim(F.col(label_col)), F.lit("")), default_label(text))
    rows = texts.select(F.lit("text").alias("kind"), label.alias("label"), content_hash(text).alias("content_hash"), F.octet_length(text).cast("long").alias("size_bytes"), text.alias("text_content"))
    return rows.where(F.length("text_content") > 0)


def camera_moment(original: Column, changed: Column, modified: Column) -> Column:
    """The moment of a picture: its first tag that is a date, else the file's time."""
    return F.coalesce(parse_moment(original), parse_moment(changed), modified)


PROBE = "format struct<duration: string, tags: struct<creation_time: string>>, streams array<struct<codec_type: string, width: int, height: int>>"


def media_metadata(probe: Column) -> Column:
    """duration_s, width, height, created_at from a media probe's JSON."""
    p = F.from_json(probe, PROBE)
    video = F.get(F.filter(p["streams"], lambda s: s["codec_type"] == "video"), 0)
    return F.struct(p["format"]["duration"].cast("double").alias("duration_s"), video["width"].alias("width"), video["height"].alias("height"), parse_moment(p["format"]["tags"]["creation_time"]).alias("created_at"))


def query_pairs(spark: SparkSession, path: str) -> DataFrame:
    """query, target from lines "query | target"; lines with # are comments."""
    parts = F.split("value", r"\|", 2)
    rows = spark.read.text(path).where(~F.trim("value").startswith("#") & F.col("value").contains("|"))
    return rows.select(F.trim(F.get(parts, 0)).alias("query"), F.trim(F.get(parts, 1)).alias("target"))


def export_notes(items: DataFrame, path: str) -> DataFrame:
    """Writes notes as text, one folder a name; returns the names."""
    named = items.where("text_content is not null").select(safe_name(F.col("label")).alias("name"), F.col("text_content").alias("value"))
    named.write.mode("overwrite").partitionBy("name").text(path)
    return named.select("name")


def copied(files: DataFrame, root: str, source_col: str = "path", target_col: str = "target") -> DataFrame:
    """Copies each file to its target below root, where it isn't there yet: source, target, copied, error.

    A copy is written under a name of its own and moved, so repeated tasks do no harm; a file that can't be copied is a row with an error and stops no other.
    """

    def run(batches):
        from pyarrow import fs

        to, base = fs.FileSystem.from_uri(root)
        for b in batches:
            rows = []
            for source, target in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                done, error = False, None
                try:
                    path = f"{base}/{target}"
                    if to.get_file_info(path).type == fs.FileType.NotFound:
                        of, where = fs.FileSystem.from_uri(source if ":" in source else f"file://{source}")
                        to.create_dir(path.rsplit("/", 1)[0], recursive=True)
                        own = f"{path}.{uuid.uuid4().hex}"
                        fs.copy_files(where, own, source_filesystem=of, destination_filesystem=to)
                        to.move(own, path)
                        done = True
                except Exception as e:  # whatever is wrong with one file is its row's
                    error = f"{type(e).__name__}: {e}"
                rows.append((source, target, done, error))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_(), pa.string()))], names=["source", "target", "copied", "error"])

    return files.select(F.col(source_col).cast("string"), F.col(target_col).cast("string")).mapInArrow(run, "source string, target string, copied boolean, error string")


def store_originals(scanned: DataFrame, root: str) -> DataFrame:
    """The files of `scan` copied to where their content hash puts them; files of equal content are one."""
    once = scanned.groupBy(stored_path(F.col("content_hash"), F.col("source_path")).alias("target")).agg(F.min("source_path").alias("path"))
    return copied(once, root)


def export_originals(items: DataFrame, root: str, target: str) -> DataFrame:
    """Stored originals below root copied to the folder target under their labels: source, target, copied, error. Items of one label are told apart by number."""
    named = items.where("stored_path is not null").select("id", safe_name(F.col("label")).alias("name"), "stored_path", suffix(F.col("stored_path")).alias("suffix"))
    named = unique_names(named, "name", "id").withColumn("target", F.concat("name", F.when(F.col("suffix") != "", F.concat(F.lit("."), "suffix")).otherwise("")))
    return copied(named.select(F.concat(F.lit(root.rstrip("/") + "/"), "stored_path").alias("path"), "target"), target)


def directory_size(spark: SparkSession, path: str) -> int:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


class Sizes:
    """Sizes of directories that are looked up again only after `seconds`."""

    def __init__(self, spark: SparkSession, seconds: float = 60.0, clock=time.monotonic):
        self.spark, self.seconds, self.clock, self.known = spark, seconds, clock, {}

    def of(self, path: str) -> int:
        at, size = self.known.get(path, (None, 0))
        if at is None or self.clock() - at >= self.seconds:
            size = directory_size(self.spark, path)
            self.known[path] = (self.clock(), size)
        return size


VOCABULARY = "river stone light winter garden window paper music letter morning city forest road bridge market story summer water mountain silence".split()


def synthetic(spark: SparkSession, n: int, dim: int = 64, shape: str = "mixed", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Items and embeddings of a library made by rule: `mixed` has pictures, videos and notes, `media` videos and recordings."""
    i = F.col("id")
    if shape == "mixed":
        kind = F.when(i % 3 != 0, "image").when(i % 2 == 1, "video").otherwise("text")
        n_frames, n_chunks = F.when(i % 3 != 0, 1).when(i % 2 == 1, 4).otherwise(0), F.when(i % 3 != 0, 0).otherwise(2)
    elif shape == "media":
        kind = F.when(i % 2 == 1, "video").otherwise("audio")
        n_frames, n_chunks = F.when(i % 2 == 1, 12).otherwise(0), F.lit(8)
    else:
        raise ValueError(f"no such shape: {shape}")
    vocabulary = F.array(*[F.lit(w) for w in VOCABULARY])
    rows = spark.range(n).withColumn("kind", kind)
    parts = F.concat(
        F.flatten(F.transform(F.sequence(F.lit(0), n_frames), lambda f: F.when(f < n_frames, F.array(F.struct(F.lit("image_a").alias("space"), f.alias("ix"), (f * 7.0).alias("ts_s")), F.struct(F.lit("image_b").alias("space"), f.alias("ix"), (f * 7.0).alias("ts_s")))).otherwise(F.array()))),
        F.flatten(F.transform(F.sequence(F.lit(0), n_chunks), lambda c: F.when(c < n_chunks, F.array(F.struct(F.lit("text").alias("space"), c.alias("ix"), (c * 15.0).alias("ts_s")))).otherwise(F.array()))),
    )
    unit = lambda *k: F.pmod(F.xxhash64(*k, F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    # Box and Muller's normal numbers from hashes
    normal = lambda d: F.sqrt(-2 * F.log(unit(i, F.col("p.space"), F.col("p.ix"), d, F.lit(1)) + 1e-9)) * F.cos(6.283185307179586 * unit(i, F.col("p.space"), F.col("p.ix"), d, F.lit(2)))
    e = rows.select("id", F.explode(parts).alias("p")).withColumn("raw", F.transform(F.sequence(F.lit(1), F.lit(dim)), normal))
    length = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda t, x: t + x * x))
    words = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda w: F.get(vocabulary, F.pmod(F.xxhash64(i, F.col("p.ix"), w, F.lit(seed)), F.size(vocabulary)).cast("int")))
    e = e.select(
        F.col("id").alias("item_id"), "p.space", F.col("p.ix").alias("ix"), "p.ts_s", F.when(F.col("p.space") == "text", F.array_join(words, " ")).alias("chunk_text"),
        F.transform("raw", lambda x: (x / length).cast("float")).alias("embedding"),
    )
    return rows.withColumn("created_at", F.lit("2026-01-01 00:00:00").cast("timestamp")), e
