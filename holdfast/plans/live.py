"""A search index that follows its library: an edit of some items costs these items."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.operators import positions
from holdfast.operators import search as S
from holdfast.sources.library import CHUNKS_OF_ITEM, Library
from holdfast.sources.segments import Segments

TABLES = ("chunks", "postings", "positions", "words")


class LiveIndex:
    """Chunks, postings and positions of a library in segments below a folder. The dictionary of words only grows: it may name words that no live
    item has any more, which costs a look-up and finds nothing."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.tables = {name: Segments(spark, f"{root.rstrip('/')}/{name}") for name in TABLES}

    def index(self, library: Library, ids: DataFrame | None = None) -> None:
        """Indexes the library's items, or anew those whose ids (column id) are given; of these, items that are no longer there are taken out."""
        own = library if ids is None else replace(library, items=library.items.join(ids.select("id"), "id", "left_semi"), extra={})
        for name, rows in self._made(own).items():
            self.tables[name].replace(rows, ids.select("id") if ids is not None and name != "words" else None)

    def _made(self, own: Library) -> dict[str, DataFrame]:
        chunks = own.chunks.withColumn("length", F.size(S.tokens(F.col("chunk_text"))))
        item = F.floor(F.col("chunk_id") / CHUNKS_OF_ITEM).cast("long")
        places = positions.positions(own.items)
        return {"chunks": chunks, "postings": S.postings(own.chunks).withColumn("item_id", item).repartitionByRange("token"), "positions": places, "words": positions.dictionary(places)}

    def remove(self, ids: DataFrame) -> None:
        for name in TABLES:
            if name != "words":
                self.tables[name].delete(ids.select("id"))

    def merge(self) -> int:
        """Merges what is due in all tables; the number of merges."""
        n = 0
        for table in self.tables.values():
            while table.merge():
                n += 1
        return n

    def of(self, library: Library) -> Library:
        """The library with what is live in the index: searches use it as what `search.prepared` made."""
        live = {name: t.table() for name, t in self.tables.items()}
        stats = live["chunks"].agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean_length"))
        return replace(library, extra=library.extra | {"chunks": live["chunks"].drop("length"), "postings": live["postings"].drop("item_id"), "chunk_stats": stats, "positions": live["positions"], "words": live["words"]})
