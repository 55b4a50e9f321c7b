"""License scans by diagonal voting.

Templates are word sequences. All rolling word k-grams of a text (k as the templates have it) are hashed; those whose hash
is a template's are joined by Spark to the template positions and their words compared. Votes are
summed by offset diagonal (place in the text less place in the template): a line. Lines on neighbouring diagonals, up to `shift` apart, that
overlap or adjoin in the text are merged if each adds words of the template that the other lacks, so words put in or left
out do not break a match, while copies that stand one after the other stay apart. A span is verified if it
covers the share of words that its template asks for (all words of a short one). Base phrases are templates with shift 0, so every
whole diagonal is a place.

The hashes of at most SENT_POSITIONS template positions go to the tasks, which then emit the grams that have one of them; with more
templates every gram is emitted and the join does all the work.

Words are runs outside \\x00-\\x2F, \\x3A-\\x60, \\x7B-\\x7F after lower-casing A-Z. Defined results: a null text is empty; a
text without matches has 0 places, null first and last word, empty labels and score 0; repeated rows give repeated
results; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.common import small_batches
from holdfast.llm.shingles import WordHashes, windows

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG_K, SHORT_K, LONG_FROM, SHIFT, COVERAGE = 3, 2, 8, 3, 0.75
#: Template positions up to which their table and hashes are sent to the tasks (a few MB).
SENT_POSITIONS = 100_000


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return words_of(self.text)

    @property
    def k(self) -> int:
        n = len(self.words)
        return n if self.base else min(n, LONG_K if n >= LONG_FROM else SHORT_K)

    @property
    def shift(self) -> int:
        return 0 if self.base else SHIFT

    @property
    def coverage(self) -> float:
        return COVERAGE if len(self.words) >= LONG_FROM else 1.0


#: The base phrases, and notices of public licences.
TEMPLATES = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("mit", "Released under the MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    Template("cc0", "dedicated to the public domain under CC0 1.0 Universal"),
)


def words_of(text: str | None) -> list[str]:
    return [w.decode("utf-8", "surrogatepass") for w in WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())]


class Vocabulary(dict):
    """Hashes of the templates' words; 0 for any other."""

    def __missing__(self, word: bytes) -> int:
        return 0


def vocabulary(templates) -> Vocabulary:
    return Vocabulary({w.encode(): xxhash.xxh3_64_intdigest(w.encode()) for t in templates for w in t.words})


def gram_hashes(hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-grams of words that are all known."""
    if len(hashes) < k:
        return np.array([], np.int64), np.array([], np.int64)
    unknown = np.concatenate([[0], np.cumsum(hashes == 0)])
    at = np.nonzero(unknown[k:] == unknown[:-k])[0]
    return at, windows(hashes, k)[at].view(np.int64) if len(at) else np.array([], np.int64)


def template_rows(templates) -> list[tuple]:
    """template, label, base, n, k, place, hash, gram of every template position."""
    known, out = vocabulary(templates), []
    for i, t in enumerate(templates):
        words = t.words
        at, hashes = gram_hashes(np.array([known[w.encode()] for w in words], np.uint64), t.k)
        out += [(i, t.label, t.base, len(words), t.k, int(p), int(h), " ".join(words[p : p + t.k])) for p, h in zip(at, hashes, strict=True)]
    return out


def _hits(templates, sent: bool):
    known = vocabulary(templates) if sent else WordHashes()
    rows = template_rows(templates) if sent else []
    sought = {k: np.unique(np.array([r[6] for r in rows if r[4] == k], np.int64)) for k in sorted({t.k for t in templates})}

    def run(batches):
        for b in batches:
            counts, ends, flat = [], [0], []
            for t in b.column(2):
                words = WORD.findall((t.as_py() or "").encode("utf-8", "surrogatepass").lower())
                h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                counts.append(len(words))
                for k, all_ in sought.items():
                    at, hashes = gram_hashes(h, k)
                    if sent:
                        keep = np.isin(hashes, all_)
                        at, hashes = at[keep], hashes[keep]
                    flat += [(k, p, v, b" ".join(words[p : p + k]).decode("utf-8", "surrogatepass")) for p, v in zip(at.tolist(), hashes.tolist(), strict=True)]
                ends.append(len(flat))
            hits = pa.StructArray.from_arrays([pa.array([f[i] for f in flat], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.string()))], names=["k", "at", "hash", "gram"])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), hits)], names=["row_id", "doc_id", "n_words", "hits"])

    return run


def positions(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    rows = template_rows(templates)
    found = spark.createDataFrame(
        [(*r, templates[r[0]].shift, templates[r[0]].coverage) for r in rows],
        "template int, label string, base boolean, n int, k int, place int, hash long, gram string, shift int, least double",
    )
    return F.broadcast(found) if len(rows) <= SENT_POSITIONS else found


@dataclass
class Span:
    first: int
    last: int
    diagonal: int
    covered: set[int]


def merged(lines: list[tuple[int, int, int, list[int]]], shift: int) -> list[Span]:
    """Spans of one template's lines (first, last, diagonal, covered) in ascending order of their first words."""
    out: list[Span] = []
    live: list[Span] = []
    for first, last, diagonal, covered in lines:
        own = set(covered)
        live = [s for s in live if shift and first <= s.last + shift + 1]
        beside = [s for s in live if abs(diagonal - s.diagonal) <= shift and own - s.covered and s.covered - own]
        if beside:
            s = max(beside, key=lambda s: len(own - s.covered))
            s.last, s.diagonal = max(s.last, last), diagonal
            s.covered |= own
        else:
            live.append(Span(first, last, diagonal, own))
            out.append(live[-1])
    return out


SPANS = "row_id long, doc_id long, n_words long, spans array<struct<label: string, base: boolean, first: long, last: long, coverage: double>>"


def _spans(batches):
    """One row for each text from its lines, which come in the order of text, template and first word."""
    text, template, lines, found, out = None, None, [], [], []

    def end_template():
        if lines:
            for s in merged(lines, template["shift"]):
                coverage, length = len(s.covered) / template["n"], s.last - s.first + 1
                if coverage >= template["least"] and length <= 1.5 * template["n"] + template["shift"]:
                    found.append((template["label"], template["base"], s.first, s.last, coverage))

    def end_text():
        end_template()
        if text is not None:
            out.append((*text, sorted(found)))

    def flush():
        ends = np.cumsum([0] + [len(r[3]) for r in out], dtype=np.int32)
        flat = [s for r in out for s in r[3]]
        types = (pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.float64())
        spans = pa.StructArray.from_arrays([pa.array([s[i] for s in flat], t) for i, t in enumerate(types)], names=["label", "base", "first", "last", "coverage"])
        own = [pa.array([r[i] for r in out], pa.int64()) for i in range(3)]
        return pa.RecordBatch.from_arrays([*own, pa.ListArray.from_arrays(pa.array(ends), spans)], names=["row_id", "doc_id", "n_words", "spans"])

    for b in batches:
        for row in b.to_pylist():
            now = (row["row_id"], row["doc_id"], row["n_words"])
            if text is None or now[0] != text[0]:
                end_text()
                text, template, lines, found = now, None, [], []
            if row["template"] is None:
                continue
            if template is None or row["template"] != template["template"]:
                end_template()
                template, lines = row, []
            lines.append((row["first"], row["last"], row["diagonal"], row["covered"]))
        yield flush()
        out = []
    end_text()
    yield flush()


def scan(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id, doc_id, n_words, spans array<struct<label, base, first, last, coverage>> of every row; places count words from 0."""
    small_batches(docs.sparkSession)
    # rows are numbered for this pass only
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sent = len(template_rows(templates)) <= SENT_POSITIONS
    hits = rows.mapInArrow(_hits(templates, sent), "row_id long, doc_id long, n_words long, hits array<struct<k: int, at: long, hash: long, gram: string>>")
    # all that follows is by row: one exchange of the few hits and of a row for each text
    hits = hits.repartition("row_id").select("row_id", "doc_id", "n_words", F.explode_outer("hits").alias("h"))
    hits = hits.select("row_id", "doc_id", "n_words", "h.k", "h.at", "h.hash", "h.gram").join(positions(docs.sparkSession, templates), ["k", "hash", "gram"], "left")
    own = ["row_id", "doc_id", "n_words", "template", "label", "base", "n", "shift", "least"]
    words = F.sequence(F.col("place"), F.col("place") + F.col("k") - 1)
    lines = hits.groupBy(*own, (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.min("at").alias("first"), F.max(F.col("at") + F.col("k") - 1).alias("last"), F.array_distinct(F.flatten(F.collect_list(words))).alias("covered")
    )
    return lines.sortWithinPartitions("row_id", "template", "first", "diagonal").mapInArrow(_spans, SPANS)


def digest(spans: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    base = F.filter("spans", lambda s: s["base"])
    label = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["first"])
    score = F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0))
    return spans.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        label(base).alias("base_labels"),
        label(F.col("spans")).alias("labels"),
        score.alias("score"),
    )
