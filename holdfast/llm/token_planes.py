"""Token ids in files of bit-shuffled blocks.

A text is encoded by the tokenizers library, and an end id is appended. Texts are dealt out by quantiles of a sample of their ids weighed by
their sizes, about FILE_BYTES of text a file, so the files together hold all ids in ascending order of the documents; an id (or null) with more
rows than a file takes is dealt out to several. A file holds blocks of BLOCK ids; of a block, the
bits (or bytes) of equal rank are gathered into planes, and each plane is compressed by zstandard. Planes of zeros take
no room. Layout, all numbers little-endian:

    "HFPLANE1", then for each block its planes, then the chunk index (for each block: offset u64, ids u32, planes u32 as a
    bit mask, the length u32 of each plane present), then the documents (id i64, has id u8, tokens u64 each), both
    compressed, then the footer: index length u32, documents length u32, blocks u32, documents u32, plane kind u8, "HFPLANE1"

A task writes under a name of its own and moves the file to its final name when whole, so a repeated task replaces it by
the same bytes. Files are written and read through pyarrow's file systems, by the URI of the folder.

Defined results: a null text is the empty text and has the end id only; null ids come first; rows with one id stand together, inside a file in
order of their texts; an empty table gives no file and no rows; other columns are ignored.
"""

from __future__ import annotations

import gc
import re
import struct
import uuid
import zlib
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdfast.llm.common import Scope, numbered, scratch_path, small_batches
from holdfast.llm.sharding import Cells

MAGIC, FOOTER = b"HFPLANE1", "<IIIIB8s"
BLOCK, LEVEL, END_ID = 1 << 16, 3, 0
#: Bytes of text meant for a file, and the fewest files.
FILE_BYTES, LEAST_FILES = 1 << 28, 12
#: Sampled ids for each file: files differ by some per cent.
SAMPLES = 500
#: What a worker remembers of pieces of text and their ids: bytes in all (as far as they are counted, the store is emptied when full), and in a piece.
REMEMBERED, LONGEST_PIECE = 400 << 20, 64
#: Bytes that a piece in the store takes beside its characters and ids, and how many new pieces go through the library as one text.
ENTRY, JOINED = 150, 2048
#: Texts cut at a time: few, so that their pieces stay in the cache of the processor.
TEXTS = 32


#: White space other than the space and the line feed, and the separator of first pieces: texts that have any are cut only after a closer look.
RARE = [chr(i) for i in (0, *range(9, 0x3001)) if i not in (10, 32) and (chr(i).isspace() or not i)]

RARE_ASCII = [c for c in RARE if c.isascii()]


#: A word with a tail of punctuation: the pre-tokenizer parts them.
TAILED = re.compile(r"(\0?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,:;!?#$%&*|]+)")


def atoms(piece: str) -> list[str]:
    """What the pre-tokenizer makes of a piece at line feeds and before tails of punctuation; the zero character stands for no space."""
    if "\n" in piece:
        lines = piece.split("\n")
        if all(x and x != "\0" and not x[0].isspace() and not x[-1].isspace() for x in lines):
            out = atoms(lines[0])
            for x in lines[1:]:
                out += ["\n", *atoms("\0" + x)]
            return out
    m = None if piece[-1:].isalnum() else TAILED.fullmatch(piece)
    return [m[1], "\0" + m[2]] if m else [piece]


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    The byte-level pre-tokenizer starts a new piece at every single space between two other characters that are not white
    space, so a text is cut there, and each distinct piece goes through the library once. New pieces go through it joined, where
    the same rule keeps them apart, and their ids are told from each other by the bytes that each id stands for; the first
    pieces of texts stand after a line feed, which is a piece of its own there. A text with any other white space beside a space, or at
    its ends, goes through the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: By piece without its space; a text's first piece stands after a zero character.
        self.line_feed = self._ids(["\n"])[0].tobytes()
        self.known: dict[str, bytes] = {}
        self.held = REMEMBERED
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        # in the byte-level alphabet a character is a byte
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.size[i] = len(token)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _plain(text: str) -> bool:
        """Whether no white space stands beside a space or at the ends."""
        if "  " in text or text[0].isspace() or text[-1].isspace() or ("\n" in text and (" \n" in text or "\n " in text)):
            return False
        return not any(c in text and (not ord(c) or f" {c}" in text or f"{c} " in text) for c in (RARE_ASCII if text.isascii() else RARE))

    def _learn(self, pieces: list[str]) -> None:
        for i in range(0, len(pieces), JOINED):
            part = pieces[i : i + JOINED]
            text = ["\n" + p[1:] if p[0] == "\0" else " " + p for p in part]
            (ids,) = self._ids(["".join(text)])
            ends = np.cumsum(self.size[ids])
            stop = np.cumsum([len(t.encode()) for t in text])
            last = np.searchsorted(ends, stop, side="right")
            first = np.concatenate([[0], last[:-1]]) + np.array([t[0] == "\n" for t in text])
            if not (len(ids) and (ends[last - 1] == stop).all()):
                raise ValueError("the tokenizer joined pieces: not a byte-level one")
            raw = ids.tobytes()
            self.known.update(zip(part, [raw[4 * a : 4 * b] for a, b in zip(first.tolist(), last.tolist(), strict=True)], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        return [ids for i in range(0, len(texts), TEXTS) for ids in self._encode(texts[i : i + TEXTS])]

    def _encode(self, texts: list[str]) -> list[bytes]:
        if self.held >= REMEMBERED:
            self.known, self.held = {"\n": self.line_feed}, 0
        get, wanted, cut, whole = self.known.get, set(), [], []
        for t in texts:
            if not t or not self._plain(t):
                whole.append(t)
                cut.append(None)
                continue
            pieces = t.split(" ")
            pieces[0] = "\0" + pieces[0]
            found = list(map(get, pieces))
            # no piece has no ids, so what is not known is what is false
            new_at = list(compress(range(len(found)), map(not_, found)))
            wanted.update([pieces[i] for i in new_at])
            cut.append((pieces, found, new_at))
        # a piece of letters and digits is its own only atom
        made = {p: atoms(p) for p in wanted if not p.isalnum()}
        new = list({a for x in made.values() for a in x}.union(wanted.difference(made)).difference(self.known))
        self._learn(new)
        parted = [p for p, x in made.items() if len(x) > 1]
        self.known.update(zip(parted, [b"".join(map(get, made[p])) for p in parted], strict=True))
        odd = iter(self._ids(whole))
        out = []
        for c in cut:
            if c is None:
                out.append(next(odd).tobytes())
                continue
            pieces, found, new_at = c
            for i in new_at:
                found[i] = get(pieces[i])
            out.append(b"".join(found))
        new += parted
        if new and max(map(len, new)) > LONGEST_PIECE:
            # long pieces, such as sentences in scripts without spaces, hardly come again
            for p in [p for p in new if len(p) > LONGEST_PIECE]:
                del self.known[p]
            new = [p for p in new if len(p) <= LONGEST_PIECE]
        self.held += len(new) * ENTRY + sum(map(len, new)) + sum(map(len, map(get, new)))
        return out


#: The encoders of this Python worker by tokenizer: what a task has learnt serves the worker's next one.
ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


def split_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of one block, lowest rank first."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [octets[:, i].tobytes() for i in range(4)]
    out = []
    for i in range(4):
        column = np.ascontiguousarray(octets[:, i])
        out += [np.packbits(column & np.uint8(1 << k), bitorder="little").tobytes() for k in range(8)] if column.any() else [b""] * 8
    return out


def join_planes(planes: dict[int, bytes], n: int, kind: str) -> np.ndarray:
    octets = np.zeros((4, n), np.uint8)
    for i, p in planes.items():
        if kind == "byte":
            octets[i] = np.frombuffer(p, np.uint8)
        else:
            octets[i // 8] |= np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") << np.uint8(i % 8)
    return np.ascontiguousarray(octets.T).reshape(-1).view("<u4")


class PlaneWriter:
    """Writes ids to a binary file object, a block at a time."""

    def __init__(self, out, kind: str = "bit", block: int = BLOCK):
        self.out, self.kind, self.block, self.at = out, kind, block, len(MAGIC)
        self.zip = zstandard.ZstdCompressor(level=LEVEL)
        self.waiting, self.n_waiting, self.index, self.documents, self.blocks = [], 0, [], [], 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.documents.append(struct.pack("<qBQ", doc_id or 0, doc_id is not None, len(ids) // 4))
        self.waiting.append(ids)
        self.n_waiting += len(ids) // 4
        if self.n_waiting >= self.block:
            joined = np.frombuffer(b"".join(self.waiting), "<u4")
            whole = len(joined) // self.block * self.block
            for i in range(0, whole, self.block):
                self._block(joined[i : i + self.block])
            self.waiting, self.n_waiting = [joined[whole:].tobytes()], len(joined) - whole

    def _block(self, ids: np.ndarray) -> None:
        mask, packed = 0, []
        for i, p in enumerate(split_planes(ids, self.kind)):
            if p.strip(b"\0"):
                mask |= 1 << i
                packed.append(self.zip.compress(p))
        self.index.append(struct.pack(f"<QII{len(packed)}I", self.at, len(ids), mask, *map(len, packed)))
        self.out.write(b"".join(packed))
        self.at += sum(map(len, packed))
        self.blocks += 1

    def close(self) -> None:
        if self.n_waiting:
            self._block(np.frombuffer(b"".join(self.waiting), "<u4"))
        index, documents = self.zip.compress(b"".join(self.index)), self.zip.compress(b"".join(self.documents))
        kind = {"bit": 1, "byte": 2}[self.kind]
        self.out.write(index + documents + struct.pack(FOOTER, len(index), len(documents), self.blocks, len(self.documents), kind, MAGIC))


class PlaneReader:
    """Reads such a file from a random-access file object (read, seek, size)."""

    def __init__(self, file, size: int):
        self.file, self.unzip = file, zstandard.ZstdDecompressor()
        footer = struct.calcsize(FOOTER)
        file.seek(size - footer)
        n_index, n_docs, self.blocks, self.n_documents, kind, magic = struct.unpack(FOOTER, file.read(footer))
        if magic != MAGIC:
            raise ValueError("not a file of token planes")
        self.kind = {1: "bit", 2: "byte"}[kind]
        file.seek(size - footer - n_docs - n_index)
        self.index, self.documents = self.unzip.decompress(file.read(n_index)) if n_index else b"", self.unzip.decompress(file.read(n_docs)) if n_docs else b""

    def chunks(self):
        """The ids of the blocks, in order."""
        at = 0
        for _ in range(self.blocks):
            offset, n, mask = struct.unpack_from("<QII", self.index, at)
            at += 16
            self.file.seek(offset)
            planes = {}
            for i in range(32):
                if mask >> i & 1:
                    (length,) = struct.unpack_from("<I", self.index, at)
                    at += 4
                    planes[i] = self.unzip.decompress(self.file.read(length))
            yield join_planes(planes, n, self.kind)

    def texts(self):
        """(document id, place of its first id in the file, its ids as bytes), in order."""
        blocks, held, at, place = self.chunks(), b"", 0, 0
        for i in range(self.n_documents):
            doc_id, known, n = struct.unpack_from("<qBQ", self.documents, 17 * i)
            if len(held) - at < 4 * n:
                parts, have = [held[at:]], len(held) - at
                while have < 4 * n:
                    parts.append(next(blocks).tobytes())
                    have += len(parts[-1])
                held, at = b"".join(parts), 0
            yield doc_id if known else None, place, held[at : at + 4 * n]
            at, place = at + 4 * n, place + n


def _write(folder: str, tokenizer: str, kind: str, end_id: int):
    def run(batches):
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder)
        own, end, writer, n_ids, n_docs, part = f"{root}/_{uuid.uuid4().hex}", np.array([end_id], "<u4").tobytes(), None, 0, 0, -1
        # a task makes many small objects and no cycles; the collector would walk the store of pieces again and again
        collects = gc.isenabled()
        gc.disable()
        try:
            for b in batches:
                if not b.num_rows:
                    continue
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    part, encoder, out = b.column(0)[0].as_py(), encoder_of(tokenizer), fs.open_output_stream(own)
                    writer = PlaneWriter(out, kind)
                for doc_id, ids in zip(b.column(1).to_pylist(), encoder.encode(b.column(2).to_pylist()), strict=True):
                    writer.add(doc_id, ids + end)
                    n_ids, n_docs = n_ids + len(ids) // 4 + 1, n_docs + 1
            if writer is not None:
                writer.close()
                out.close()
                fs.move(own, f"{root}/part-{part:05d}.planes")
        finally:
            if collects:
                gc.enable()
        if writer is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_ids": pa.array([n_ids], pa.int64()), "n_docs": pa.array([n_docs], pa.int64())})

    return run


def _read(folder: str):
    def run(batches):
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder)
        for b in batches:
            for part, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                path, rows = f"{root}/part-{part:05d}.planes", []
                with fs.open_input_file(path) as f:
                    for doc_id, place, ids in PlaneReader(f, f.size()).texts():
                        rows.append((doc_id, base + place, len(ids) // 4, zlib.crc32(ids)))
                        if len(rows) == 4096:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", kind: str = "bit", end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the files; returns the manifest: part, n_ids, n_docs, base (ids in all files before)."""
    spark = docs.sparkSession
    small_batches(spark)
    scope = Scope(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sizes, row = scope.write(rows.select("doc_id", (F.octet_length("text") + 8).cast("long").alias("size")), "sizes"), None
    total, nulls = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("size"))), F.lit(0))).first()
    cells = Cells(sizes, "doc_id", "size", max(LEAST_FILES, -(-total // file_bytes)), total, nulls, ["doc_id", "text", "size", "row_id"], SAMPLES)
    if cells.hot:
        rows, row = numbered(scope, rows)
        sizes = rows.select(row, "doc_id", (F.octet_length("text") + 8).cast("long").alias("size"))
    cells.subdivide(scope, sizes)
    # a row for each file: the cells in their order are the files
    files = cells.placed(sizes, row).select(*cells.names).distinct()
    files = scope.write(files.withColumn("file", (F.row_number().over(Window.orderBy(*cells.names)) - 1).cast("int")), "files")
    parted = cells.placed(rows, row).join(F.broadcast(files), cells.names).repartitionById(max(files.count(), 1), "file").sortWithinPartitions("doc_id", "text")
    done = scope.write(parted.select("file", "doc_id", "text").mapInArrow(_write(folder, tokenizer, kind, end_id), "part int, n_ids long, n_docs long"), "manifest")
    scope.release("manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return done.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, one task a file."""
    files = max(1, manifest.count())
    return manifest.repartitionById(files, "part").select("part", "base").mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, kind: str = "bit", folder: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    return read_tokens(spark, folder, write_tokens(docs, folder, tokenizer, kind=kind))
