"""Embedders by space. The built-in one is a deterministic stand-in that needs no weights; others can be registered."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Dimensions by space.
SPACES = {"image_a": 1152, "image_b": 768, "text": 768}
IMAGE_PROMPT, QUERY_PREFIX, PASSAGE_PREFIX = "a photo of {}.", "query: ", "passage: "

Embedder = Callable[[list[str]], np.ndarray]


def unit_rows(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(length == 0, 1, length)).astype(np.float32)


def stand_in(space: str, dim: int) -> Embedder:
    """Counts of runs of one to three bytes of the lower-cased text, each run at a hashed place and with a hashed sign: texts that share runs are alike."""
    seed = np.uint64(zlib.crc32(space.encode()))

    def of(text: str) -> np.ndarray:
        octets = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64)
        runs = [sum(octets[j : len(octets) - n + 1 + j] << np.uint64(8 * j) for j in range(n)) | np.uint64(n << 24) for n in (1, 2, 3) if len(octets) >= n]
        mixed = (np.concatenate(runs) ^ (seed << np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        places, signs = (mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)) % np.uint64(dim), np.where(mixed & np.uint64(1), 1.0, -1.0)
        return np.bincount(places.astype(np.int64), signs, dim)

    def encode(texts: list[str]) -> np.ndarray:
        return unit_rows(np.array([of(t) for t in texts], np.float64).reshape(len(texts), dim))

    return encode


class Registry:
    """The embedder of each space."""

    def __init__(self, dims: dict[str, int] | None = None):
        self.dims = dict(dims or SPACES)
        self.by_space = {s: stand_in(s, d) for s, d in self.dims.items()}

    def register(self, space: str, dim: int, encode: Embedder) -> None:
        self.dims[space], self.by_space[space] = dim, encode

    def check(self, space: str) -> str:
        if space not in self.by_space:
            raise ValueError(f"no such space: {space}")
        return space

    def encode(self, space: str, texts: list[str]) -> np.ndarray:
        return self.by_space[self.check(space)](texts) if texts else np.zeros((0, self.dims[self.check(space)]), np.float32)

    def column(self, space: str, text: Column) -> Column:
        encode = self.by_space[self.check(space)]

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def embed(texts: pd.Series) -> pd.Series:
            return pd.Series(list(encode(texts.fillna("").tolist())), index=texts.index)

        return embed(text)


def image_query(query: Column) -> Column:
    head, tail = IMAGE_PROMPT.split("{}")
    return F.concat(F.lit(head), F.lower(F.trim(query)), F.lit(tail))


def prefixed(text: Column, query: bool) -> Column:
    return F.concat(F.lit(QUERY_PREFIX if query else PASSAGE_PREFIX), text)
