"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FILE_ORDER = ("_file_part", "_file_row")


def in_file_order(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """``docs`` with columns that tell the place of each row in the files that they are read from, and
    these columns' names: number of the part and row in it. None for docs that are not read from files."""
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1)
    try:
        placed = docs.withColumns({FILE_ORDER[0]: F.concat(F.lpad(part, 9, "0"), F.col("_metadata.file_name")), FILE_ORDER[1]: F.col("_metadata.row_index")})
        placed.schema  # noqa: B018  resolves the columns
    except AnalysisException:
        return docs, ()
    return placed, FILE_ORDER


class Hashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, bound: int = 250_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: str) -> int:
        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * _Q
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, hashes: Callable, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words (case folded).

    A text of fewer words has the one shingle of all its words; a text without words has none.
    """
    words = WORD.findall((text or "").lower())
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - size + 1)
    h = np.full(n, len(w) if len(w) < size else size, np.uint64)
    for k in range(min(size, len(w))):
        h = h * _P + w[k : k + n]
    return np.unique(mixed(h))


def held_out(doc_id: Column) -> Column:
    """Rows kept from all learning: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, columns: list[str], most: int) -> DataFrame:
    """(text, *columns) of at most ``most`` labelled rows outside the held-out ones.

    The ids come in the order of a hash, so the bounded sample is the same in every run; it is
    small by that bound and goes to the tasks, and the texts stay where they lie. Of repeated rows
    of one doc_id the least text counts, so the bound holds for them too.
    """
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    for c in columns:
        known = known.filter(F.col(c).isNotNull())
    known = known.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in columns])
    chosen = known.orderBy(F.xxhash64(F.lit("train"), "doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", *columns).agg(F.min("text").alias("text")).select("text", *columns)


class Sparse:
    """Rows of (feature, value), for products with weights."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], n_features: int):
        self.n, self.n_features = len(rows), n_features
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(c) for c, _ in rows])
        self.column = np.concatenate([np.empty(0, np.int32), *[np.asarray(c, np.int32) for c, _ in rows]])
        self.value = np.concatenate([np.empty(0, np.float32), *[np.asarray(v, np.float32) for _, v in rows]])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.n)

    def transposed_times(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * r[self.row], self.n_features)

    def step(self) -> float:
        """A safe bound of the largest squared singular value, by power iteration."""
        v = np.full(self.n_features, 1.0)
        for _ in range(20):
            v = self.transposed_times(self.times(v))
            size = np.linalg.norm(v) or 1.0
            v /= size
        return size * 1.1


def set_aside(docs: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with all columns but ``keep`` renamed out of the way, and what brings them back (with
    further columns behind them)."""
    name = {c: c if c in keep else f"__other{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*[docs[c].alias(name[c]) for c in docs.columns]), lambda out, *more: out.select(*[out[name[c]].alias(c) for c in docs.columns], *more)
