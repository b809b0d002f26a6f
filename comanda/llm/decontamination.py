"""Documents that hold benchmark passages, up to an edit budget (q-gram lemma filter).

Texts and passages are folded to lower case words with single spaces, as UTF-8 bytes. A passage of
m bytes within k edits of a stretch of text shares at least m + 1 - q(k + 1) of its q-grams with
it, all within k + 1 neighbouring diagonals. So the shared q-grams of a document and a passage are
counted in diagonal bands that overlap by k; bands that reach the bound name a region, and a banded
alignment of passage and region decides.

Documents are scanned where they lie: nothing is shuffled, whatever many of them share. Passages go
to the tasks in blocks of at most BLOCK_BYTES, one scan a block.

Defined cases: null and empty texts hold nothing; passages without words match nothing; those
shorter than q match as whole words; repeated passages count each; empty tables work; other columns
pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comanda.llm.common import set_aside

Q, EDIT_SHARE = 12, 0.06
BLOCK_BYTES = 8_000_000
_TABLE_BITS = 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LETTERS = bytes(x if chr(x).isalnum() and x < 128 or x >= 128 else 32 for x in range(256))


def folded(text: str | None) -> np.ndarray:
    """Lower-case UTF-8 bytes; other ASCII than letters and digits is one space between words."""
    raw = np.frombuffer(f" {text or ''} ".lower().encode("utf-8", "replace").translate(_LETTERS), np.uint8)
    space = raw == 32
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    return raw[keep]


def q_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of the Q bytes that begin at each position."""
    n = len(b) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    data = b.tobytes() + bytes(16)
    first, last = np.empty(n + 8, np.uint64), np.empty(n + 8, np.uint64)
    for off in range(8):
        count = len(range(off, n, 8))
        first[off : off + 8 * count : 8] = np.frombuffer(data, "<u8", count, off)
        last[off : off + 8 * count : 8] = np.frombuffer(data, "<u8", count, off + Q - 8)
    h = first[:n] * _ODD
    h ^= last[:n] + (h >> np.uint64(31))
    return h * _ODD


class Passages:
    """The q-gram index of a block of passages."""

    def __init__(self, items: list[tuple[int | None, str | None]], edit_share: float = EDIT_SHARE):
        found = [(i, folded(t)) for i, t in items]
        found = [(i, b) for i, b in found if len(b) > 2]
        self.ids, self.bytes = [i for i, _ in found], [b for _, b in found]
        self.short = [k for k, b in enumerate(self.bytes) if len(b) < Q]
        long = [k for k, b in enumerate(self.bytes) if len(b) >= Q]
        # the largest budget at which the lemma still asks for a shared q-gram
        self.edits = np.array([max(0, min(int(len(b) * edit_share), (len(b) - Q) // Q)) for b in self.bytes], np.int64)
        self.need = np.array([len(b) + 1 - Q * (k + 1) for b, k in zip(self.bytes, self.edits, strict=True)], np.int64)
        hashes = [q_hashes(self.bytes[k]) for k in long]
        h = np.concatenate([np.empty(0, np.uint64), *hashes])
        item = np.repeat(np.array(long, np.int64), [len(x) for x in hashes])
        at = np.concatenate([np.empty(0, np.int64), *[np.arange(len(x)) for x in hashes]])
        order = np.argsort(h, kind="stable")
        self.item, self.at = item[order], at[order]
        self.grams, self.begin = np.unique(h[order], return_index=True)
        self.end = np.append(self.begin[1:], len(h))
        self.maybe = np.zeros(1 << _TABLE_BITS, bool)
        self.maybe[self.grams >> np.uint64(64 - _TABLE_BITS)] = True
        self.least_need = int(self.need[long].min()) if long else 0
        self.longest = max([0, *(len(self.bytes[k]) + int(self.edits[k]) for k in long)])

    def regions(self, b: np.ndarray) -> list[tuple[int, int, int]]:
        """(passage, first, last diagonal) of the bands that reach their passage's bound."""
        h = q_hashes(b)
        if not len(h) or not len(self.grams):
            return []
        at = np.nonzero(self.maybe[h >> np.uint64(64 - _TABLE_BITS)])[0]
        if len(at) < self.least_need:
            return []
        # some stretch as long as the longest passage must hold the least bound of hits
        far = np.searchsorted(at, at + self.longest)
        near = far - np.arange(len(at)) >= self.least_need
        if not near.any():
            return []
        step = np.zeros(len(at) + 1, np.int64)
        np.add.at(step, np.nonzero(near)[0], 1)
        np.add.at(step, far[near], -1)
        at = at[np.cumsum(step[:-1]) > 0]
        slot = np.searchsorted(self.grams, h[at])
        slot[slot == len(self.grams)] = 0
        hit = self.grams[slot] == h[at]
        at, slot = at[hit], slot[hit]
        times = self.end[slot] - self.begin[slot]
        post = np.repeat(self.begin[slot], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        item, diagonal = self.item[post], np.repeat(at, times) - self.at[post]
        # bands of width step + k + 1, one each step, so k + 1 neighbouring diagonals lie in one of them
        k = self.edits[item]
        step = k + 1
        band = diagonal // step
        rows = np.concatenate([np.stack([item, band], 1), np.stack([item, band - 1], 1)])
        rows, counts = np.unique(rows, axis=0, return_counts=True)
        good = rows[counts >= self.need[rows[:, 0]]]
        return [(int(i), int(d) * (int(self.edits[i]) + 1), int(d) * (int(self.edits[i]) + 1) + 2 * int(self.edits[i]) + 1) for i, d in good]

    def found_in(self, text: str | None) -> list[tuple[int, int]]:
        """(passage, edits) of all passages in the text."""
        if not text:
            return []
        b = folded(text)
        best: dict[int, int] = {}
        for i, lo, hi in self.regions(b):
            edits = aligned(self.bytes[i], b, lo, hi, int(self.edits[i]))
            if edits <= self.edits[i] and edits < best.get(i, 1 << 30):
                best[i] = edits
        if self.short:
            whole = b.tobytes()
            best |= {i: 0 for i in self.short if self.bytes[i].tobytes() in whole}
        return sorted(best.items())


def aligned(passage: np.ndarray, text: np.ndarray, lo: int, hi: int, k: int) -> int:
    """Fewest edits between the passage and a stretch of text on diagonals lo - k .. hi + k."""
    lo, hi = lo - k, hi + k
    width = hi - lo + 1
    padded = np.full(width + len(passage) + 1, 0, np.int16)
    a, z = max(lo, 0), min(lo + len(padded), len(text))
    if z > a:
        padded[a - lo : z - lo] = text[a:z]
    far = 1 << 20
    start = np.arange(lo, hi + 1)
    row = np.where((start >= 0) & (start <= len(text)), 0, far).astype(np.int64)
    ramp = np.arange(width)
    for i, c in enumerate(passage):
        new = row + (padded[i : i + width] != c)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        row = np.minimum.accumulate(new - ramp) + ramp
    return int(row.min())


LEAKS = "array<struct<item_id:long,edits:int>>"


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, str | None]]]:
    passages = benchmark.select(F.col("item_id").cast("long"), "text")
    total = passages.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = passages if n == 1 else passages.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r[0], r[1]) for r in part.collect()]  # a block of the stated query set


def with_leaks(docs: DataFrame, benchmark: DataFrame, name: str = "_leaks", edit_share: float = EDIT_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a column of the passages found in each text and their edits."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32())]))
    empty = F.array().cast(LEAKS)
    out = docs.withColumn(name, empty)
    for items in _blocks(benchmark, block_bytes):
        passages = Passages(items, edit_share)
        at = docs.columns.index("text")

        def scan(batches: Iterator[pa.RecordBatch], passages=passages, at=at) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                old = batch.column(batch.num_columns - 1).to_pylist()
                new = [[*o, *({"item_id": passages.ids[i], "edits": e} for i, e in passages.found_in(t))] for o, t in zip(old, batch.column(at).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(new, kind)], names=batch.schema.names)

        out = out.mapInArrow(scan, out.schema)
    return out


def judged(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids and least edits of every row."""
    rows = with_leaks(docs.select("doc_id", "text"), benchmark, **how)
    return rows.select("doc_id", (F.size("_leaks") > 0).alias("contaminated"), F.size("_leaks").cast("long").alias("n_items"), F.array_sort("_leaks.item_id").alias("item_ids"), F.array_min("_leaks.edits").alias("least_edits"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that hold no passage."""
    rows, restored = set_aside(docs, ("text",))
    return restored(with_leaks(rows, benchmark, **how).filter(F.size("_leaks") == 0))
