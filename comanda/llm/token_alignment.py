"""Alignment of the tokens of two tokenizers by byte offsets.

A task cuts an Arrow batch into slices of whole documents and concatenates each: ends of A and B
tokens are byte offsets in the slice, counted once by ``bincount``. Both tokenizers' ends cut groups;
each piece between neighbouring ends of either is one pair of overlapping tokens, a link. Prefix
sums over the offsets, taken at the documents' bounds, give every count by document.

How many documents hold a pair is counted corpus-wide: distinct pairs of a document are counted in
the task first, then summed by pair. Pairs in more than one of HOT of all (document, pair)
entries are fewer than HOT by that bound, so they go to every task as sorted arrays; the entries of
all rarer pairs, none of which has more than a HOT-th of them, are joined by shuffle. Both ways give
the same numbers.

Tokens come from units, runs of white space with the word behind them. Neither tokenizer joins
across the end of a word before white space (checked against the vocabulary of B; A splits there by its
own pattern), so texts are put together from units and A encodes units not met before in runs, taken apart
where byte ends meet; texts with carriage returns, or characters that count as white space for one side only, are
encoded whole. A Python worker remembers units up to a bound: those met first, the common ones, stay, and later
ones are forgotten when it is reached. Tests hold the ids to those of whole texts.

Defined cases: texts that are null or empty, or whose joined token bytes differ from the text, have
no tokens, zeros and an empty hash; repeated rows count as documents each; an empty table gives an
empty result; further columns are not read. Memory grows with the longest single text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comanda.session import written

#: White space by Unicode that no token of B has behind other letters, and characters that B joins to
#: words or that only some take for white space.
SPACE = "\t-\x0c \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
UNSURE = re.compile("[\r\x1c-\x1f\x85\u180e\u200b\ufeff]")
MARK = "\u2581"
#: Characters of text aligned at once, and pair counts held before they leave a task.
SLICE, HELD = 2_000_000, 1_000_000
#: Bytes that remembered units may take before some are forgotten (about 260 each), and those of the units that stay.
REMEMBERED, STAY = 66_000_000, 53_000_000
#: Units that A encodes as one text, and characters beyond which a unit goes alone: long texts cost A more time and memory.
RUN, LONG = 128, 100
#: Characters of new units encoded before the next are.
PORTION = 200_000
#: A pair is hot with more than one in HOT of all (document, pair) entries.
HOT = 1 << 20


def _byte_of_letter() -> dict[str, int]:
    """The printable letters that stand for bytes in a byte-level vocabulary: printable Latin-1 bytes
    are themselves, the others follow from 256 on in ascending order."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def _laid_out(ids: Iterable[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids end to end, and where each stops."""
    ids = list(ids)
    return np.fromiter(chain.from_iterable(ids), "<i4"), np.cumsum(np.fromiter(map(len, ids), np.int64))


class Tokenizers:
    """Ids of both tokenizers for texts, and the bytes of each id."""

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are parallel already
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        letters, vocabulary = _byte_of_letter(), self.a.get_vocab()
        special = {x.content for x in self.a.get_added_tokens_decoder().values()}
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for piece, k in vocabulary.items():
            self.bytes_a[k] = piece.encode() if piece in special else bytes(letters[c] for c in piece)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(MARK, " ").encode() for k, p in enumerate(pieces)]
        self.mark = self.b.piece_to_id(MARK)
        joined = re.compile(f"[^{SPACE}{MARK}][{SPACE}{MARK}]|{MARK}[{SPACE}]")
        if any(joined.search(p) for p in pieces if not UNSURE.search(p)):
            raise ValueError("tokens of B join words across white space: units are not independent")
        self.size_a, self.size_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        self.of_a: dict[str, bytes] = {}
        self.of_b: dict[str, bytes] = {}
        self.unlike: set[str] = set()
        self.remembered = self.stay = self.stay_bytes = 0

    def _ids_a(self, words: list[str], others: list[str], stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both end to end, and where each unit's stop. Words go in runs; if a token lies across the end of
        a unit (``stops`` in bytes), each goes alone."""
        encoded = lambda texts: _laid_out(x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False))
        ids, _ = encoded(["".join(words[k : k + RUN]) for k in range(0, len(words), RUN)] + others)
        ends = np.append(0, np.cumsum(self.size_a[ids]))
        until = np.minimum(np.searchsorted(ends, stops), len(ids))
        return (ids, until) if np.array_equal(ends[until], stops) else encoded(words + others)

    def _ids_b(self, texts: list[str]) -> list[list[int]]:
        """B puts a space in front, which is a unit's own first space; one that has none loses it again."""
        out = self.b.encode([x[1:] if x[0] == " " else x for x in texts], num_threads=1)
        for x, ids in zip(texts, out, strict=True):
            if x == " ":
                ids.append(self.mark)  # an empty text gets no space
            elif x[0] != " ":
                if ids[0] != self.mark:
                    raise ValueError(f"B joins its space to {x[:9]!r}")
                del ids[0]
        return out

    def _learn(self, units: list[str]) -> None:
        # white space at the end, or what A may take for it, would join the next unit of a run
        others = [x for x in units if len(x) > LONG or x[-1].isspace() or UNSURE.search(x)]
        alone = set(others)
        words = [x for x in units if x not in alone]
        units = words + others
        whole = [x.encode() for x in units]
        stops = np.cumsum(np.fromiter(map(len, whole), np.int64))
        a, b = self._ids_a(words, others, stops), _laid_out(self._ids_b(units))
        size = 200 + 4 * (np.fromiter(map(len, units), np.int64) + np.diff(a[1], prepend=0) + np.diff(b[1], prepend=0))
        held = self.remembered + np.cumsum(size)
        if self.remembered <= STAY:
            more = int(np.searchsorted(held, STAY, side="right"))
            self.stay, self.stay_bytes = len(self.of_a) + more, int(held[more - 1]) if more else self.remembered
        self.remembered = int(held[-1])
        for known, shown, sizes, (ids, until) in ((self.of_a, self.bytes_a, self.size_a, a), (self.of_b, self.bytes_b, self.size_b, b)):
            got, data, at = list(map(shown.__getitem__, ids.tolist())), ids.tobytes(), [0, *until.tolist()]
            ends = np.append(0, np.cumsum(sizes[ids]))
            if not np.array_equal(ends[until], stops) or b"".join(got) != b"".join(whole):
                self.unlike.update(x for x, w, i, j in zip(units, whole, at, at[1:], strict=False) if b"".join(got[i:j]) != w)
            known.update(zip(units, map(data.__getitem__, map(slice, (4 * np.append(0, until[:-1])).tolist(), (4 * until).tolist())), strict=True))

    def _forget(self) -> None:
        for x in list(islice(self.of_a, self.stay, None)):
            del self.of_a[x], self.of_b[x]
            self.unlike.discard(x)
        self.remembered = self.stay_bytes

    def of_texts(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Ids of " " + text by A and of text by B, as int32 bytes; empty where the text has no tokens."""
        if self.remembered > REMEMBERED:
            self._forget()
        whole = lambda text: UNSURE.search(text) is not None
        units = [[] if not text else [" " + text] if whole(text) else UNIT.findall(" " + text) for text in texts]
        new = list({u for us in units for u in us}.difference(self.of_a))
        start = held = 0
        for k, unit in enumerate(new, 1):
            held += len(unit)
            if held > PORTION or k == len(new):
                self._learn(new[start:k])
                start, held = k, 0
        out = []
        for us in units:
            if not us or (self.unlike and not self.unlike.isdisjoint(us)):
                out.append((b"", b""))
            else:
                out.append((b"".join(map(self.of_a.__getitem__, us)), b"".join(map(self.of_b.__getitem__, us))))
        return out

    @property
    def shown(self) -> list[bytes]:
        """Decimal ids as they stand in the written groups: of A before a further A id and before
        B, of B before a further B id and before a further group."""
        a, b = range(len(self.bytes_a)), range(len(self.bytes_b))
        return [b"%d%c" % (k, end) for ids, ends in ((a, b",|"), (b, b",;")) for end in ends for k in ids]


@cache
def tokenizers(path_a: str, path_b: str) -> tuple[Tokenizers, list[bytes]]:
    """One for each Python worker."""
    found = Tokenizers(path_a, path_b)
    return found, found.shown


class Slice:
    """The tokens of some documents laid end to end."""

    def __init__(self, ids: list[tuple[bytes, bytes]], size_a: np.ndarray, size_b: np.ndarray):
        self.a, self.b = (np.frombuffer(b"".join(x[k] for x in ids), "<i4") for k in (0, 1))
        self.n_a, self.n_b = (np.array([len(x[k]) // 4 for x in ids], np.int64) for k in (0, 1))
        end_a, end_b = np.cumsum(size_a[self.a]), np.cumsum(size_b[self.b])
        total = int(end_a[-1]) if len(end_a) else 0
        ends_a, ends_b = np.bincount(end_a, minlength=total + 1), np.bincount(end_b, minlength=total + 1)
        cuts = ends_a & ends_b
        before_cut = np.cumsum(cuts) - cuts
        self.group_a, self.group_b = before_cut[end_a], before_cut[end_b]
        self.last_a, self.last_b = cuts[end_a].astype(bool), cuts[end_b].astype(bool)
        # a link ends where a token of either side ends; so many tokens of each side ended before
        pieces = np.flatnonzero(ends_a | ends_b)
        self.link_a = (np.cumsum(ends_a) - ends_a)[pieces]
        self.link_b = (np.cumsum(ends_b) - ends_b)[pieces]
        # bounds of documents in bytes, from A's tokens, and prefix sums there
        bounds = np.append(0, end_a)[np.append(0, np.cumsum(self.n_a))]
        self.n_groups = np.diff(np.cumsum(cuts)[bounds])
        self.n_links = np.diff(np.searchsorted(pieces, bounds, side="right"))

    def groups(self, shown: list[bytes], n_ids_a: int, n_ids_b: int) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of every document."""
        n_groups = int(self.n_groups.sum())
        of_a, of_b = (np.bincount(g, minlength=n_groups) for g in (self.group_a, self.group_b))
        at_a = np.arange(len(self.a)) + (np.cumsum(of_b) - of_b)[self.group_a]
        at_b = np.arange(len(self.b)) + np.cumsum(of_a)[self.group_b]
        line = np.empty(len(self.a) + len(self.b), np.int64)
        line[at_a] = self.a + n_ids_a * self.last_a
        line[at_b] = self.b + 2 * n_ids_a + n_ids_b * self.last_b
        stops = np.cumsum(self.n_a + self.n_b)
        return [b"".join(map(shown.__getitem__, line[s:e].tolist()))[:-1] for s, e in zip(np.append(0, stops[:-1]), stops, strict=True)]

    def pairs(self, n_ids_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of each document, how often each is linked, and the documents' bounds."""
        pair = self.a[self.link_a].astype(np.int64) * n_ids_b + self.b[self.link_b]
        doc = np.repeat(np.arange(len(self.n_a), dtype=np.int64), self.n_links)
        found, times = np.unique(doc << 40 | pair, return_counts=True)
        return found & ((1 << 40) - 1), times, np.searchsorted(found >> 40, np.arange(len(self.n_a) + 1))


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A written table with a row for each document of ``docs(doc_id, text)``: its counts, the hash of
    its groups, and its distinct pairs (A id * B's size + B id, ascending int64 bytes) with how
    often each is linked (int32 bytes). ``row`` numbers the rows of the table."""

    def slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        start, held = 0, 0
        for k, text in enumerate(texts):
            size = len(text or "")
            if k > start and held + size > SLICE:
                yield ids[start:k], texts[start:k]
                start, held = k, 0
            held += size
        if texts:
            yield ids[start:], texts[start:]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        both, shown = tokenizers(path_a, path_b)
        n_a, n_b = len(both.bytes_a), len(both.bytes_b)
        for batch in batches:
            for ids, texts in slices(batch):
                part = Slice(both.of_texts(texts), both.size_a, both.size_b)
                pair, times, at = part.pairs(n_b)
                pair, times = pair.astype("<i8"), times.astype("<i4")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + len(ids))), pa.array(ids, pa.int64()), pa.array(part.n_a), pa.array(part.n_b), pa.array(part.n_groups), pa.array(part.n_links),
                        pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in part.groups(shown, n_a, n_b)]),
                        pa.array([pair[s:e].tobytes() for s, e in zip(at, at[1:], strict=False)], pa.binary()), pa.array([times[s:e].tobytes() for s, e in zip(at, at[1:], strict=False)], pa.binary()),
                    ],
                    ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )
                row += len(ids)

    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, ALIGNED), "aligned")


def pair_counts(aligned_docs: DataFrame, n_ids_b: int) -> DataFrame:
    """pair, n (documents that hold it linked) and best (n is the highest of its A id), written."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            more = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8")
            some, times = np.unique(more, return_counts=True)
            pairs, place = np.unique(np.concatenate([pairs, some]), return_inverse=True)
            n = np.bincount(place, np.concatenate([n, times]), len(pairs)).astype(np.int64)
            if len(pairs) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])
                pairs, n = pairs[:0], n[:0]
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])

    parts = aligned_docs.select("pairs").mapInArrow(counted, "pair long, n long")
    counts = written(parts.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    a = F.floor(F.col("pair") / n_ids_b)
    highest = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # a row for each A id at most
    held = counts.withColumn("a", a).join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    return written(held, "pairs")


def alignment(docs: DataFrame, path_a: str, path_b: str, hot_share: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    table = aligned(docs, path_a, path_b)
    n_ids_b = len(tokenizers(path_a, path_b)[0].bytes_b)
    counts = pair_counts(table, n_ids_b)
    entries = counts.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n").cast("decimal(38,0)") * hot_share > F.lit(entries)
    hot = counts.filter(is_hot).orderBy("pair").toArrow()  # fewer than hot_share rows
    sent = docs.sparkSession.sparkContext.broadcast(tuple(hot.column(c).to_numpy() for c in ("pair", "n", "best")))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = sent.value
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                packed = batch.column(batch.schema.get_field_index("pairs")).to_pylist()
                mine, times = np.frombuffer(b"".join(packed), "<i8"), np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("times")).to_pylist()), "<i4").astype(np.int64)
                doc = np.repeat(np.arange(len(packed)), [len(x) // 8 for x in packed])
                at = np.minimum(np.searchsorted(pair, mine), max(0, len(pair) - 1))
                found = pair[at] == mine if len(pair) else np.zeros(len(mine), bool)
                at, by = at[found], times[found]
                add = lambda values, where: np.append(0, np.cumsum(values))[np.searchsorted(where, np.arange(len(packed) + 1))]
                total, n_best = np.diff(add(by * n[at], doc[found])), np.diff(add(by * best[at], doc[found]))
                lone = np.searchsorted(doc[~found], np.arange(len(packed) + 1)).astype(np.int32)
                lists = lambda values: pa.ListArray.from_arrays(pa.array(lone), pa.array(values[~found]))
                kept = [c for c in batch.schema.names if c not in ("pairs", "times")]
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], pa.array(n_best), pa.array(total), lists(mine), lists(times)], [*kept, "hot_best", "hot_sum", "rare", "rare_times"])

    schema = ALIGNED.replace(", pairs binary, times binary", ", hot_best long, hot_sum long, rare array<long>, rare_times array<long>")
    rows = written(table.mapInArrow(summed, schema), "hot-links")
    entry = F.explode(F.arrays_zip("rare", "rare_times")).alias("e")
    rare = rows.select("row", entry).select("row", F.col("e.rare").alias("pair"), F.col("e.rare_times").alias("times"))
    rare = rare.join(counts.filter(~is_hot).hint("shuffle_merge"), "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("rare_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("rare_best"))
    out = rows.drop("rare", "rare_times").join(rare, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", plus("hot_best", "rare_best").alias("n_best"), plus("hot_sum", "rare_sum").alias("count_sum"), "groups_sha256")
