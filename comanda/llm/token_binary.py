"""Token ids as fixed-width bit-packed shard files.

Every id takes the fewest bits that the vocabulary needs, least bit first, in blocks of BLOCK ids
that begin on a byte; a shard's footer has the documents' ids and lengths and the blocks' offsets,
so any token range is read and unpacked with numpy without the rest of the file.

    magic | blocks | doc_ids int64 | nulls uint8 | lengths int64 | block offsets int64 | trailer

Shards follow ascending doc_id, or the columns that the caller names. A task names its file after its attempt and reports it in the
manifest, so lost or repeated attempts leave unread files and nothing else.

Defined cases: null text is empty and gives the end id alone; null doc_ids come first; equal
doc_ids follow the order of their texts; an empty table gives no shard.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import filterfalse, islice

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from comanda.session import arrow_batches, shared_folder, written

MAGIC = b"CTOKENS1"
TRAILER = "<IIqqqq8s"
BLOCK = 4096
#: Texts whose ids are written at once, and characters of them that are split, and whose new parts are encoded, in one call.
TEXTS, PORTION = 500, 250_000
#: Characters beyond which a part is not remembered.
LONG = 100
#: Bytes of the Arrow batches that tasks get; a partition in one batch would stand in the executor and in its worker.
BATCH = 4_000_000
#: Characters beyond which a text is not plain: ASCII but for odd controls, letters of Latin and Cyrillic
#: that are composed and have a lower case of one letter, and general punctuation.
ODD = re.compile("[^\t-\r -\x7e\u00a1\u00ab\u00bb\u00bf\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e\u0400-\u0481\u048a-\u04ff\u2010-\u2027]")
#: White space for Python's split() that is none for the tokenizer.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: The tokenizer's own split, in a form that is equal on plain lower-cased text.
PARTS = re.compile("[a-zß-öø-ӿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\\sa-z0-9ß-öø-ӿ]+")
END_OF_WORD = "</w>"
#: Begins a part that is encoded as it is; no part holds white space.
AS_IS = "\n"


def width_of(n_vocab: int) -> int:
    return max(1, (n_vocab - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class Parts(dict):
    """Ids of the parts of texts as uint32 bytes, up to a bound.

    The tokenizer never joins text across the parts that its own pattern splits it into. So a plain
    text is put together from its parts, and the parts not met before are encoded in one call for
    many texts; the end-of-word mark of a part's last id tells them apart. Of other texts the pieces
    between white space take this way where they are plain and are encoded as they are where not;
    texts with odd white space or with one of the vocabulary's added tokens are encoded whole.
    """

    def __init__(self, path: str, bound: int = 300_000):
        super().__init__()
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are parallel already
        self.tokenizer, self.bound = Tokenizer.from_file(path), bound
        added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join([ODD_SPACE.pattern, *map(re.escape, added)]))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for x, k in vocabulary.items() if x.endswith(END_OF_WORD)]] = True

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def parts_of(self, text: str | None) -> list[str] | None:
        if not text:
            return []
        if self.whole.search(text):
            return None
        if not ODD.search(text):
            return PARTS.findall(text.lower())
        return [y for x in text.split() for y in ((AS_IS + x,) if ODD.search(x) else PARTS.findall(x.lower()))]

    def learn(self, parts: set[str]) -> None:
        one = [x for x in parts if x[0] != AS_IS]
        ids = np.array(self.tokenizer.encode_batch_fast([one], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
        stops = (4 * (np.nonzero(self.ends[ids])[0] + 1)).tolist()
        if len(stops) != len(one):
            raise ValueError(f"the vocabulary does not end every word in {END_OF_WORD}")
        data = ids.tobytes()
        self.update(zip(one, map(data.__getitem__, map(slice, [0, *stops], stops)), strict=False))
        self.update((x, self.encoded(x[1:])) for x in parts if x[0] == AS_IS)

    def of_texts(self, texts: list[str | None]) -> list[bytes]:
        out, start, held = [], 0, 0
        for k, text in enumerate(texts):
            size = len(text or "")
            if k > start and held + size > PORTION:
                out += self._of_portion(texts[start:k])
                start, held = k, 0
            held += size
        return out + self._of_portion(texts[start:])

    def _of_portion(self, texts: list[str | None]) -> list[bytes]:
        if len(self) > self.bound:
            for x in list(islice(self, self.bound * 3 // 4, None)):  # the common parts were met first
                del self[x]
        split = list(map(self.parts_of, texts))
        # not difference(), which goes through all that a subclass of dict holds
        new = set(filterfalse(self.__contains__, set().union(*filter(None, split))))
        if new:
            self.learn(new)
        out = [self.encoded(x) if parts is None else b"".join(map(self.__getitem__, parts)) for x, parts in zip(texts, split, strict=True)]
        for x in new:
            if len(x) > LONG:
                del self[x]
        return out


@lru_cache(maxsize=1)
def kept_parts(path: str) -> Parts:
    """A Python worker's parts, kept from task to task."""
    return Parts(path)


class ShardWriter:
    def __init__(self, uri: str, width: int):
        self.fs, path = arrow_fs.FileSystem.from_uri(uri)
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.width = self.fs.open_output_stream(path), width
        self.out.write(MAGIC)
        self.offsets, self.ids, self.lengths, self.rest, self.at = [], [], [], np.empty(0, np.uint32), len(MAGIC)

    def add(self, doc_ids: list[int | None], ids: list[np.ndarray]) -> None:
        self.ids += doc_ids
        self.lengths += map(len, ids)
        held = np.concatenate([self.rest, *ids])
        for k in range(0, len(held) - BLOCK + 1, BLOCK):
            self._block(held[k : k + BLOCK])
        self.rest = held[len(held) - len(held) % BLOCK :]

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.width)
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        self.out.write(np.array([x or 0 for x in self.ids], "<i8").tobytes())
        self.out.write(np.array([x is None for x in self.ids], np.uint8).tobytes())
        self.out.write(np.array(self.lengths, "<i8").tobytes() + np.array(self.offsets, "<i8").tobytes())
        self.out.write(struct.pack(TRAILER, self.width, BLOCK, len(self.ids), sum(self.lengths), len(self.offsets), self.at, MAGIC))
        self.out.close()


class ShardReader:
    def __init__(self, uri: str):
        fs, path = arrow_fs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        self.width, self.block, n, self.n_tokens, n_blocks, at, magic = struct.unpack(TRAILER, self._read(end - struct.calcsize(TRAILER), struct.calcsize(TRAILER)))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        foot = self._read(at, n * 17 + n_blocks * 8)
        self.doc_ids = np.frombuffer(foot, "<i8", n)
        self.nulls = np.frombuffer(foot, np.uint8, n, 8 * n).astype(bool)
        self.lengths = np.frombuffer(foot, "<i8", n, 9 * n)
        self.offsets = np.append(np.frombuffer(foot, "<i8", n_blocks, 17 * n), at)
        self.starts = np.append(0, np.cumsum(self.lengths))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids at positions start..stop-1 of the shard."""
        if stop <= start:
            return np.empty(0, np.uint32)
        a, b = start // self.block, (stop - 1) // self.block
        data = self._read(int(self.offsets[a]), int(self.offsets[b + 1] - self.offsets[a]))
        n = min((b + 1) * self.block, self.n_tokens) - a * self.block
        return unpack(data, n, self.width)[start - a * self.block : stop - a * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.starts[k + 1]))


MANIFEST = "shard long, uri string, n_docs long, n_tokens long"


def write_shards(docs: DataFrame, tokenizer_path: str, n_vocab: int, end_id: int, folder: str | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """Encodes ``docs(doc_id, text)`` by the columns ``order``, then in ascending doc_id; returns the
    manifest, one row a shard, with ``start``: ids in all shards before it."""
    folder = folder or f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    width, end = width_of(n_vocab), np.array([end_id], "<u4").tobytes()

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, writer, pieces = TaskContext.get(), None, None
        part = task.partitionId()
        uri = f"{folder}/{part:06d}-{task.taskAttemptId()}.tok"
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if writer is None:
                writer, pieces = ShardWriter(uri, width), kept_parts(tokenizer_path)
            for k in range(0, batch.num_rows, TEXTS):
                some = batch.slice(k, TEXTS)
                ids = [np.frombuffer(x + end, "<u4") for x in pieces.of_texts(some.column(1).to_pylist())]
                writer.add(some.column(0).to_pylist(), ids)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [part], "uri": [uri], "n_docs": [len(writer.ids)], "n_tokens": [sum(writer.lengths)]})

    first = [docs[c].alias(f"_order{k}") for k, c in enumerate(order)]
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), *first)
    by = rows.columns[2:] or ["doc_id"]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*rows.columns[2:], "doc_id", "text").select("doc_id", "text")
    with arrow_batches(docs.sparkSession, BATCH):
        manifest = written(ordered.mapInArrow(shard, MANIFEST), "token-manifest")
    before = Window.partitionBy(F.lit(1)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _read(manifest: DataFrame, schema: str, rows) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, uri, start in zip(*(batch.column(c).to_pylist() for c in ("shard", "uri", "start")), strict=True):
                reader = ShardReader(uri)
                for k in range(0, len(reader.lengths), 512):
                    yield rows(reader, shard, start, range(k, min(k + 512, len(reader.lengths))))

    # a shard to a task
    return manifest.select("shard", "uri", "start").repartition(F.col("shard")).mapInArrow(read, schema)


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, shard, start, n_tokens, ids of every document in the shards."""

    def rows(r: ShardReader, shard: int, start: int, ks: range) -> pa.RecordBatch:
        docs = [None if r.nulls[k] else int(r.doc_ids[k]) for k in ks]
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64()), "shard": pa.array([shard] * len(ks), pa.int64()), "start": pa.array([start + int(r.starts[k]) for k in ks], pa.int64()), "n_tokens": pa.array([int(r.lengths[k]) for k in ks], pa.int64()), "ids": pa.array([r.document(k).astype(np.int64) for k in ks], pa.list_(pa.int64()))})

    return _read(manifest, "doc_id long, shard long, start long, n_tokens long, ids array<long>", rows)


def read_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the unpacked ids."""

    def rows(r: ShardReader, shard: int, start: int, ks: range) -> pa.RecordBatch:
        docs = [None if r.nulls[k] else int(r.doc_ids[k]) for k in ks]
        a = int(r.starts[ks.start])
        ids = r.tokens(a, int(r.starts[ks.stop]))
        crc = [zlib.crc32(ids[r.starts[k] - a : r.starts[k + 1] - a].astype("<u4").tobytes()) for k in ks]
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64()), "start": pa.array([start + int(r.starts[k]) for k in ks], pa.int64()), "n_tokens": pa.array([int(r.lengths[k]) for k in ks], pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return _read(manifest, "doc_id long, start long, n_tokens long, ids_crc32 long", rows)
