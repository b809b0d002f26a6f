"""Byte strings that earlier documents hold, found and removed on Burrows-Wheeler transforms.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller
doc_id. Every LENGTH-byte string has the least hash of its K-byte grams as its key; equal strings
have equal keys, so strings of different keys never need to meet. Runs of neighbouring starts with
one key are units. Keys are dealt to buckets; only units whose key several documents have are cut
out of the texts, and each bucket's distinct units form one text whose suffix order, transform and
LF mapping are built in the task. Threshold-bounded interval expansion then extends all intervals
of equal prefixes backwards at once, level by level: level l sets the common prefixes of length l,
and the levels end at LENGTH, where what is left unset are the intervals of repeated strings.

Large groups: tasks settle what they hold themselves before the shuffle (a key known to be shared
needs one witness; of equal units only those of the least doc_id go on), so a bucket holds at most
one of a thing from each task, however many documents have it. Buckets are worked off one by one.

Defined cases: null text is empty; texts shorter than LENGTH keep every byte; null doc_ids count as
the smallest and as one document, as do rows of equal doc_id; an empty table gives an empty result;
further columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH, K, MOST_STARTS = 50, 20, 64
#: Units that a task gathers before it settles and sends them on.
FLUSH = 400_000
#: Bytes of texts that are hashed in one go.
PORTION = 1 << 16
#: Bytes of text in a partition, at most, and so about the bytes of units in a bucket.
PARTITION_BYTES = 64 << 20
#: Bytes of units that go into one suffix order.
ORDER_BYTES = 1 << 20
#: Starts of strings that are looked up in one go.
STARTS = 1 << 20
NO_ID, NULLS = -(1 << 63), -(1 << 62)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_TWO = np.uint64(0xC2B2AE3D27D4EB4F)
_END = b"\xff"  # no byte of UTF-8


def _loads(data: bytes, n: int, at: int) -> np.ndarray:
    """The 8 bytes that begin at each of n positions, as numbers."""
    out = np.empty(n + 8, "<u8")
    for off in range(8):
        count = len(range(off, n, 8))
        out[off : off + 8 * count : 8] = np.frombuffer(data, "<u8", count, at + off)
    return out[:n]


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    have, out = 1, h
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, key, first start, number of starts) of all units of the texts."""
    joined = b"".join(texts)
    n = len(joined) - LENGTH + 1
    sizes = np.array(list(map(len, texts)), np.int64)
    begin = np.cumsum(sizes) - sizes
    if n <= 0 or sizes.max() < LENGTH:
        return (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    grams, data = len(joined) - K + 1, joined + bytes(16)
    h = _loads(data, grams, 0) * _ODD
    h ^= (h >> np.uint64(29)) + _loads(data, grams, 8)
    h *= _TWO
    h ^= (h >> np.uint64(32)) + _loads(data, grams, K - 8)
    h *= _ODD
    key = _least(h, LENGTH - K + 1)
    # starts whose string would leave its text count for nothing; runs end there too
    bad = np.zeros(n + 1, np.int8)
    last = begin + sizes
    np.add.at(bad, np.clip(last - LENGTH + 1, begin, n), 1)
    np.add.at(bad, np.minimum(last, n), -1)
    bad = np.cumsum(bad[:n]) > 0
    edge = np.empty(n, bool)
    edge[0] = True
    np.not_equal(key[1:], key[:-1], out=edge[1:])
    edge[begin[begin < n]] = True
    edge[1:] |= bad[1:] != bad[:-1]
    first = np.flatnonzero(edge)
    size = np.diff(np.append(first, n))
    good = ~bad[first]
    first, size = first[good], size[good]
    if len(size) and size.max() > MOST_STARTS:
        parts = -(-size // MOST_STARTS)
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, size = np.repeat(first, parts) + within * MOST_STARTS, np.minimum(np.repeat(size, parts) - within * MOST_STARTS, MOST_STARTS)
    key = key[first]
    key ^= key >> np.uint64(31)
    which = np.searchsorted(begin, first, side="right") - 1
    return which, key & np.uint64((1 << 48) - 1), first - begin[which], size


def _portions(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about PORTION bytes."""
    a = total = 0
    for k, t in enumerate(texts):
        total += len(t)
        if total >= PORTION:
            yield a, k + 1
            a, total = k + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _groups(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1]))


def _sorted_with(key: np.ndarray, values: np.ndarray, bits: int, fits: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and their values; where key and value fit one number, that number is sorted."""
    if fits:
        both = np.sort((key << np.uint64(bits)) | values.astype(np.uint64))
        return both >> np.uint64(bits), (both & np.uint64((1 << bits) - 1)).astype(np.int32)
    by = np.argsort(key)
    return key[by], values[by]


def suffix_order(data: bytes, depth: int = LENGTH) -> np.ndarray:
    """Positions in the order of their first ``depth`` bytes: prefixes double in width from round to
    round, and only positions that still tie take part."""
    n = len(data)
    bits = max(1, (n + 1).bit_length())
    width = (64 - bits) // 8
    key = _loads(data + bytes(16), n, 0).byteswap() >> np.uint64(64 - 8 * width)
    key, order = _sorted_with(key, np.arange(n, dtype=np.int32), bits, True)
    begin = _groups(key)
    sizes = np.diff(np.append(begin, n))
    rank = np.empty(n + 2 * depth, np.int32)
    rank[n:] = -1
    rank[order] = np.repeat(begin, sizes)
    slots = np.flatnonzero(np.repeat(sizes > 1, sizes))
    while width < depth and len(slots):
        open_ = order[slots]
        key = (rank[open_].astype(np.uint64) << np.uint64(bits)) | (rank[open_ + width] + 1).astype(np.uint64)
        key, open_ = _sorted_with(key, open_, bits, 3 * bits <= 64)
        order[slots] = open_
        begin = _groups(key)
        sizes = np.diff(np.append(begin, len(slots)))
        rank[open_] = np.repeat(slots[begin], sizes)
        slots = slots[np.repeat(sizes > 1, sizes)]
        width *= 2
    return order


def intervals(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(order, begins): positions by suffix, and where the intervals of equal ``length``-byte
    prefixes begin in that order.

    Level l extends every interval of equal l-byte prefixes backwards by each byte of the
    transform before it, all intervals at once: two neighbours that begin with one byte have a
    common prefix of l exactly if LF took them from neighbouring intervals that split at l - 1.
    """
    order, n = suffix_order(data), len(data)
    place = np.empty(n + 1, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    place[n] = place[0]
    back = place[order + 1]  # the inverse of LF, which takes the suffix at t to that at t - 1
    first = np.frombuffer(data, np.uint8)[order]
    bound = np.append(True, first[1:] != first[:-1])  # level 0: common prefixes of no byte
    unset = np.flatnonzero(~bound).astype(np.int32)
    left, right = back[unset - 1], back[unset]
    place = np.arange(n, dtype=np.int32)
    late = unset[:0]  # known to split at the next level
    for _ in range(1, length):
        if not len(unset) and not len(late):
            break
        interval = np.cumsum(bound, dtype=np.int32)
        same = interval[right] == interval[left]
        bound[unset[~same]] = True
        bound[late] = True
        unset, left, right, late = unset[same], left[same], right[same], late[:0]
        if 2 * len(unset) < len(bound):  # go on with the intervals of more than one suffix alone
            keep = ~bound
            keep[:-1] |= ~bound[1:]
            new = np.cumsum(keep, dtype=np.int32) - 1
            both = keep[left] & keep[right]
            late = new[unset[~both]]
            unset, left, right = new[unset[both]], new[left[both]], new[right[both]]
            bound, place = bound[keep], place[keep]
    begins = np.ones(n, bool)
    begins[place[np.append(unset, late)]] = False
    return order, np.flatnonzero(begins)


def least_holders(contents: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of the joined contents: the least id that holds the LENGTH bytes from there
    on; and where each content begins. ``ids`` has the least id of each content."""
    sizes = np.array([len(c) + 1 for c in contents], np.int64)
    begin = np.cumsum(sizes) - sizes
    data = _END.join(contents) + _END
    order, first = intervals(data)
    owner = np.repeat(np.arange(len(contents)), sizes)
    inside = np.arange(len(data)) - begin[owner] <= sizes[owner] - 1 - LENGTH
    held = np.where(inside, ids[owner], np.iinfo(np.int64).max)
    least = np.minimum.reduceat(held[order], first)
    out = np.empty(len(data), np.int64)
    out[order] = np.repeat(least, np.diff(np.append(first, len(data))))
    return out, begin


def _based(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, did, bytes. did is doc_id, and for rows without one a number under NULLS."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    did = F.coalesce("doc_id", F.lit(NULLS) - F.xxhash64("text").bitwiseAND(F.lit((1 << 40) - 1)))  # never null, so all joins share one exchange
    return rows.select("doc_id", did.alias("did"), F.col("text").cast("binary").alias("bytes")).repartition(n, "did")


def _order_of(did: np.ndarray) -> np.ndarray:
    """did as an order of documents: rows without doc_id are one document, the first."""
    return np.where(did <= NULLS, NO_ID, did)


def _tag(text: bytes) -> int:
    """Tells texts of one doc_id apart."""
    return xxhash.xxh32_intdigest(text)


def _packed(bucket: np.ndarray, n_buckets: int, columns: dict[str, np.ndarray]) -> tuple[list[int], dict[str, list[bytes]], list[np.ndarray]]:
    """The columns' bytes for each bucket that has rows, and those rows."""
    order = np.argsort(bucket.astype(np.int32), kind="stable")
    at = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    found = np.flatnonzero(np.diff(at))
    rows = [order[at[b] : at[b + 1]] for b in found]
    return found.tolist(), {name: [values[r].tobytes() for r in rows] for name, values in columns.items()}, rows


def _keys(base: DataFrame, n_buckets: int) -> DataFrame:
    """(bucket, keys, dids, kinds) as packed arrays; kinds: 0 a unit's key, 1 a witness of a key
    that is known to be shared, 2 a unit's key that is known to be shared. Keys have 48 bits here:
    one that looks shared by chance only brings its unit to the intervals."""

    def settle(held: list[tuple[np.ndarray, int]]) -> pa.RecordBatch:
        key = np.concatenate([k for k, _ in held])
        did = np.repeat(np.array([d for _, d in held], np.int64), [len(k) for k, _ in held])
        ident = _order_of(did)
        by = np.argsort(key)
        begin = _groups(key[by])
        size = np.diff(np.append(begin, len(key)))
        shared_group = np.minimum.reduceat(ident[by], begin) < np.maximum.reduceat(ident[by], begin)
        shared = np.empty(len(key), bool)
        shared[by] = np.repeat(shared_group, size)
        witness = key[by][begin[shared_group]]
        spread = (did.view(np.uint64) * _ODD) >> np.uint64(40)
        bucket = np.concatenate([np.where(shared, spread, key), witness]) % np.uint64(n_buckets)
        kind = np.append(shared.astype(np.uint8) * 2, np.ones(len(witness), np.uint8))
        key = np.concatenate([key, witness]).view(np.uint8).reshape(-1, 8)[:, :6]
        buckets, packed, _ = _packed(bucket, n_buckets, {"keys": key, "dids": np.append(did, np.zeros(len(witness), np.int64)), "kinds": kind})
        return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), *[pa.array(packed[c], pa.binary()) for c in ("keys", "dids", "kinds")]], ["bucket", "keys", "dids", "kinds"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            dids, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a, z in _portions(texts):
                which, keys, _, _ = units(texts[a:z])
                edges = np.searchsorted(which, np.arange(z - a + 1))
                for k in range(z - a):
                    own = np.unique(keys[edges[k] : edges[k + 1]])
                    if len(own):
                        held.append((own, dids[a + k]))
                        n += len(own)
                if n >= FLUSH:
                    yield settle(held)
                    held, n = [], 0
        if held:
            yield settle(held)

    return base.mapInArrow(found, "bucket int, keys binary, dids binary, kinds binary")


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole buckets from batches that are sorted by bucket."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        bucket = batch.column(0).to_numpy()
        edges = np.append(_groups(bucket), len(bucket))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if now is not None and bucket[a] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = bucket[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _shared_keys(keys: DataFrame, n: int) -> DataFrame:
    """(did, keys): the keys of a document that other documents have too."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_bucket(batches):
            six = np.frombuffer(b"".join(t.column("keys").to_pylist()), np.uint8).reshape(-1, 6)
            key = np.zeros((len(six), 8), np.uint8)
            key[:, :6] = six
            key = key.reshape(-1).view("<u8")
            did = np.frombuffer(b"".join(t.column("dids").to_pylist()), "<i8")
            kind = np.frombuffer(b"".join(t.column("kinds").to_pylist()), np.uint8)
            out, asked = np.flatnonzero(kind == 2), np.flatnonzero(kind < 2)
            if len(asked):
                by = asked[np.argsort(key[asked])]
                begin = _groups(key[by])
                size = np.diff(np.append(begin, len(by)))
                ident, witness = _order_of(did[by]), kind[by] == 1
                apart = np.minimum.reduceat(ident, begin) < np.maximum.reduceat(ident, begin)
                good = np.repeat(np.maximum.reduceat(witness, begin) | apart, size) & ~witness
                out = np.append(out, by[good])
            yield pa.RecordBatch.from_arrays([pa.array(did[out]), pa.array(key[out].view(np.int64))], ["did", "key"])

    dealt = keys.repartition(n, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(shared, "did long, key long").groupBy("did").agg(F.collect_list("key").alias("keys"))


#: subs: eight bits of the key, which split a bucket into texts of about ORDER_BYTES.
PLACES = (("dids", "<i8"), ("tags", "<u4"), ("ats", "<i4"), ("ns", "<i2"), ("subs", "u1"))
CUT = "bucket int, contents binary, " + ", ".join(f"{name} binary" for name, _ in PLACES)


def _cut(base: DataFrame, shared: DataFrame, n_buckets: int) -> DataFrame:
    """Shared units in packed arrays by bucket. Rows with contents hold units for the intervals;
    rows without hold units of which the same task has an equal one with a smaller doc_id: all
    their starts go."""

    def settle(held: dict[tuple[int, bytes], list[tuple[int, int, int, int]]]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        asked, done, contents = [], [], []
        for (key, content), uses in held.items():
            least = min(uses)[0]
            first = NO_ID if least <= NULLS else least
            for use in uses:
                if use[0] > max(first, NULLS):
                    done.append((use[0] * 0x9E3779B1 >> 7, *use, 0))
                else:
                    asked.append((key, *use, key >> 40 & 255))
                    contents.append(content)
        for rows, of in ((asked, contents), (done, None)):
            if not rows:
                continue
            columns = list(zip(*rows, strict=True))
            bucket = np.array([k % n_buckets for k in columns[0]], np.int64)
            buckets, packed, places = _packed(bucket, n_buckets, {name: np.array(c, kind) for (name, kind), c in zip(PLACES, columns[1:], strict=True)})
            texts = [squeeze.compress(b"".join([of[k] for k in p.tolist()])) for p in places] if of is not None else [None] * len(buckets)
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(texts, pa.binary()), *[pa.array(packed[name], pa.binary()) for name, _ in PLACES]], ["bucket", "contents", *[name for name, _ in PLACES]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = {}, 0
        for batch in batches:
            dids, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a, z in _portions(texts):
                which, keys, first, size = units(texts[a:z])
                edges = np.searchsorted(which, np.arange(z - a + 1))
                for k in range(a, z):
                    own = slice(*edges[k - a : k - a + 2])
                    known = np.unique(batch.column(3)[k].values.to_numpy().view(np.uint64))
                    slot = np.minimum(np.searchsorted(known, keys[own]), len(known) - 1)
                    u, text, did = np.flatnonzero(known[slot] == keys[own]), texts[k], dids[k]
                    tag = _tag(text)
                    n += len(u)
                    for key, at, many in zip(keys[own][u].tolist(), first[own][u].tolist(), size[own][u].tolist(), strict=True):
                        held.setdefault((key, text[at : at + many - 1 + LENGTH]), []).append((did, tag, at, many))
                if n >= FLUSH:
                    yield from settle(held)
                    held, n = {}, 0
        if held:
            yield from settle(held)

    return base.join(shared, "did").select("doc_id", "did", "bytes", "keys").mapInArrow(cut, CUT)


def _runs(size: np.ndarray, place: np.ndarray, ident: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(unit, offset, length) of each run of starts within a unit that a smaller document holds; whole
    units with about STARTS starts at a time."""
    upto = np.cumsum(size)
    edges = np.unique(np.concatenate([np.searchsorted(upto, np.arange(0, upto[-1], STARTS), side="right"), [0, len(size)]]))
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        n = size[lo:hi]
        unit = np.repeat(np.arange(lo, hi), n)
        off = np.arange(len(unit)) - np.repeat(np.cumsum(n) - n, n)
        goes = least[place[unit] + off] < ident[unit]
        edge = goes.copy()
        edge[1:] &= ~(goes[:-1] & (unit[1:] == unit[:-1]))
        last = goes.copy()
        last[:-1] &= ~(goes[1:] & (unit[1:] == unit[:-1]))
        a, z = np.flatnonzero(edge), np.flatnonzero(last)
        yield unit[a], off[a], off[z] - off[a] + 1


def _marked(cut: DataFrame, n: int) -> DataFrame:
    """(did, spans): the starts of strings that a smaller doc_id holds, by the text's tag."""

    def batch(place: list[np.ndarray]) -> pa.RecordBatch:
        did, tag, at, size = place[:4]
        return pa.RecordBatch.from_arrays([pa.array(did.astype(np.int64)), pa.array(tag.astype(np.uint32).view(np.int32)), pa.array(at.astype(np.int32)), pa.array(size.astype(np.int16))], ["did", "tag", "at", "n"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_bucket(batches):
            texts, asked = [], []
            for k, packed in enumerate(t.column("contents")):
                place = [np.frombuffer(t.column(name)[k].as_py(), kind) for name, kind in PLACES]
                if packed.is_valid:
                    texts.append(zstandard.ZstdDecompressor().decompress(packed.as_py()))
                    asked.append(place)
                else:
                    yield batch(place)
            if not asked:
                continue
            did, tag, at, size, sub = (np.concatenate([p[c] for p in asked]) for c in range(5))
            ident, size = _order_of(did), size.astype(np.int64)
            width = size - 1 + LENGTH
            of = np.repeat(np.arange(len(asked)), [len(p[0]) for p in asked])
            end = np.concatenate([np.cumsum(p[3].astype(np.int64) - 1 + LENGTH) for p in asked])
            part = sub.astype(np.int64) * -(-int(width.sum()) // ORDER_BYTES) // 256  # parts share no string
            by = np.argsort(part, kind="stable")
            for own in np.split(by, _groups(part[by])[1:]):
                number: dict[bytes, int] = {}
                which = np.array([number.setdefault(texts[x][z - w : z], len(number)) for x, z, w in zip(of[own].tolist(), end[own].tolist(), width[own].tolist(), strict=True)], np.int64)
                ids = np.full(len(number), np.iinfo(np.int64).max)
                np.minimum.at(ids, which, ident[own])
                least, begin = least_holders(list(number), ids)
                for unit, off, many in _runs(size[own], begin[which], ident[own], least):
                    u = own[unit]
                    yield batch([did[u], tag[u], at[u] + off, many])

    dealt = cut.repartition(n, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(mark, "did long, tag int, at int, n smallint").groupBy("did").agg(F.collect_list(F.struct("tag", "at", "n")).alias("spans"))


def removed_mask(n_bytes: int, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bytes covered by a string that starts in one of the spans of n starts from at."""
    step = np.bincount(at, minlength=n_bytes + 1) - np.bincount(at + n - 1 + LENGTH, minlength=n_bytes + 1)
    return np.cumsum(step[:n_bytes]) > 0


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _finished(base: DataFrame, marks: DataFrame, with_bytes: bool) -> DataFrame:
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                gone = runs = 0
                kept = text
                if batch.column(3)[k].is_valid:
                    tag, at, n = (x.to_numpy() for x in batch.column(3)[k].values.flatten())
                    own = tag.view(np.uint32) == _tag(text)
                    mask = removed_mask(len(text), at[own].astype(np.int64), n[own].astype(np.int64))
                    gone, runs = int(mask.sum()), int(np.count_nonzero(np.diff(np.append(False, mask).astype(np.int8)) == 1))
                    kept = np.frombuffer(text, np.uint8)[~mask].tobytes()
                rows.append((doc_id, len(text), gone, runs, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    # the texts' exchange is that of the earlier steps and is reused
    return base.join(marks, "did", "left").select("doc_id", "did", "bytes", "spans").mapInArrow(finish, KEPT)


def n_partitions(docs: DataFrame) -> int:
    """Partitions of about PARTITION_BYTES of text, and no fewer than the session asks for; a bucket
    of units, which is worked on in one task, follows their size."""
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // PARTITION_BYTES))


def without_repeats(docs: DataFrame, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left) of every row."""
    n = n_partitions(docs)
    base = _based(docs, n)
    shared = _shared_keys(_keys(base, n), n)
    marks = _marked(_cut(base, shared, n), n)
    return _finished(base, marks, with_bytes)
