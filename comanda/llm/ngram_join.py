"""Near-duplicate self-join by Jaccard similarity of word n-gram sets (MinHash banding).

Every text becomes its set of five-word shingles. Texts with equal sets form one class of copies,
so copies are never paired. Classes meet in buckets, one for each band of their MinHash signature;
rows per band are fixed and the number of bands follows from the recall wanted at the threshold. A
bucket's members are verified on their full shingle sets, in pairs of blocks of at most about
BLOCK members, and each pair only in the first bucket that it shares, so no task holds a large
bucket and no pair counts twice. Tasks return counts of links and local components, not pairs,
unless pairs are asked for.

Defined cases: null and empty texts, and texts without words, are copies of each other and link to
nothing else; a text of fewer than five words has one shingle; null doc_ids come last in the choice
of a class's first document; repeated rows are copies; empty tables give empty results; further
columns of any name are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comanda.llm.common import Hashes, set_aside, shingles
from comanda.session import written

SIMILARITY, RECALL, ROWS, SIZE = 0.8, 0.9995, 6, 5
BLOCK = 256
#: Shingles that meet in one matrix product.
COLUMNS = 4096


def n_bands(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of ``rows`` values so that a pair at the threshold shares one with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def band_hashes(s: np.ndarray, multipliers: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One signed 64-bit hash for each band of the MinHash signature of the shingle set ``s``."""
    low = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(multipliers), 2**32 - 1, np.uint32)
    for k in range(0, len(low), 1024):
        np.minimum(least, (low[None, k : k + 1024] * multipliers[:, None]).min(axis=1), out=least)
    return np.array([xxhash.xxh3_64_intdigest(x.tobytes(), seed=b) for b, x in enumerate(least.reshape(-1, rows))], np.uint64).view(np.int64)


def _set_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def sketched(docs: DataFrame, bands: int, size: int = SIZE) -> DataFrame:
    """doc_id, text_hash, key (of the shingle set), n_shingles and band hashes of every row."""
    multipliers = np.random.default_rng(11).integers(0, 2**31, bands * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            sets = [shingles(x, hashes, size) for x in batch.column(2).to_pylist()]
            made = [band_hashes(s, multipliers) if len(s) else np.empty(0, np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(list(map(_set_key, sets)), pa.binary()), pa.array(list(map(len, sets)), pa.int32()), pa.array(made, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "key", "n_shingles", "bands"],
            )

    return _identified(docs).mapInArrow(sketch, "doc_id long, text_hash long, key binary, n_shingles int, bands array<long>")


def _first(doc_id: Column, text_hash: Column) -> Column:
    return F.min(F.struct(doc_id.isNull().alias("no_id"), doc_id.alias("doc_id"), text_hash.alias("text_hash")))


def _members(sketches: DataFrame) -> DataFrame:
    """key, buckets (at most one for each band): the shared buckets of every class that has any.

    Buckets of the same members count once.
    """
    rows = sketches.filter("n_shingles > 0").select("key", F.explode("bands").alias("bucket")).distinct()
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("key")).alias("who")).filter("m > 1")
    kept = sizes.groupBy("m", "who").agg(F.min("bucket").alias("bucket")).select("bucket", "m")
    return rows.join(kept, "bucket").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("bucket", "m"))).alias("buckets"))


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, which, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[which] > 1
    owner, which = owner[shared], which[shared]
    column = np.cumsum(times > 1)[which] - 1
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((n, n), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        x = np.zeros((n, COLUMNS), np.float32)
        x[owner[a:b], column[a:b] - lo] = 1
        both += x @ x.T
    return both


def linked(sets: list[np.ndarray], buckets: list[np.ndarray], blocks: np.ndarray, bucket: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, similarities) as matrices: similar pairs whose first shared bucket is this one; of
    two blocks, pairs across them."""
    both, sizes = _intersections(sets), np.array([len(s) for s in sets], np.float32)
    jaccard = both / np.maximum(sizes[:, None] + sizes[None, :] - both, 1)
    link = jaccard >= similarity - 1e-6
    earlier = [x[x < bucket] for x in buckets]
    ids, column = np.unique(np.concatenate(earlier), return_inverse=True)
    if len(ids):
        x = np.zeros((len(sets), len(ids)), np.float32)
        x[np.repeat(np.arange(len(sets)), list(map(len, earlier))), column] = 1
        link &= (x @ x.T) == 0
    if len(set(blocks.tolist())) > 1:
        link &= blocks[:, None] != blocks[None, :]
    np.fill_diagonal(link, False)
    return link, jaccard


def _roots(link: np.ndarray) -> np.ndarray:
    """The least member of each member's component."""
    root = np.arange(len(link))
    while True:
        new = np.minimum(root, np.where(link, root[None, :], len(link)).min(axis=1))
        if (new == root).all():
            return root
        root = new


def _verified(docs: DataFrame, candidates: DataFrame, similarity: float, size: int, pairs: bool) -> DataFrame:
    """For each class and pair of blocks: (key, links, root), or with ``pairs`` (key, other, similarity)."""

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sets = [shingles(x, hashes, size).view(np.int64) for x in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sets, pa.list_(pa.int64()))], ["key", "copies", "buckets", "shingles"])

    texts = _identified(docs).join(candidates, (F.col("doc_id").eqNullSafe(F.col("first.doc_id"))) & (F.col("text_hash") == F.col("first.text_hash")))
    sets = texts.select("key", "copies", "buckets", "text").mapInArrow(shingled, "key binary, copies long, buckets array<struct<bucket:long,m:long>>, shingles array<long>")
    rows = sets.select("key", "copies", "shingles", F.col("buckets.bucket").alias("all_buckets"), F.explode("buckets").alias("b"))
    n = F.ceil(F.col("b.m") / BLOCK).cast("int")
    rows = rows.withColumn("n", n).withColumn("block", F.pmod(F.xxhash64("key", "b.bucket"), F.col("n")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    rows = rows.select("key", "copies", "shingles", "all_buckets", "block", F.col("b.bucket").alias("bucket"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def verify(group: pa.Table) -> pa.Table:
        keys = group.column("key").to_pylist()
        order = [i for k, i in {k: i for i, k in enumerate(keys)}.items()]  # repeated rows of a document are one member
        order.sort(key=keys.__getitem__)
        group = group.take(order)
        keys = group.column("key").to_pylist()
        arrays = lambda name: [x.values.to_numpy(zero_copy_only=False) for x in group.column(name)]
        blocks, bucket = group.column("block").to_numpy(), group.column("bucket")[0].as_py()
        link, jaccard = linked([s.view(np.uint64) for s in arrays("shingles")], arrays("all_buckets"), blocks, bucket, similarity)
        if pairs:
            a, b = np.nonzero(np.triu(link))
            return pa.table({"key": pa.array([keys[x] for x in a], pa.binary()), "other": pa.array([keys[x] for x in b], pa.binary()), "similarity": pa.array(jaccard[a, b].astype(float), pa.float64())})
        links, root = link @ group.column("copies").to_numpy(), _roots(link)
        has = np.nonzero(links)[0]
        return pa.table({"key": pa.array([keys[x] for x in has], pa.binary()), "links": pa.array(links[has], pa.int64()), "root": pa.array([keys[root[x]] for x in has], pa.binary())})

    schema = "key binary, other binary, similarity double" if pairs else "key binary, links long, root binary"
    return rows.groupBy("bucket", "i", "j").applyInArrow(verify, schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``edges(a, b)``; root is the least node of the component.

    Alternating large and small stars: each round writes its edges, at most as many as before.
    """
    state = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"))
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    seen = edges.agg(state.alias("s")).first()["s"]
    while True:
        for large in (True, False):
            near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
            least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
            out = near.join(least, "a")
            moved = out.filter("b > a") if large else out
            new = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
            if not large:  # the node itself follows its least neighbour too
                new = new.unionByName(least.select("a", F.col("m").alias("b")))
            edges = written(new.filter("a <> b").distinct(), "star")
        now = edges.agg(state.alias("s")).first()["s"]
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _candidates(docs: DataFrame, similarity: float, recall: float, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    sketches = written(sketched(docs, n_bands(similarity, recall), size), "sketches")
    classes = sketches.groupBy("key").agg(_first(F.col("doc_id"), F.col("text_hash")).alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes, "copies")
    return sketches, classes, written(_members(sketches).join(classes, "key"), "candidates")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, size: int = SIZE) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, text_hash, class_id (least doc_id of its group of
    linked documents), n_copies (rows of its shingle set), n_links (other rows at the similarity or
    above, copies included) and first: whether it stands for its group."""
    sketches, classes, candidates = _candidates(docs, similarity, recall, size)
    verified = written(_verified(docs, candidates, similarity, size, pairs=False), "links")
    links = verified.groupBy("key").agg(F.sum("links").alias("links"))
    groups = components(verified.select(F.col("key").alias("a"), F.col("root").alias("b")))
    grouped = groups.join(classes, groups["node"] == classes["key"]).select("key", "root", "first", "copies").join(links, "key", "left")
    heads = grouped.groupBy("root").agg(F.min("first").alias("head"))
    grouped = grouped.join(heads, "root").select("key", "copies", F.coalesce("links", F.lit(0)).alias("links"), "head")
    alone = classes.join(groups.select(F.col("node").alias("key")), "key", "left_anti").select("key", "copies", F.lit(0).cast("long").alias("links"), F.col("first").alias("head"))
    info = written(grouped.unionByName(alone), "groups")
    rows = sketches.select("doc_id", "text_hash", "key").join(info, "key")
    first = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash"))
    return rows.select("doc_id", "text_hash", F.col("head.doc_id").alias("class_id"), F.col("copies").alias("n_copies"), (F.col("copies") - 1 + F.col("links")).alias("n_links"), first.alias("first"))


def similar_pairs(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, size: int = SIZE) -> DataFrame:
    """(doc_id, other_id, similarity) for all pairs of different shingle sets, by the first
    documents of their classes of copies."""
    _, classes, candidates = _candidates(docs, similarity, recall, size)
    pairs = _verified(docs, candidates, similarity, size, pairs=True)
    id_of = lambda k, name: classes.select(F.col("key").alias(k), F.col("first.doc_id").alias(name))
    return pairs.join(id_of("key", "doc_id"), "key").join(id_of("other", "other_id"), "other").select("doc_id", "other_id", "similarity")


def first_of_groups(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that stand for their group of near duplicates, one each."""
    docs, restored = set_aside(docs, ("doc_id", "text"))
    firsts = near_duplicates(docs, **how).filter("first").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    rows = docs.withColumn("_own", F.xxhash64("text"))
    kept = rows.join(firsts, (rows["doc_id"].cast("long").eqNullSafe(F.col("_id"))) & (F.col("_own") == F.col("_hash")))
    return restored(kept.dropDuplicates(["_id", "_hash"]))
