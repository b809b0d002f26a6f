"""Ball k-means on vectors of integers, exact in every step.

A cluster is a ball: its centroid and a radius that holds its members. Once centroids move, the new
radius is at most the old one and the way moved, so balls that cannot share a member are told apart
by k numbers on the driver: the neighbours of a ball are the centroids within twice its radius. A
member compares its own distance d with half the distances to the neighbours, nearest first: within
half the nearest it lies in the stable core and is compared with none; in the annulus between the
t-th and the next it is compared with the t nearest neighbours. A centroid beyond 2 d is farther
than d, so nothing is lost, ties included.

Vectors with their cluster are written after each round, so a lost executor repeats one round; the
driver gets k rows of sums. Sums are added up in tasks first, whatever the size of a cluster.

Defined cases: null vectors and vectors of another length or with null or non-finite components are
left out; null vec_ids stay but start no centroid unless there are too few others (nulls come
last); repeated rows are clustered each by itself, and equal hashes start in the order of their
vectors; fewer vectors than k give as many centroids; an empty table gives an empty result; further
columns are not read. Scaled components beyond ``_most`` raise an error, as squared distances would
not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comanda.session import written

N_CLUSTERS, N_ROUNDS, N_DIMS, SCALE, SEED = 16, 3, 64, 64, 1
STATE = "vec_id long, q array<int>, cluster int, distance long"


def _most(n_dims: int) -> int:
    """Components up to this keep four times a squared distance within a long."""
    return (1 << 29) // (isqrt(n_dims - 1) + 1)


def quantised(vectors: DataFrame, n_dims: int = N_DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and q, the floors of the scaled components, of the vectors that are kept."""
    x = F.col("embedding")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    kept = vectors.filter(F.coalesce((F.size(x) == n_dims) & ~F.exists(x, bad), F.lit(False)))
    scaled = lambda c: F.floor(c.cast("double") * scale)
    wide = F.exists(x, lambda c: F.abs(c.cast("double") * scale) > _most(n_dims))
    q = F.when(wide, F.raise_error(F.lit(f"a scaled component is beyond {_most(n_dims)}"))).otherwise(F.transform(x, lambda c: scaled(c).cast("int")))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), q.cast("array<int>").alias("q"))


def start(q: DataFrame, k: int, seed: int = SEED) -> np.ndarray:
    """The vectors whose ids have the ``k`` smallest hashes, in that order."""
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = q.withColumn("h", by).orderBy(F.col("h").asc_nulls_last(), "q").limit(k).collect()  # k rows
    return np.array([r["q"] for r in first], np.int64)


def squared(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    d = x - centre
    return np.einsum("ij,ij->i", d, d)


@dataclass
class Balls:
    """Centroids and, for each, the neighbours that its ball can lose members to, nearest first, with
    the squared distances to them."""

    centres: np.ndarray
    neighbours: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, centres: np.ndarray, radii: list[int]) -> Balls:
        apart = [squared(centres, c) for c in centres]
        neighbours = []
        for i, radius in enumerate(radii):
            near = np.array([j for j in np.argsort(apart[i], kind="stable") if j != i and int(apart[i][j]) <= 4 * radius * radius], np.int64)
            neighbours.append((near, apart[i][near]))
        return cls(centres, neighbours)


def reassigned(x: np.ndarray, own: np.ndarray, balls: Balls) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid and squared distance of each member, given its cluster before."""
    best, distance = own.copy(), np.empty(len(x), np.int64)
    for i in np.unique(own):
        at = np.flatnonzero(own == i)
        members = x[at]
        d = squared(members, balls.centres[i])
        mine, least = np.full(len(at), i, own.dtype), d.copy()
        near, gaps = balls.neighbours[i]
        to_compare = np.searchsorted(gaps, 4 * d, side="right")  # 0 in the stable core, t in the t-th annulus
        for t, j in enumerate(near):
            ring = np.flatnonzero(to_compare > t)
            if not len(ring):
                break
            other = squared(members[ring], balls.centres[j])
            wins = (other < least[ring]) | ((other == least[ring]) & (j < mine[ring]))
            mine[ring[wins]], least[ring[wins]] = j, other[wins]
        best[at], distance[at] = mine, least
    return best, distance


def assigned_first(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every centroid is compared: no ball is known yet."""
    best, distance = np.zeros(len(x), np.int32), squared(x, centres[0])
    for j in range(1, len(centres)):
        d = squared(x, centres[j])
        wins = d < distance
        best[wins], distance[wins] = j, d[wins]
    return best, distance


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)


def _assign(state: DataFrame, assign) -> DataFrame:
    """``state`` with cluster and distance from ``assign(vectors, clusters before)``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = batch.column("cluster").to_numpy() if "cluster" in batch.schema.names else None
                best, distance = assign(_matrix(batch), own)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("q"), pa.array(best, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "q", "cluster", "distance"])

    return state.mapInArrow(rows, STATE)


def _totals(state: DataFrame, n_dims: int) -> list:
    """A row for each cluster with members: n, radius (squared) and exact sums by component."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                x, own, d = _matrix(batch), batch.column("cluster").to_numpy(), batch.column("distance").to_numpy()
                for i in np.unique(own):
                    at = own == i
                    row = sums.setdefault(int(i), np.zeros(n_dims + 2, np.int64))
                    row[0] += at.sum()
                    row[1] = max(row[1], d[at].max())
                    row[2:] += x[at].sum(axis=0)
        if sums:
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(list(sums), pa.int32()), "part": pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))})

    parts = state.select("cluster", "distance", "q").mapInArrow(partial, "cluster int, part array<long>")
    exact = lambda k: F.sum(F.col("part")[k].cast("decimal(38,0)"))
    return parts.groupBy("cluster").agg(exact(0).alias("n"), F.max(F.col("part")[1]).alias("radius"), F.array(*[exact(k + 2) for k in range(n_dims)]).alias("sums")).collect()  # k rows


def _ceil_root(n: int) -> int:
    return isqrt(n - 1) + 1 if n else 0


def moved(centres: np.ndarray, totals: list) -> Balls:
    """The balls around the means (floors) of their members; a cluster without members stays."""
    new, radii = centres.copy(), [0] * len(centres)
    for r in totals:
        i = r["cluster"]
        new[i] = [int(s) // int(r["n"]) for s in r["sums"]]
        way = int(squared(new[i : i + 1], centres[i])[0])
        radii[i] = _ceil_root(r["radius"]) + _ceil_root(way)
    return Balls.of(new, radii)


def clustered(vectors: DataFrame, k: int = N_CLUSTERS, n_rounds: int = N_ROUNDS, n_dims: int = N_DIMS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector, and the final centroids."""
    q = written(quantised(vectors, n_dims, scale), "quantised")
    centres = start(q, k, seed)
    if not len(centres):
        return q.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centres
    first = centres
    state = _assign(q, lambda x, own: assigned_first(x, first))
    for _ in range(n_rounds):
        state = written(state, "ball-members")
        balls = moved(centres, _totals(state, n_dims))
        centres = balls.centres
        state = _assign(state, lambda x, own, balls=balls: reassigned(x, own, balls))
    return written(state.select("vec_id", "cluster", "distance"), "clusters"), centres


def judged(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    members, centres = clustered(vectors)
    spread = {r["cluster"]: int(r["d"]) for r in members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    sha = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centres]
    of_cluster: list[Column] = [F.lit(x) for x in ([spread.get(i, 0) for i in range(len(centres))] or [0])]
    return members.select(
        "vec_id", "cluster", "distance",
        F.element_at(F.array(*[c.cast("long") for c in of_cluster]), F.col("cluster") + 1).alias("cluster_inertia"),
        F.lit(sum(spread.values())).cast("long").alias("inertia"),
        F.element_at(F.array(*map(F.lit, sha or [""])), F.col("cluster") + 1).alias("centroid_sha256"),
    )
