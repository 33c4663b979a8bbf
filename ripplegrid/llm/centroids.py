"""Centroid clustering in whole numbers, each vector's nearest centroid found by the threshold algorithm.

A vector takes part if it has exactly ``dims`` components, none null, NaN or infinite; a component x becomes the integer
floor(1024 x). In every dimension the centroids stand in a list sorted by their value. A vector walks each list outward from
its own value: a centroid met for the first time gets its exact distance, and the gaps to the frontiers of all lists, squared
and added, bound every centroid not met yet from below. The walk ends when that sum strictly exceeds the best exact distance
(so that a tie of smaller number is still met), or when all centroids have been met.

A round is one narrow map over the vectors: a task adds up its vectors by cluster and sends a few numbers a cluster and
dimension, cut into limbs of 24 bits so that sums stay exact whatever the size of components and table. The driver gets as
many rows as there are clusters, dimensions and limbs. Nothing is shuffled but these; a lost executor repeats its tasks.

Defined cases: null and odd vectors take no part; a null vec_id takes part and becomes a starting centroid after all others;
rows of one id and equal vectors are rows of their own (equal starting centroids: the smaller number gets the vectors, the
other stays empty and where it is); fewer than k vectors make fewer centroids; an empty table gives no rows; other columns
are not read. Distances and inertias beyond a bigint are given as its largest value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCALE = 1024
_LIMB = 24
_LARGEST = 2**63 - 1
#: Components below this have distances that int64 holds for up to 64 dimensions; beyond it Python's integers are used.
_SMALL = 1 << 26
_CHUNK = 2048


def usable(vector: str, dims: int) -> Column:
    """True for a vector of exactly so many finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def whole(x: np.ndarray) -> np.ndarray:
    """floor(1024 x) as int64, or as Python's integers where a component is large."""
    x = np.asarray(x, dtype=float)
    scaled = np.floor(x * _SCALE) if not x.size or np.abs(x).max() < _SMALL / _SCALE else None
    if scaled is not None:
        return scaled.astype(np.int64)
    exact = [(int(v) * _SCALE if abs(v) >= 2**53 else int(np.floor(v * _SCALE))) for v in x.ravel().tolist()]
    return np.array([*exact, None], dtype=object)[:-1].reshape(x.shape)


def nearest(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of v the number of its nearest row of c (the smaller on ties) and the squared distance; and how many
    exact distances were computed. v and c are both int64 or both hold Python's integers."""
    k, dims = c.shape
    order = np.argsort(c, axis=0, kind="stable")
    lists = np.take_along_axis(c, order, 0)
    far = _SMALL * 4 if c.dtype != object else 1 + 2 * max(max(map(abs, c.ravel().tolist())), max(map(abs, v.ravel().tolist()), default=0))
    number, best, computed = np.zeros(len(v), dtype=np.int64), np.zeros(len(v), dtype=c.dtype), 0
    at = np.arange(dims)
    for start in range(0, len(v), _CHUNK):
        x = v[start : start + _CHUNK]
        rows = np.arange(len(x))
        low = (lists[None] <= x[:, None, :]).sum(axis=1) - 1
        high = low + 1
        met = np.zeros((len(x), k), dtype=bool)
        gaps = np.full((len(x), k), far * far * (dims + 1) if c.dtype == object else _LARGEST, dtype=c.dtype)
        while len(rows):
            own, lo, hi = x[rows], low[rows], high[rows]
            down = np.where(lo >= 0, own - lists[np.maximum(lo, 0), at], far)
            up = np.where(hi < k, lists[np.minimum(hi, k - 1), at] - own, far)
            below = down <= up
            frontier = np.where(below, down, up)
            taken = order[np.where(below, np.maximum(lo, 0), np.minimum(hi, k - 1)), at]
            low[rows], high[rows] = lo - below, hi + ~below
            new = np.zeros((len(rows), k), dtype=bool)
            new[np.arange(len(rows))[:, None], taken] = True
            r, n = np.nonzero(new & ~met[rows])
            apart = own[r] - c[n]
            gaps[rows[r], n] = (apart * apart).sum(axis=1)
            met[rows[r], n] = True
            computed += len(r)
            ended = ((frontier * frontier).sum(axis=1) > gaps[rows].min(axis=1)) | met[rows].all(axis=1)
            rows = rows[~ended]
        which = gaps.argmin(axis=1) if c.dtype != object else np.array([min(range(k), key=lambda j: (g[j], j)) for g in gaps.tolist()], dtype=np.int64)
        number[start : start + len(x)], best[start : start + len(x)] = which, gaps[np.arange(len(x)), which]
    return number, best, computed


def _vectors(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors of a batch have finite components only (a null counts as NaN), and those as whole numbers."""
    x = batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(float)
    finite = np.isfinite(x).all(axis=1)
    return finite, whole(x[finite])


def _both(v: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """v and the centroids in a common type."""
    large = v.dtype == object or v.shape[1] > 64 or max(abs(x) for c in centroids for x in c) >= _SMALL
    if not large:
        return v, np.array(centroids, dtype=np.int64)
    c = np.empty((len(centroids), len(centroids[0])), dtype=object)
    c[:] = centroids
    return np.array(v.tolist() + [[None] * v.shape[1]], dtype=object)[:-1], c


def _sums(centroids: list[list[int]], dims: int):
    """A task's vectors by cluster: rows (cluster, dim, limb, part); dim -1 counts the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[0] * dims for _ in centroids]
        count = [0] * len(centroids)
        for batch in batches:
            if batch.num_rows:
                v, c = _both(_vectors(batch, dims)[1], centroids)
                which, _, _ = nearest(v, c)
                for k in np.unique(which).tolist():
                    mine = v[which == k]
                    count[k] += len(mine)
                    total[k] = [a + int(b) for a, b in zip(total[k], mine.sum(axis=0).tolist(), strict=True)]
        rows = [(k, d, limb, part) for k, n in enumerate(count) if n for d, s in enumerate([*total[k], n]) for limb, part in _limbs(s)]
        columns = list(zip(*[(k, -1 if d == dims else d, limb, part) for k, d, limb, part in rows], strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64())], names=["cluster", "dim", "limb", "part"])

    return run


def _limbs(x: int) -> Iterator[tuple[int, int]]:
    sign, x, i = (-1 if x < 0 else 1), abs(x), 0
    while x:
        if part := x & (1 << _LIMB) - 1:
            yield i, sign * part
        x, i = x >> _LIMB, i + 1


def _moved(kept: DataFrame, centroids: list[list[int]], dims: int) -> list[list[int]]:
    """The centroids after one round; an empty one stays."""
    rows = kept.select("v").mapInArrow(_sums(centroids, dims), "cluster int, dim int, limb int, part bigint").groupBy("cluster", "dim", "limb").agg(F.sum("part").alias("part")).collect()
    sums: dict[tuple[int, int], int] = {}
    for r in rows:
        sums[r.cluster, r.dim] = sums.get((r.cluster, r.dim), 0) + (r.part << _LIMB * r.limb)
    return [[sums.get((k, d), 0) // n for d in range(dims)] if (n := sums.get((k, -1), 0)) else c for k, c in enumerate(centroids)]


def _assigned(centroids: list[list[int]], dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                finite, v = _vectors(batch, dims)
                which, distance, _ = nearest(*_both(v, centroids))
                capped = pa.array([min(int(x), _LARGEST) for x in distance.tolist()] if distance.dtype == object else distance, pa.int64())
                yield pa.RecordBatch.from_arrays([batch["vec_id"].filter(pa.array(finite)), pa.array(which.astype(np.int32)), capped], names=["vec_id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part.

    Centroids start as the k vectors with the smallest sha256 of ``<seed>:<vec_id>`` (of one id: the smallest vector first)."""
    plain = vectors.schema["embedding"].dataType.simpleString() in ("array<float>", "array<double>")
    v = F.col("embedding") if plain else F.col("embedding").cast("array<double>")
    kept = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).where(F.size("v") == dims)  # tasks leave out what is not finite
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.where(usable("v", dims)).orderBy(key.asc_nulls_last(), "v").limit(k).collect()  # k rows
    centroids = [whole(r.v).tolist() for r in first]
    schema = "vec_id bigint, cluster int, distance bigint"
    if not centroids:
        none = kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
        return none.withColumns({"cluster_inertia": F.col("distance"), "inertia": F.col("distance"), "centroid_sha256": F.lit("")}).where(F.lit(False))
    for _ in range(rounds):
        centroids = _moved(kept, centroids, dims)
    found = kept.mapInArrow(_assigned(centroids, dims), schema)
    inertia = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a cluster
    at = lambda values, kind: F.element_at(F.lit(values).cast(f"array<{kind}>"), F.col("cluster") + 1)
    return found.select(
        "vec_id", "cluster", "distance", at([min(inertia.get(i, 0), _LARGEST) for i in range(len(centroids))], "bigint").alias("cluster_inertia"), F.lit(min(sum(inertia.values()), _LARGEST)).cast("bigint").alias("inertia"),
        at([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids], "string").alias("centroid_sha256"),
    )
