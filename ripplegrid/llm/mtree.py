"""Exact top-k inner products by best-first search of M-trees.

Each component x becomes the integer floor(256 x). With M the largest squared norm of all rows, the point
(v, sqrt(M - v.v)) lies on a sphere, and for a query (q, 0) the squared distance is q.q + M - 2 q.v: the nearest points
have the largest inner products. Inner products are sums of integers in doubles, exact below 2**53. Rows are dealt to blocks of bounded size, every block becomes an M-tree of paged
nodes whose entries store a routing point, a covering radius and the distance to the parent's routing point. A
search takes the node with the smallest possible distance first and passes over entries by the triangle inequality on
stored distances alone, before it computes any. Distances only order and prune (with a margin for
rounding); what is compared in the end are integer inner products.

Queries meet every block, a block of them at a time, and the k best of each block are merged: rows and queries are never
gathered in one task. Queries times blocks is inherent to an exact search of a stated query set; the trees save the
distances inside.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_PAGE = 512
_MARGIN = 1e-6
_WHOLE = float(1 << 53)  # products of vectors of smaller squared norms are exact in doubles


class MTree:
    """Points of equal norm in pages: inner nodes of up to ``page`` children, leaves of up to ``page`` points, built by
    recursive assignment to the nearest of farthest-first routing points, which are points themselves.

    products gives the inner products of points with a query; with the norms of both they are the distances."""

    def __init__(self, values: np.ndarray, square: float, page: int = _PAGE):
        self.values, self.square, self.page = values, square, page
        self.norms = (values * values).sum(axis=1)
        self.children: list[np.ndarray] = []  # of inner nodes: node numbers; of leaves: row numbers
        self.leaf: list[bool] = []
        self.routing: list[np.ndarray] = []  # the entries' routing points
        self.radius: list[np.ndarray] = []  # covering radii of the entries
        self.parent: list[np.ndarray] = []  # distances of the entries to the node's own routing point
        self.root = self._build(np.arange(len(values)), 0) if len(values) else -1

    def _apart(self, rows: np.ndarray, row: int) -> np.ndarray:
        """Distances between points: the last coordinate makes all norms equal."""
        last = np.sqrt(np.maximum(0.0, self.square - self.norms))
        product = self.values[rows] @ self.values[row] + last[rows] * last[row]
        return np.sqrt(np.maximum(0.0, 2 * (self.square - product)))

    def _node(self, children, leaf, routing, radius, parent) -> int:
        self.children.append(np.asarray(children))
        self.leaf.append(leaf)
        self.routing.append(self.values[routing])
        self.radius.append(radius)
        self.parent.append(parent)
        return len(self.leaf) - 1

    def _build(self, rows: np.ndarray, center: int) -> int:
        if len(rows) <= self.page:
            return self._node(rows, True, rows, np.zeros(len(rows)), self._apart(rows, center))
        fan = max(2, min(self.page, -(-2 * len(rows) // self.page)))
        picked, to = [center if center in rows else int(rows[0])], []
        near = np.full(len(rows), np.inf)
        while True:
            to.append(self._apart(rows, picked[-1]))
            near = np.minimum(near, to[-1])
            far = int(np.argmax(near))
            if len(picked) == fan or near[far] <= _MARGIN * np.sqrt(self.square):
                break
            picked.append(int(rows[far]))
        if len(picked) == 1:  # all points are equal: pages of them
            parts = np.array_split(rows, min(self.page, -(-len(rows) // self.page)))
            picked, radius = picked * len(parts), np.array([_MARGIN * np.sqrt(self.square)] * len(parts))
        else:
            which = np.argmin(np.stack(to), axis=0)
            parts = [rows[which == i] for i in range(len(picked))]
            radius = np.array([to[i][which == i].max() for i in range(len(picked))])
            whole = [i for i, part in enumerate(parts) if len(part)]
            parts, picked, radius = [parts[i] for i in whole], [picked[i] for i in whole], radius[whole]
        children = [self._build(part, r) for part, r in zip(parts, picked, strict=True)]
        return self._node(children, False, np.array(picked), radius, self._apart(np.array(picked), center))

    def nearest(self, q: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[list[tuple[int, int]], int]:
        """The k best (score, -id) of rows whose id is not own, and how many inner products were computed."""
        best: list[tuple[int, int]] = []
        computed, bound, turn = 0, np.inf, 0
        both = float(q @ q) + self.square
        queue: list[tuple[float, int, int, float]] = [(0.0, 0, self.root, -1.0)] if self.root >= 0 else []
        while queue:
            low, _, node, to_center = heapq.heappop(queue)
            if low > bound:
                break
            routing, children = self.routing[node], self.children[node]
            if to_center >= 0 and bound < np.inf:
                maybe = np.flatnonzero(np.abs(to_center - self.parent[node]) - self.radius[node] <= bound)  # stored distances only
                routing, children = routing[maybe], children[maybe]
            else:
                maybe = slice(None)
            product = routing @ q
            computed += len(product)
            if self.leaf[node]:
                least = best[0][0] if len(best) == k else -np.inf
                for i in np.flatnonzero(product >= least):
                    found = (int(product[i]), -int(ids[children[i]]))
                    if found[1] == -own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, found)
                    elif found > best[0]:
                        heapq.heapreplace(best, found)
                if len(best) == k:
                    bound = np.sqrt(max(0.0, both - 2.0 * best[0][0])) * (1 + _MARGIN) + _MARGIN
                continue
            to = np.sqrt(np.maximum(0.0, both - 2.0 * product))
            lows = np.maximum(0.0, to - self.radius[node][maybe])
            for i in np.flatnonzero(lows <= bound):
                turn += 1
                heapq.heappush(queue, (float(lows[i]), turn, int(children[i]), float(to[i])))
        return sorted(best, reverse=True), computed


def quantized(vectors: DataFrame) -> DataFrame:
    """vec_id, v: floor(256 x) of every component; only rows with an id and finite components that are all there."""
    x, most = F.col("embedding"), float(1 << 62)
    whole = x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    part = lambda e: F.floor(F.greatest(F.least(e.cast("double") * 256, F.lit(most)), F.lit(-most)))
    return vectors.where(F.col("vec_id").isNotNull() & F.coalesce(whole, F.lit(False))).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(x, part).alias("v"))


def _exact(q: list[int], v: list[int]) -> int:
    """The inner product of integers of any size, at the ends of bigint at most."""
    return max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, v))))


def _matrix(column) -> np.ndarray:
    """A list column as rows of doubles, shorter ones padded by zeros."""
    column = column.combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    flat, cuts = np.asarray(column.flatten(), dtype=float), np.asarray(column.offsets, dtype=np.int64)
    sizes = np.diff(cuts)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - (cuts[:-1] - cuts[0])[row]] = flat
    return out


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, block_rows: int = 16384, query_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, the k other rows with the largest
    integer inner products, ties to the smaller vec_id.

    vectors has vec_id and embedding, other columns are not looked at. Shorter vectors count as padded by zeros. Rows that repeat
    an id are candidates one by one, but never of a query with their id; a repeated query id is one query, its first vector in order.
    Components saturate at 2**62 and scores at the ends of bigint; vectors of a squared norm from 2**53 on, whose products doubles
    do not hold, are compared one by one in whole numbers.
    """
    rows = quantized(vectors)
    norm = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    n, most = rows.agg(F.count("*"), F.max(F.when(norm < _WHOLE, norm))).first()
    blocks = max(1, -(-n // block_rows))
    dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "v")
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    parts = max(1, -(-n // every // query_rows))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("vec_id", F.lit("q")), F.lit(parts)).cast("int").alias("part"), "vec_id", "v")
    if parts > 1:  # a block serves its queries a part at a time
        dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    else:
        dealt = dealt.withColumn("part", F.lit(0))
    most = float(most or 0)

    def search(key, own, wanted):
        ids, q_ids = np.asarray(own["vec_id"]), np.asarray(wanted["vec_id"])
        out: list[tuple] = []
        if len(ids) and len(q_ids):
            values, asked_values = _matrix(own["v"]), _matrix(wanted["v"])
            width = max(values.shape[1], asked_values.shape[1])
            values, asked_values = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (values, asked_values))
            large, wide = np.flatnonzero((values * values).sum(axis=1) >= _WHOLE), (asked_values * asked_values).sum(axis=1) >= _WHOLE
            rest = np.setdiff1d(np.arange(len(ids)), large)
            tree = MTree(values[rest], most)
            for at, (q_id, q) in enumerate(zip(q_ids.tolist(), asked_values, strict=True)):
                alone = range(len(ids)) if wide[at] else large.tolist()
                best = [] if wide[at] else tree.nearest(q, ids[rest], q_id, k)[0]
                if len(alone):
                    whole = wanted["v"][at].as_py()
                    best = heapq.nlargest(k, best + [(_exact(whole, own["v"][i].as_py()), -int(ids[i])) for i in alone if ids[i] != q_id])
                out += [(q_id, -i, s) for s, i in best]
        return pa.table({"query_id": pa.array([x[0] for x in out], pa.int64()), "vec_id": pa.array([x[1] for x in out], pa.int64()), "score": pa.array([x[2] for x in out], pa.int64())})

    found = dealt.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(rank).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
