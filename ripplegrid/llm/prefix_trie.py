"""The trie of conversation prefixes, with subtree totals by time-forward processing.

A turn is known by the md5 of its role and text; a node by the chained md5 of the turns on its path, so texts are read once
and never shuffled. Turns meet their conversation and the conversation they borrow their beginning from in one exchange
and stream through a task in order. Nodes are the distinct chained hashes.

Subtree totals (leaves, saved tokens, children) go from nodes to parents in reverse level order. The heavy nodes, of which
more than 1/``shares`` of all conversations are members and which are ``most`` at most, stay behind for the end. What hangs below them
falls apart into subtrees, each of at most so many conversations, and these are dealt to shards by the key of their topmost
node. In a shard nodes come sorted by falling depth (Spark's external sort), and what a node sends to its parent waits in a
priority queue ordered in the same way, which spills sorted runs to disk when it is full. The topmost nodes' totals are
added up by parent and then go up through the heavy nodes in the same manner.

The hash of the conversations that end in a node is made of sorted runs of ids: range parts turn ids into text, nodes that lie within
one part are hashed there, and of others only the pieces of text are brought together, in order.

Defined cases: a null conv_id takes no part, null role and text are empty, turns with a null number come first, turns of equal
number are ordered by the md5 of role and text (repeated rows are turns of their own), c - c % 100 keeps the sign of c as SQL
does, an empty table has no node, other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegrid.llm.common import scratch, written

ROOT = bytes(16)
#: A conversation borrows fewer turns than this.
_BORROWED = 6
_BATCH = 4096
_NODE = "conv_id bigint, depth bigint, parent binary, key binary, n_chars bigint, n_convs bigint, ends_sha256 string"


def _emit(rows: list[tuple], fields: list[pa.Field]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))


def _batched(rows: Iterator[tuple], fields: list[pa.Field]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == _BATCH:
            yield _emit(held, fields)
            held = []
    if held:
        yield _emit(held, fields)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


_PATH = [pa.field("conv_id", pa.int64()), pa.field("depth", pa.int64()), pa.field("parent", pa.binary()), pa.field("key", pa.binary()), pa.field("n_chars", pa.int64()), pa.field("last", pa.bool_())]


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rebuilt conversations out of (base, conv_id, digest, n_chars) in order: a row for each node on the path, the root first."""

    def walk() -> Iterator[tuple]:
        base = conv = None
        head: list[tuple[bytes, int]] = []
        pending, index, borrow = None, 0, 0
        for b, c, digest, n in _rows(batches):
            if b != base:
                base, head = b, []
            if c != conv or pending is None:
                if pending:
                    yield (*pending, True)
                conv, index, borrow = c, 0, zlib.crc32(str(c).encode()) % _BORROWED
                pending = (c, 0, None, ROOT, 0)
                for d, m in head[:borrow] if c != b else []:
                    yield (*pending, False)
                    pending = (c, pending[1] + 1, pending[3], hashlib.md5(pending[3] + d).digest(), m)
            if c == b and index < _BORROWED - 1:
                head.append((digest, n))
            if c == b or index >= borrow:
                yield (*pending, False)
                pending = (c, pending[1] + 1, pending[3], hashlib.md5(pending[3] + digest).digest(), n)
            index += 1
        if pending:
            yield (*pending, True)

    yield from _batched(walk(), _PATH)


_PIECE = [pa.field("key", pa.binary()), pa.field("first", pa.int64()), pa.field("sha", pa.string()), pa.field("piece", pa.binary())]


def _hashed_ends(most: int):
    """(key, conv_id) in order to hashes of the ids of each key: whole ones (sha) of keys that lie inside the part and are short, pieces of text of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def walk() -> Iterator[tuple]:
            key, first, held, size, inner = None, 0, [], 0, False
            for k, c in _rows(batches):
                if k != key:
                    if key is not None:
                        yield (key, first, hashlib.sha256(b",".join(held)).hexdigest(), None) if inner else (key, first, None, b",".join(held))
                        inner = True
                    key, first, held, size = k, c, [], 0
                elif size > most:  # a long list goes on in the next piece
                    yield (key, first, None, b",".join(held))
                    first, held, size, inner = c, [], 0, False
                held.append(str(c).encode())
                size += len(held[-1]) + 1
            if key is not None:
                yield (key, first, None, b",".join(held))

        yield from _batched(walk(), _PIECE)

    return run


def _joined_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, piece) in order to (key, sha) of all pieces."""

    def walk() -> Iterator[tuple]:
        key, state = None, None
        for k, piece in _rows(batches):
            if k != key:
                if key is not None:
                    yield key, state.hexdigest()
                key, state = k, hashlib.sha256(piece)
            else:
                state.update(b"," + piece)
        if key is not None:
            yield key, state.hexdigest()

    yield from _batched(walk(), [pa.field("key", pa.binary()), pa.field("sha", pa.string())])


class SpillingQueue:
    """A priority queue of tuples that keeps at most ``most`` of them in memory; the rest waits in sorted runs in files of
    the task's own, which are gone when they are closed."""

    def __init__(self, most: int = 200_000):
        self.most, self.heap, self.runs, self.spilled = most, [], [], 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.most:
            self._spill()

    def _spill(self) -> None:
        keep = self.most // 2
        self.heap.sort()
        run, self.heap = self.heap[keep:], self.heap[:keep]  # a sorted list is a heap; the nearest stay
        file = tempfile.TemporaryFile()
        for at in range(0, len(run), 1024):
            pickle.dump(run[at : at + 1024], file)
        file.seek(0)
        self.spilled += len(run)
        self._advance(iter([]), file)

    def _advance(self, block: Iterator[tuple], file) -> None:
        """The run's next item among the heads of the runs."""
        item = next(block, None)
        if item is None:
            try:
                block = iter(pickle.load(file))
            except EOFError:
                file.close()
                return
            item = next(block)
        heapq.heappush(self.runs, (item, id(file), block, file))

    def peek(self) -> tuple | None:
        own, other = self.heap[0] if self.heap else None, self.runs[0][0] if self.runs else None
        return min(own, other) if own is not None and other is not None else own if other is None else other

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            item, _, block, file = heapq.heappop(self.runs)
            self._advance(block, file)
            return item
        return heapq.heappop(self.heap)


_TOTALS = [*[pa.field(n, pa.binary()) for n in ("key", "parent", "top")], *[pa.field(n, pa.int64()) for n in ("conv_id", "depth", "n_convs")], pa.field("ends_sha256", pa.string()), *[pa.field(n, pa.int64()) for n in ("n_children", "n_leaves", "saved_tokens")]]
_TOTALS_SQL = "key binary, parent binary, top binary, conv_id bigint, depth bigint, n_convs bigint, ends_sha256 string, n_children bigint, n_leaves bigint, saved_tokens bigint"


def _time_forward(most: int):
    """Nodes (key, parent, top, conv_id, depth, n_convs, ends_sha256, n_chars, children, leaves, saved so far) by falling depth, then key, to their totals.

    What a node sends up is ordered by its parent's depth and key, so it is at the queue's head when the parent comes. A topmost
    node of a shard (its key is ``top``) sends nothing here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def walk() -> Iterator[tuple]:
            queue = SpillingQueue(most)
            for key, parent, top, conv, depth, n_convs, ends, n_chars, children, leaves, saved in _rows(batches):
                while (head := queue.peek()) is not None and head[:2] == (-depth, key):
                    _, _, below, kept = queue.pop()
                    children, leaves, saved = children + 1, leaves + below, saved + kept
                saved += (n_convs - 1) * n_chars
                leaves = leaves if children else 1
                if key != top:
                    queue.push((1 - depth, parent, leaves, saved))
                yield key, parent, top, conv, depth, n_convs, ends, children, leaves, saved

        yield from _batched(walk(), _TOTALS)

    return run


def _up(nodes: DataFrame, most: int) -> DataFrame:
    cols = ["key", "parent", "top", "conv_id", "depth", "n_convs", "ends_sha256", "n_chars", "n_children", "n_leaves", "saved_tokens"]
    return nodes.select(*cols).sortWithinPartitions(F.desc("depth"), "key").mapInArrow(_time_forward(most), _TOTALS_SQL)


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent, key, n_chars, last: the nodes on every rebuilt conversation's path; last marks its end."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"), F.length(text).cast("bigint").alias("n_chars"),
    ).withColumn("base", F.col("conv_id") - F.col("conv_id") % 100)
    ordered = turns.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "digest")
    return ordered.select("base", "conv_id", "digest", "n_chars").mapInArrow(_paths, "conv_id bigint, depth bigint, parent binary, key binary, n_chars bigint, last boolean")


def ends(steps: DataFrame, most: int = 1 << 16) -> DataFrame:
    """key, sha: of each node in which conversations end the hash of their ids."""
    ordered = steps.where("last").select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = written(ordered.mapInArrow(_hashed_ends(most), "key binary, first bigint, sha string, piece binary"), "trie-ends")
    rest = pieces.where("sha IS NULL").select("key", "first", "piece").repartition("key").sortWithinPartitions("key", "first")
    return pieces.where("sha IS NOT NULL").select("key", "sha").unionByName(rest.select("key", "piece").mapInArrow(_joined_ends, "key binary, sha string"))


def trie(conversations: DataFrame, shares: int = 256, most: int = 100_000, queue: int = 200_000) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    shares and most decide which nodes wait for the end, queue how many messages a task holds in memory; none of them changes the result."""
    spark = conversations.sparkSession
    with scratch(spark):
        steps = written(paths(conversations), "trie-paths")
        counted = steps.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent", ignorenulls=True).alias("parent"), F.first("n_chars").alias("n_chars"), F.count("*").alias("n_convs"))
        nodes = written(counted.join(ends(steps), "key", "left").select("conv_id", "depth", "parent", "key", "n_chars", "n_convs", F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256")), "trie-nodes")
        root = nodes.where("depth = 0").first()
        if root is None:
            return _named(spark.createDataFrame([], _TOTALS_SQL + ", parent_conv_id bigint"))
        least = root.n_convs // shares
        large = nodes.where((F.col("n_convs") > least) & (F.col("depth") > 0)).select("n_convs").orderBy(F.desc("n_convs")).limit(most + 1).collect() if most else [root]
        if len(large) > most:
            least = large[-1].n_convs
        heavy = (F.col("n_convs") > least) | (F.col("depth") == 0)
        keys = nodes.where(heavy).select("key")  # at most ``most`` and the root
        tops = steps.join(F.broadcast(keys), "key", "left_anti").groupBy("conv_id").agg(F.min_by("key", "depth").alias("top"))
        started = {"n_children": F.lit(0).cast("bigint"), "n_leaves": F.lit(0).cast("bigint"), "saved_tokens": F.lit(0).cast("bigint")}
        light = nodes.where(~heavy).join(tops, "conv_id").withColumns(started).repartition("top")
        below = written(_up(light, queue), "trie-below")
        sent = below.where("key = top").groupBy("parent").agg(*[f.alias(n) for n, f in zip(started, (F.count("*"), F.sum("n_leaves"), F.sum("saved_tokens")), strict=True)])
        upper = nodes.where(heavy).join(sent.withColumnRenamed("parent", "key"), "key", "left").withColumns({n: F.coalesce(F.col(n), v) for n, v in started.items()}).withColumn("top", F.lit(ROOT))
        whole = below.unionByName(_up(upper.coalesce(1), queue))
        parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
        return written(_named(whole.join(parents, "parent", "left")), "trie", keep=True)


def _named(nodes: DataFrame) -> DataFrame:
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
