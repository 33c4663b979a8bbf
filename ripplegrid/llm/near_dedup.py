"""Near-duplicates by BagMinHash over multisets of word shingles.

A shingle of weight w holds w unit cells, in dyadic intervals (0, 1], (1, 2], (2, 4] and so on. Every interval has a Poisson
process of its own, seeded by the shingle, whose points come in order of time, each with a signature slot and a cell;
a text sees the points of its cells only. The earliest point of each slot is the signature, so two texts agree
in a slot with probability equal to their weighted Jaccard similarity. A process stops as soon as its next point
comes after the latest slot is filled, which for long texts is after about one point per shingle.

Signatures are cut into bands. Texts that share a band meet a few leaders of that band first (its smallest id, that of the
smallest hash, and in later rounds, while these find many links, members of its largest class), so large groups of copies
are linked by work that follows the number of rows. Texts of bands that hold more than one class after that meet by their
rarest shingles: two texts of a similarity of at least the threshold share one of the first ``weight - ceil(threshold * weight) + 1``
in any order of shingles, so of two classes that share a band every pair is compared or excluded by a bound. Pairs that met are
verified by the exact multiset overlap of their shingles. Copies (equal word sequences) are one class from the start. Linked
classes become groups by label propagation over written tables.
"""

from __future__ import annotations

import hashlib
import operator
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegrid.llm.common import lean, scratch, small_batches, written
from ripplegrid.llm.wordbytes import mix, rolling, span_hashes, text_bytes, word_spans

_SLICE = 1 << 19
_STEP = 0x9E3779B97F4A7C15
_GOLDEN = np.uint64(_STEP)
#: At most so many ids are broadcast (about 64 bytes each in a task's table); beyond, Spark shuffles both sides.
_BROADCAST_IDS = 1 << 20
_WORTH = 16  # a further round of leaders must bring one in so many of all links
_SALTS = 64  # parts over which the pairs of one leader are dealt
_ORDER_BITS = 18  # shingles are ordered by how often their cells of so many bits are met; any order gives the same links
_BLOCK = 256  # texts of one shingle that one key of the join holds
_BEFORE = 4  # elements before it that come along with each element of a prefix
_SETS = 8  # longs of a text's bitmap: each bit tells whether it has an odd number of the elements that fall there
_BITMAP = [f"set{i}" for i in range(_SETS)]
_ROWS = 2048  # texts of a slice, at most


def _points(seed: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The turn-th waiting time (of rate 1), slot word and cell word of each process."""
    u, v = (mix(seed + np.uint64(_STEP * (2 * turn + i) % 2**64)) for i in (1, 2))
    return -np.log(((u >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53), v >> np.uint64(32), v & np.uint64(0xFFFFFFFF)


def signatures(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, slots: int) -> np.ndarray:
    """BagMinHash signatures (32-bit) of n texts from their distinct shingles and weights; texts without shingles get zeros."""
    if not len(row):
        return np.zeros((n, slots), np.uint32)
    time = np.full((n, slots), np.inf)
    rows, seeds, cells, limits = [], [], [], []
    level, left = 0, np.arange(len(row))
    while len(left):
        low = 0 if level == 0 else 1 << (level - 1)
        left = left[weight[left] > low]
        width = 1 if level == 0 else low
        rows.append(row[left])
        seeds.append(mix(shingle[left] + np.uint64(_STEP * level % 2**64)))
        cells.append(np.full(len(left), width))
        limits.append(np.minimum(weight[left] - low, width))
        level += 1
    row, seed = np.concatenate(rows), np.concatenate(seeds)
    cell, limit = np.concatenate(cells), np.concatenate(limits)
    at = np.zeros(len(row))
    latest = np.where(np.bincount(row, minlength=n) > 0, np.inf, -1.0)
    turn = 0
    while len(row):
        many = max(1, min(32, 4096 // len(row)))
        for _ in range(many):
            wait, slot, place = _points(seed, turn)
            turn += 1
            at = at + wait / (slots * cell)
            seen = (place * cell.astype(np.uint64) >> np.uint64(32)).astype(np.int64) < limit
            np.minimum.at(time, (row[seen], (slot[seen] % np.uint64(slots)).astype(np.int64)), at[seen])
        some = np.unique(row) if len(row) < 4096 else np.arange(n)
        latest[some] = time[some].max(axis=1)
        on = at <= latest[row]
        row, seed, cell, limit, at = row[on], seed[on], cell[on], limit[on], at[on]
    out = (mix(time.view(np.uint64)) >> np.uint64(32)).astype(np.uint32)
    out[~np.isfinite(time).all(axis=1)] = 0
    return out


def shingles(raw: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of every shingle of k words (lower-cased ASCII), sorted; words, and words before each text.

    A text of 1 to k - 1 words is one shingle as a whole."""
    starts, ends, first = word_spans(raw, at)
    words = span_hashes(raw, starts, ends, lower=True)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    h = rolling(words, k)
    inside = row[: len(h)] == row[k - 1 :] if len(h) else np.zeros(0, bool)
    of, value = row[: len(h)][inside], h[inside]
    size = np.diff(first)
    short = np.flatnonzero((size > 0) & (size < k))
    whole = [mix(np.bitwise_xor.reduce(mix(words[first[i] : first[i + 1]] + np.arange(size[i], dtype=np.uint64)), keepdims=True) + np.uint64(size[i])) for i in short]
    of = np.concatenate([of, short])
    value = np.concatenate([value, *whole])
    order = np.lexsort((value, of))
    return of[order], value[order], words, first, size


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs, with hashes of the text and of both."""
    doc_id, text = F.col("doc_id").cast("bigint"), F.col("text").cast("string")
    return docs.select(doc_id.alias("doc_id"), F.xxhash64(text).alias("text_key"), F.xxhash64(doc_id, text).alias("key"), text.alias("text"))


def _spelled(column, k: int):
    """Slices of the texts: first and last row, row and hash of each shingle in ascending order, and a hash of each text's words."""
    raw, at = text_bytes(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = min(n, i + _ROWS, max(i + 1, int(np.searchsorted(at, at[i] + _SLICE))))
        of, value, words, first, _ = shingles(raw[at[i] : at[j]], at[i : j + 1] - at[i], k)
        content = np.array([int.from_bytes(hashlib.blake2b(words[a:b].tobytes(), digest_size=8).digest(), "little", signed=True) for a, b in zip(first[:-1], first[1:], strict=True)], np.int64)
        yield i, j, of, value, content
        i = j


def _elements(of: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The element of every shingle, and where each text's next distinct shingle begins: the n-th of a text's equal shingles is an
    element of its own."""
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (of[1:] != of[:-1])]) if len(of) else np.zeros(0, bool)
    edge = np.flatnonzero(new)
    turn = np.arange(len(value)) - np.repeat(edge, np.diff(np.append(edge, len(value))))
    return mix(value + turn.astype(np.uint64) * _GOLDEN), edge


def _bitmaps(of: np.ndarray, element: np.ndarray, n: int) -> np.ndarray:
    """The bitmaps of n texts, of _SETS longs each."""
    odd = np.bincount(of * (64 * _SETS) + (element & np.uint64(64 * _SETS - 1)).astype(np.int64), minlength=n * 64 * _SETS) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8").reshape(-1, _SETS)


def _near(a: Callable[[str], Column], b: Callable[[str], Column], threshold: float) -> Column:
    """Whether two texts, whose columns a and b name, can reach the threshold: they differ in at least as many elements as their
    bitmaps in bits."""
    apart = reduce(operator.add, [F.bit_count(a(x).bitwiseXOR(b(x))) for x in _BITMAP])
    both = a("weight") + b("weight")
    return both - apart >= threshold * (both + apart) - 1e-6


def prepared(docs: DataFrame, k: int = 5, bands: int = 32, rows: int = 6) -> DataFrame:
    """doc_id, text_key (hash of the text as it is), key (hash of both), id (hash of its word sequence, so equal for copies),
    weight, bands, bitmap and row (a number of its own) of each text. Shingles are not written: the texts that are
    compared are read again."""

    def prepare(batches):
        for batch in batches:
            for i, j, of, value, content in _spelled(batch["text"], k):
                n = j - i
                element, edge = _elements(of, value)
                sig = signatures(of[edge], value[edge], np.diff(np.append(edge, len(of))), n, bands * rows)
                part = sig.reshape(n, bands, rows)
                key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (n, bands)).copy()
                for r in range(rows):
                    key = mix(key * _GOLDEN + part[:, :, r])
                weight = np.bincount(of, minlength=n)
                cuts = np.concatenate([[0], np.cumsum(np.where(weight > 0, bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    *[batch[c].slice(i, n) for c in ("doc_id", "text_key", "key")], pa.array(content), pa.array(weight.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(key[weight > 0].reshape(-1).view(np.int64))), *map(pa.array, _bitmaps(of, element, n).T.copy()),
                ], names=["doc_id", "text_key", "key", "id", "weight", "bands", *_BITMAP])

    made = _keyed(docs).mapInArrow(lambda batches: lean(prepare(batches)), "doc_id bigint, text_key bigint, key bigint, id bigint, weight bigint, bands array<bigint>, " + ", ".join(f"{x} bigint" for x in _BITMAP))
    return written(made.withColumn("row", F.monotonically_increasing_id()), "near-prepared")


def overlap(x: np.ndarray, y: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets, each given by its elements in ascending order."""
    if not len(x) and not len(y):
        return 1.0
    (ux, cx), (uy, cy) = (np.unique(v, return_counts=True) for v in (x, y))
    _, i, j = np.intersect1d(ux, uy, assume_unique=True, return_indices=True)
    both = int(np.minimum(cx[i], cy[j]).sum())
    return both / (len(x) + len(y) - both)


def _bags(column) -> list[np.ndarray]:
    raw, at = text_bytes(column.cast(pa.large_binary()))
    return [raw[i:j].view("<u8") for i, j in zip(at[:-1], at[1:], strict=True)]


def _pieces(batches, size: int = 1 << 18):
    """The batches in slices of about so many bytes of shingles, with row and value of each: what is made of a shingle takes many times its bytes."""
    for batch in batches:
        raw, at = text_bytes(batch["shingles"].cast(pa.large_binary()))
        i = 0
        while i < batch.num_rows:
            j = min(batch.num_rows, i + _ROWS, max(i + 1, int(np.searchsorted(at, at[i] + size))))
            yield batch.slice(i, j - i), np.repeat(np.arange(j - i), np.diff(at[i : j + 1]) // 8), raw[at[i] : at[j]].view("<u8")
            i = j


def _few(rows: DataFrame, many: int) -> DataFrame:
    return F.broadcast(rows) if many <= _BROADCAST_IDS else rows


def _bags_of(ids: DataFrame, many: int, docs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """id, weight, shingles (sorted 64-bit hashes) of the given ids (``many`` rows, of which some may be alike), from the text that
    stands for each class."""
    keys = ids.join(classes.select("id", "key"), "id").select("key")

    def spell(batches):
        for batch in batches:
            for i, j, of, value, content in _spelled(batch["text"], k):
                weight = np.bincount(of, minlength=j - i)
                cuts = np.concatenate([[0], np.cumsum(8 * weight)]).astype(np.int32)
                bags = pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(cuts), pa.py_buffer(value.astype("<u8"))])
                yield pa.RecordBatch.from_arrays([pa.array(content), pa.array(weight.astype(np.int64)), bags], names=["id", "weight", "shingles"])

    texts = _keyed(docs).join(_few(keys, many), "key", "left_semi").select("text")
    bags = texts.mapInArrow(lambda batches: lean(spell(batches)), "id bigint, weight bigint, shingles binary")
    bags = written(bags.withColumn("at", F.monotonically_increasing_id()), "near-shingles")
    one = bags.groupBy("id").agg(F.min("at").alias("at")).select("at")  # a row that comes twice, id and all, is read twice
    return bags.join(_few(one, many), "at", "left_semi").drop("at")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, threshold: float, k: int) -> DataFrame:
    """The pairs (a, b) whose overlap reaches the threshold, with it. The pairs of one leader are dealt over several parts,
    each of which gets the leader's shingles once."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    bags = _bags_of(needed, 2 * pairs.count(), docs, classes, k)
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(_SALTS)).cast("int"))
    left = salted.select("a", "salt").distinct().join(bags.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    right = bags.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))

    def verify(batches):
        for batch in batches:
            value = np.array([overlap(x, y) for x, y in zip(_bags(batch["sa"]), _bags(batch["sb"]), strict=True)])
            keep = np.flatnonzero(value >= threshold)
            yield pa.RecordBatch.from_arrays([batch["a"].take(pa.array(keep)), batch["b"].take(pa.array(keep)), pa.array(value[keep])], names=["a", "b", "similarity"])

    joined = salted.join(right, "b").join(left, ["a", "salt"]).select("a", "b", "sa", "sb")
    return written(joined.mapInArrow(lambda batches: lean(verify(batches)), "a bigint, b bigint, similarity double"), "near-links")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, root of every linked id: root is the smallest id of its component. Rounds of label propagation with pointer jumping,
    each written to the shared folder; stars, which leaders make, need two or three. A link that comes twice does no harm."""
    ends = F.array(F.struct(F.col(a).alias("id"), F.col(b).alias("other")), F.struct(F.col(b).alias("id"), F.col(a).alias("other")))
    both = written(links.select(F.inline(ends)), "links")
    labels = written(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("root")), "labels")
    while True:
        best = both.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("root").alias("near"))
        low = labels.join(best, "id").select("id", F.least("root", "near").alias("next"), "root")
        jump = labels.select(F.col("id").alias("next"), F.col("root").alias("far"))
        new = written(low.join(jump, "next").select("id", F.least("next", "far").alias("root"), (F.least("next", "far") < F.col("root")).alias("moved")), "labels")
        labels = new.select("id", "root")
        if not new.where("moved").limit(1).count():
            return labels


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """id, root of every linked id once links (a, b) come to those that the labels hold: roots are joined, not texts, so the work
    follows the new links."""
    for x in ("a", "b"):
        links = links.join(labels.select(F.col("id").alias(x), F.col("root").alias(f"root_{x}")), x, "left").withColumn(f"root_{x}", F.coalesce(f"root_{x}", x))
    merged = components(links.where("root_a <> root_b").select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct())
    alone = merged.join(labels.select("id"), "id", "left_anti")
    moved = labels.join(merged.select(F.col("id").alias("root"), F.col("root").alias("new")), "root", "left")
    return written(moved.select("id", F.coalesce("new", "root").alias("root")).unionByName(alone.select("id", "root")), "near-labels")


def _rest(member: DataFrame, docs: DataFrame, classes: DataFrame, labels: DataFrame, tried: DataFrame, threshold: float, k: int) -> DataFrame:
    """Pairs (a, b) of texts of bands that hold more than one class that can reach the threshold and were not tried.

    Prefix, length, positional and bitmap filter: a pair that is left out is of one class or proven to be below the threshold. Two
    texts meet at an element that their prefixes share only if the few before it have none in common: otherwise they have met
    at one of those, and the first that they share is never passed over."""
    apart = member.join(labels, "id", "left").withColumn("root", F.coalesce("root", "id"))
    several = apart.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most")
    open_ids = apart.join(several.select("band"), "band", "left_semi").select("id", "root").distinct()
    open_ids = written(open_ids, "near-open")
    rest = _bags_of(open_ids.select("id"), open_ids.count(), docs, classes, k).join(open_ids, "id")
    shift = np.uint64(64 - _ORDER_BITS)

    def count(batches):
        total = np.zeros(1 << _ORDER_BITS, np.int64)
        for _, row, value in _pieces(batches):
            total += np.bincount((_elements(row, value)[0] >> shift).astype(np.int64), minlength=len(total))
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[cell])], names=["cell", "n"])

    met = rest.select("shingles").mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(1 << _ORDER_BITS, np.int64)
    often[met["cell"].to_numpy()] = met["n"].to_numpy()

    def prefix(batches):
        for batch, row, shingle in _pieces(batches):
            element, _ = _elements(row, shingle)
            order = np.lexsort((element, often[(element >> shift).astype(np.int64)], row))
            weight = np.bincount(row, minlength=batch.num_rows)
            place = np.arange(len(row)) - np.repeat(np.cumsum(weight) - weight, weight)
            kept = place <= (weight - np.ceil(threshold * weight - 1e-9))[row]
            of, value = pa.array(row[kept]), element[order].view(np.int64)
            at, many = np.flatnonzero(kept), np.minimum(place[kept], _BEFORE)
            ends = np.cumsum(many)
            ahead = np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - ends, many)  # places of the elements before each
            last = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(value[ahead]))
            bits = _bitmaps(row, element, batch.num_rows)[row[kept]]
            yield pa.RecordBatch.from_arrays([*[batch[c].take(of) for c in ("id", "root", "weight")], pa.array(value[kept]), pa.array(place[kept]), last, *map(pa.array, bits.T.copy())], names=["id", "root", "weight", "element", "place", "last", *_BITMAP])

    tokens = written(rest.mapInArrow(lambda batches: lean(prefix(batches)), "id bigint, root bigint, weight bigint, element bigint, place bigint, last array<bigint>, " + ", ".join(f"{x} bigint" for x in _BITMAP)), "near-prefixes")
    hot = tokens.groupBy("element").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most")).where("least < most")
    salted = tokens.join(hot.select("element", F.ceil(F.col("n") / _BLOCK).cast("int").alias("blocks")), "element").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = salted.withColumn("other", other).select("id", "root", "weight", "element", "place", "last", *_BITMAP, "mine", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))
    keys = ["element", "low", "high"]
    left, right = (dealt.select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in ("id", "root", "weight", "place", "last", *_BITMAP, "mine")]) for s in ("a", "b"))
    once = (F.col("low") == F.col("high")) | (F.col("mine_a") != F.col("mine_b"))
    size = F.least("weight_a", "weight_b") >= threshold * F.greatest("weight_a", "weight_b")
    after = F.least(F.col("weight_a") - F.col("place_a"), F.col("weight_b") - F.col("place_b"))  # this element and those behind it
    place = F.least("place_a", "place_b") + after >= threshold / (1 + threshold) * (F.col("weight_a") + F.col("weight_b")) - 1e-6
    new = ~F.arrays_overlap("last_a", "last_b")
    pairs = left.join(right, keys).where((F.col("id_a") < F.col("id_b")) & (F.col("root_a") != F.col("root_b")) & once & size & place & _near(lambda c: F.col(f"{c}_a"), lambda c: F.col(f"{c}_b"), threshold) & new)
    return written(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"), "near-pairs")


def groups(docs: DataFrame, threshold: float = 0.8, k: int = 5, bands: int = 32, rows: int = 6, rounds: int = 6, leaders_per_class: int = 8, keys: bool = False) -> DataFrame:
    """doc_id, class_id, group_id, copies of every row of docs (doc_id, text; other columns are not looked at).

    class_id is the smallest id with the same word sequence (lower-cased ASCII, white space apart), copies the rows of that
    class; group_id the smallest class_id linked to it, directly or through others, by similarity >= threshold.
    Null and empty texts are copies of each other and of nothing else. Rows without an id take part as all others; their class
    and group are null if no row of them has an id. Rows that share an id are told apart by their words: with ``keys``,
    text_key (hash of the text) and group_key (one for each group, whatever its ids) come along.
    Texts that share no band are not compared: at similarity 0.8 a pair shares none of 32 bands of 6 with a
    probability below 0.0001.
    """
    with scratch(docs.sparkSession):
        found = _groups(docs, threshold, k, bands, rows, rounds, leaders_per_class)
        return written(found if keys else found.drop("text_key", "group_key"), "near-groups", keep=True)


def _groups(docs: DataFrame, threshold: float, k: int, bands: int, rows: int, rounds: int, leaders_per_class: int) -> DataFrame:
    small_batches(docs.sparkSession)
    table = prepared(docs, k, bands, rows)
    classes = written(table.groupBy("id").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.min("row").alias("row"), F.min_by("key", "row").alias("key")), "near-classes")
    member = table.join(classes.select("row", "class_id"), "row").select("id", "weight", *_BITMAP, F.col("class_id").alias("first"), F.explode("bands").alias("band"))
    shared = written(member.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"), "near-shared")
    member = written(member.join(_few(shared, shared.count()), "band"), "near-bands")
    who = F.struct(F.col("first").isNull().alias("last"), "first", "id", "weight", *_BITMAP)  # the least is that of the smallest doc_id
    tried, labels, linked = None, None, 0
    for turn in range(rounds):
        if labels is None:
            meeting = member.withColumn("root", F.col("id"))
            leaders = meeting.groupBy("band").agg(F.min(who).alias("x"), F.min_by(who, F.xxhash64("id")).alias("y"))
            leaders = leaders.select("band", F.explode(F.array_distinct(F.array("x", "y"))).alias("lead")).withColumn("lead_root", F.lit(None).cast("bigint"))
        else:
            apart = member.join(labels, "id", "left").withColumn("root", F.coalesce("root", "id"))
            draw = F.xxhash64("id", "band", F.lit(turn))
            some = apart.groupBy("band", "root", F.pmod(draw, F.lit(leaders_per_class)).alias("slot")).agg(F.min_by(who, draw).alias("who"), F.count("*").alias("n"))
            some = written(some, "near-classes")
            largest = some.groupBy("band", "root").agg(F.sum("n").alias("n")).groupBy("band").agg(F.max(F.struct("n", "root")).alias("x"), F.count("*").alias("classes")).where("classes > 1").select("band", F.col("x.root").alias("lead_root"))
            leaders = some.join(largest, "band").where("root = lead_root").select("band", F.col("who").alias("lead"), "lead_root")
            meeting = some.groupBy("band", "root").agg(F.min_by("who", "slot").alias("who")).select("band", "root", *[f"who.{c}" for c in ("id", "weight", *_BITMAP)])
        met = meeting.join(leaders, "band").where((F.col("lead.id") != F.col("id")) & (F.col("lead_root").isNull() | (F.col("lead_root") != F.col("root"))))
        met = met.where((F.least("weight", "lead.weight") >= threshold * F.greatest("weight", "lead.weight")) & _near(F.col, lambda c: F.col(f"lead.{c}"), threshold))
        pairs = met.select(F.least("lead.id", "id").alias("a"), F.greatest("lead.id", "id").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs, "near-pairs")
        found = _verified(pairs, docs, classes, threshold, k)
        tried = pairs if tried is None else tried.unionByName(pairs)
        new = found.count()
        if turn and not new:
            break
        labels = components(found) if labels is None else _joined(labels, found)
        linked += new
        if turn and new * _WORTH < linked:  # what few are still apart meet below
            break
    if labels is not None:
        found = _verified(_rest(member, docs, classes, labels, tried, threshold, k), docs, classes, threshold, k)
        if found.limit(1).count():
            labels = _joined(labels, found)
        least = labels.join(classes, "id").groupBy("root").agg(F.min("class_id").alias("group_id"))
        labels = labels.join(least, "root")
        classes = classes.join(labels, "id", "left").withColumn("group_id", F.when(F.col("root").isNull(), F.col("class_id")).otherwise(F.col("group_id")))
    else:
        classes = classes.withColumn("group_id", F.col("class_id")).withColumn("root", F.lit(None).cast("bigint"))
    named = classes.select("id", "class_id", "group_id", "copies", F.coalesce("root", "id").alias("group_key"))
    return table.select("doc_id", "text_key", "id").join(named, "id").drop("id")
