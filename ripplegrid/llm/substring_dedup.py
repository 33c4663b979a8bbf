"""Exact substring dedup by fixed-block anchors.

A window is ``window`` consecutive words of one document. A word goes if a window that covers it also
starts in a document with a smaller doc_id. Any window holds a whole aligned block of
``(window + 1) // 2`` words, so it is enough to

1. index the non-overlapping blocks of every document and probe them with every rolling window of
   block length; both sides learn which of theirs have met a counterpart in another document,
2. extend around those anchors: only windows that hold an anchor are compared in full, and
3. join the windows that were confirmed to maximal exact repeats and cut those out.

Documents are dealt to chunks by ranges of doc_id of about as many bytes, so "smaller doc_id" is "smaller chunk"
between chunks and is settled inside a chunk without messages. A chunk sends every distinct hash once, packed as bytes
per hash bucket, however often it occurs: a passage that all documents share costs one entry per chunk
and no group of copies is ever expanded into pairs. Answers are one bit per hash sent. Bytes sent follow the input;
rows are chunks times buckets, but never more than the hashes, as a bucket that a chunk has nothing for gets no row.
A chunk and a bucket are of fixed bytes, whatever the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplegrid.llm.common import lean_group, range_bounds, range_part, small_batches, text_volume
from ripplegrid.llm.wordbytes import distinct, rolling, span_hashes, text_bytes, word_spans

_ID, _TEXT, _CHUNK = "__doc_id", "__text", "__chunk"
_MADE_TYPES = "n_words bigint, n_removed bigint, spans array<struct<start:int,end:int>>, kept_text string"
_MADE = ("n_words", "n_removed", "spans", "kept_text")
_ASK = "bucket int, chunk int, probes binary, blocks binary"
_ANSWER = "chunk int, bucket int, probes binary, blocks binary"


class _Chunk:
    """The documents of a chunk by ascending doc_id, and the hashes of their words."""

    def __init__(self, table: pa.Table):
        order = np.argsort(np.asarray(table[_ID].fill_null(0)), kind="stable")
        if len(order) and (np.diff(order) != 1).any():
            table = table.take(pa.array(order))
        self.table = table
        raw, at = text_bytes(table[_TEXT])
        starts, ends, first = word_spans(raw, at)
        self.raw, self.at, self.first = raw, at, first
        self.words = span_hashes(raw, starts, ends)
        self.row = np.repeat(np.arange(len(at) - 1), np.diff(first))
        ids, known = np.asarray(table[_ID].fill_null(0)), np.asarray(table[_ID].is_valid())
        self.rank = np.cumsum(np.concatenate([[0], np.diff(ids) != 0])) if len(ids) else np.zeros(0, np.int64)
        self.known = known

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the windows of k words of one document start, and their hashes; documents without an id take no part."""
        h = rolling(self.words, k)
        at = np.flatnonzero((self.row[: len(h)] == self.row[k - 1 :]) & self.known[self.row[: len(h)]]) if len(h) else np.zeros(0, np.int64)
        return at, h[at]


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a hash: ascending hashes have ascending buckets."""
    return ((values >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _key(values: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and low half of a hash, which is all that an anchor's message tells of it."""
    return _bucket(values, buckets) << np.uint64(32) | (values & np.uint64(0xFFFFFFFF))


def _packed(values: np.ndarray, of: np.ndarray, buckets: np.ndarray) -> pa.Array:
    """The values of each of the given ascending buckets as bytes; of: the bucket of each value, ascending, all of them given."""
    cuts = np.concatenate([[0], np.searchsorted(of, buckets, "right")]) * values.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(buckets), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


class _Groups:
    """Equal values of an array: distinct holds them ascending, of tells which one each place has."""

    def __init__(self, values: np.ndarray):
        self.order = np.argsort(values, kind="stable")
        sorted_ = values[self.order]
        self.new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]]) if len(values) else np.zeros(0, bool)
        self.distinct = sorted_[self.new]
        self.at = np.cumsum(self.new) - 1  # in sorted order

    def spread(self, of_distinct: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.order), of_distinct.dtype)
        out[self.order] = of_distinct[self.at]
        return out

    def any(self, flags: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.distinct), bool)
        out[self.at[flags[self.order]]] = True
        return out


def _messages(chunk: int, probes: np.ndarray, of_probes: np.ndarray, blocks: np.ndarray, of_blocks: np.ndarray) -> pa.Table:
    """A row for each bucket that has values of the chunk; of_: the bucket of each value."""
    buckets = distinct(np.concatenate([of_probes, of_blocks]))
    return pa.table({
        "bucket": pa.array(buckets.astype(np.int32)), "chunk": pa.array(np.full(len(buckets), chunk, np.int32)),
        "probes": _packed(probes, of_probes, buckets), "blocks": _packed(blocks, of_blocks, buckets),
    })


def _met(probes: np.ndarray, of_probe: np.ndarray, blocks: np.ndarray, of_block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which probes are among the blocks of a smaller chunk, and which blocks among the probes of a larger one."""
    if not len(probes) or not len(blocks):
        return np.zeros(len(probes), bool), np.zeros(len(blocks), bool)
    order = np.argsort(blocks, kind="stable")
    keys = blocks[order]
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    found, least = keys[edge], np.minimum.reduceat(of_block[order], edge)
    at = np.minimum(np.searchsorted(found, probes), len(found) - 1)
    hit = found[at] == probes
    most = np.full(len(found), -1, np.int32)
    np.maximum.at(most, at[hit], of_probe[hit])
    later = np.empty(len(blocks), bool)
    later[order] = np.repeat(most, np.diff(np.append(edge, len(keys)))) > of_block[order]
    return hit & (least[at] < of_probe), later


def _joined(column, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The values of all messages end to end, and how many each message has."""
    raw, at = text_bytes(column.cast(pa.large_binary()) if not isinstance(column, pa.ChunkedArray) else pa.chunked_array([c.cast(pa.large_binary()) for c in column.chunks], pa.large_binary()))
    return np.frombuffer(raw.tobytes(), dtype=dtype), np.diff(at) // np.dtype(dtype).itemsize


def _bits(met: np.ndarray, counts: np.ndarray) -> list[bytes]:
    cuts = np.concatenate([[0], np.cumsum(counts)])
    return [np.packbits(met[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _unpacked(answers: pa.Table, name: str, of: np.ndarray) -> np.ndarray:
    """The bits of all answers in the order in which the hashes were sent; of: the bucket of each, ascending."""
    out = np.zeros(len(of), dtype=bool)
    if answers.num_rows:
        buckets = np.asarray(answers["bucket"]).astype(np.uint64)
        for a, b, bits in zip(np.searchsorted(of, buckets, "left"), np.searchsorted(of, buckets, "right"), answers[name].to_pylist(), strict=True):
            out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    return out


def _anchors(c: _Chunk, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the rolling windows of block length, their hashes, and which of them are the document's own aligned blocks."""
    at, h = c.windows(size)
    return at, h, (at - c.first[c.row[at]]) % size == 0


def _local(groups: _Groups, rank: np.ndarray, aligned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inside a chunk: probes with a block in an earlier document, and blocks with a probe in a later one."""
    r, block = rank[groups.order], aligned[groups.order]
    first = np.full(len(groups.distinct), np.iinfo(np.int64).max)
    np.minimum.at(first, groups.at[block], r[block])
    last = r[np.append(np.flatnonzero(groups.new)[1:], len(r)) - 1] if len(r) else np.zeros(0, np.int64)
    probe, ref = np.zeros(len(r), bool), np.zeros(len(r), bool)
    probe[groups.order] = first[groups.at] < r
    ref[groups.order] = block & (last[groups.at] > r)
    return probe, ref


def _candidates(c: _Chunk, answers: pa.Table, window: int, size: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and hashes of the windows that hold an anchor, and which of them may be a repeat of an earlier document."""
    at, h, aligned = _anchors(c, size)
    groups = _Groups(_key(h, buckets))
    probe, ref = _local(groups, c.rank[c.row[at]], aligned)
    of = groups.distinct >> np.uint64(32)
    probe |= groups.spread(_unpacked(answers, "probes", of))
    sent = groups.any(aligned)
    met = np.zeros(len(sent), bool)
    met[sent] = _unpacked(answers, "blocks", of[sent])
    ref |= aligned & groups.spread(met)
    start, full = c.windows(window)
    marks = np.zeros((2, len(c.words) + 1), np.int32)
    marks[0, at[probe] + 1] = 1
    marks[1, at[ref] + 1] = 1
    seen = np.cumsum(marks, axis=1, dtype=np.int32)
    inside = seen[:, np.minimum(start + window - size + 1, len(c.words))] - seen[:, start]
    keep = (inside[0] > 0) | (inside[1] > 0)
    return start[keep], full[keep], inside[0][keep] > 0


def repeats(docs: DataFrame, window: int = 13, chunk_bytes: int = 3 << 20, bucket_bytes: int = 8 << 20, min_chunks: int = 64) -> DataFrame:
    """docs (doc_id, text, any other columns) with n_words, n_removed, spans (array of word ranges [start, end) that are
    cut, the maximal exact repeats) and kept_text (the words left, joined by one space); these four replace columns of
    the same name.

    Null texts have no words; texts of fewer than ``window`` words and rows without a doc_id are kept whole.
    Rows that share a doc_id are one document for "smaller" and lie in one chunk, as a document is judged as a whole.
    Windows count as equal if 64-bit hashes of their words are. A bucket has the hashes of about ``bucket_bytes`` of text.
    """
    small_batches(docs.sparkSession)
    size = (window + 1) // 2
    own = docs.select(*[c for c in docs.columns if c not in _MADE], F.col("doc_id").cast("bigint").alias(_ID), F.col("text").cast("string").alias(_TEXT))
    volume = text_volume(docs)
    parts, buckets = max(min_chunks, -(-volume // chunk_bytes)), max(16, -(-volume // bucket_bytes))
    bounds = range_bounds(own.select(_ID, F.octet_length(_TEXT).alias("bytes")), _ID, parts, F.coalesce("bytes", F.lit(0)) + 16)
    anywhere = F.pmod(F.xxhash64(_TEXT), F.lit(len(bounds) + 1)).cast("int")  # rows without an id take no part
    chunked = own.withColumn(_CHUNK, F.when(F.col(_ID).isNull(), anywhere).otherwise(range_part(F.col(_ID), bounds)))

    def ask(key, table):
        c = _Chunk(table)
        _, h, aligned = _anchors(c, size)
        keys = _key(h, buckets)
        sent = [distinct(keys), distinct(keys[aligned])]
        return _messages(key[0].as_py(), *[y for x in sent for y in ((x & np.uint64(0xFFFFFFFF)).astype(np.uint32), x >> np.uint64(32))])

    def answer(dtype):
        def of_bucket(key, table):
            chunk = np.asarray(table["chunk"]).astype(np.int32)
            probes, n_probes = _joined(table["probes"], dtype)
            blocks, n_blocks = _joined(table["blocks"], dtype)
            earlier, later = _met(probes, np.repeat(chunk, n_probes), blocks, np.repeat(chunk, n_blocks))
            return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "probes": pa.array(_bits(earlier, n_probes), pa.binary()), "blocks": pa.array(_bits(later, n_blocks), pa.binary())})

        return lambda key, table: lean_group(of_bucket, key, table)

    def ask_windows(key, table, answers):
        c = _Chunk(table)
        _, full, later = _candidates(c, answers, window, size, buckets)
        sent = [distinct(full[later]), distinct(full)]
        return _messages(_chunk_of(key, table), *[y for x in sent for y in (x, _bucket(x, buckets))])

    def cut_out(key, table, anchors, found):
        c = _Chunk(table)
        start, full, later = _candidates(c, anchors, window, size, buckets)
        groups = _Groups(full)
        sent = groups.any(later)
        elsewhere = np.zeros(len(sent), bool)
        elsewhere[sent] = _unpacked(found, "probes", _bucket(groups.distinct[sent], buckets))
        rank = c.rank[c.row[start]]
        first = rank[groups.order][groups.new]  # stable order: the first of equal windows has the smallest doc_id
        met = groups.spread(elsewhere) | (groups.spread(first) < rank)
        cover = np.zeros(len(c.words) + 1, np.int64)
        np.add.at(cover, start[met], 1)
        np.add.at(cover, start[met] + window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        return _result(c, gone)

    asked = chunked.groupBy(_CHUNK).applyInArrow(lambda key, table: lean_group(ask, key, table), _ASK)
    anchors = asked.groupBy("bucket").applyInArrow(answer(np.uint32), _ANSWER)
    asked = chunked.groupBy(_CHUNK).cogroup(anchors.groupBy("chunk")).applyInArrow(lambda key, table, answers: lean_group(ask_windows, key, table, answers), _ASK)
    found = asked.groupBy("bucket").applyInArrow(answer(np.uint64), _ANSWER)
    both = anchors.withColumn("step", F.lit(0)).unionByName(found.withColumn("step", F.lit(1)))

    carried = docs.select(*[c for c in docs.columns if c not in _MADE]).schema
    schema = T.StructType([*carried.fields, *T._parse_datatype_string(_MADE_TYPES).fields])

    def finish(key, table, answers):
        step = np.asarray(answers["step"]) if answers.num_rows else np.zeros(0, np.int64)
        parts = [answers.filter(pa.array(step == s)) for s in (0, 1)]
        return cut_out(key, table, *parts)

    return chunked.groupBy(_CHUNK).cogroup(both.groupBy("chunk")).applyInArrow(lambda key, table, answers: lean_group(finish, key, table, answers), schema)


def _chunk_of(key, table: pa.Table) -> int:
    return key[0].as_py() if key and key[0].as_py() is not None else table[_CHUNK][0].as_py()


def _result(c: _Chunk, gone: np.ndarray) -> pa.Table:
    cut = np.add.reduceat(np.append(gone, False).astype(np.int64), np.minimum(c.first[:-1], len(gone))) * (np.diff(c.first) > 0) if len(c.first) > 1 else np.zeros(0, np.int64)
    before = np.concatenate([[False], gone[:-1]])
    edge = np.zeros(len(gone) + 1, bool)
    edge[c.first[:-1][c.first[:-1] < len(gone)]] = True
    edge = edge[: len(gone)]
    span_start = np.flatnonzero(gone & (~before | edge))
    after = np.concatenate([gone[1:], [False]]) & ~np.concatenate([edge[1:], [True]])
    span_end = np.flatnonzero(gone & ~after) + 1
    of_doc = np.searchsorted(span_start, c.first)
    kept, data = [], c.raw.tobytes()
    for i in range(len(c.at) - 1):
        text = data[c.at[i] : c.at[i + 1]].split()
        if of_doc[i] < of_doc[i + 1]:
            left, last, base = [], 0, c.first[i]
            for a, b in zip(span_start[of_doc[i] : of_doc[i + 1]] - base, span_end[of_doc[i] : of_doc[i + 1]] - base, strict=True):
                left += text[last:a]
                last = b
            text = left + text[last:]
        kept.append(b" ".join(text))
    rows = np.repeat(np.arange(len(c.at) - 1), np.diff(of_doc))
    base = c.first[rows] if len(rows) else np.zeros(0, np.int64)
    structs = pa.StructArray.from_arrays([pa.array((span_start - base).astype(np.int32)), pa.array((span_end - base).astype(np.int32))], ["start", "end"])
    return pa.table({
        **{name: c.table[name] for name in c.table.column_names if name not in (_ID, _TEXT, _CHUNK)}, "n_words": pa.array(np.diff(c.first).astype(np.int64)), "n_removed": pa.array(cut),
        "spans": pa.ListArray.from_arrays(pa.array(of_doc.astype(np.int32)), structs), "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
    })
