"""Packing token sequences so that every window holds the sources in their target proportions.

Documents become ids of a public tokenizer and an end id. Every source is a queue of tokens; a window of
``length`` tokens serves the queues in turn, each by its share of all tokens. What a queue is owed in fractions of a
token is its deficit and is carried to the next window: after w windows queue q has sent the whole part of
its due, and the queues with the largest deficits get the tokens left over. That state has a closed form, so any
partition starts with the deficits that the windows before it carry over, and no task walks through all windows.
Queues drain together, hence only the last window is short; it is cut into sequences of powers of two, which need no padding.

One map tokenizes and writes the ids, in the order of the files; only totals by partition and source are then
gathered, and a second map cuts the documents at the windows' bounds. No text or id is shuffled.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplegrid.llm.common import lean, small_batches, written
from ripplegrid.llm.wordbytes import span_hashes, text_bytes

_SLICE = 1 << 19
_KEPT = 1 << 17  # runs of letters whose ids a worker remembers
_KIND = np.full(256, 2, np.uint8)  # 0 white space, 1 letters and non-ASCII, 2 other ASCII
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_JOINS = np.zeros(256, bool)  # next to these a change of kind may lie inside a token
_JOINS[[0x27, 0x7C, *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


class Encoder:
    """Ids of many texts at once. Texts are cut at white space and between ASCII letters and other ASCII characters,
    where this tokenizer's pre-tokenization always ends a token; each distinct piece is encoded once."""

    def __init__(self, path: str, end: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        self.letters = Tokenizer(self.tokenizer.model)  # for lower-case ASCII letters, which normalization leaves as they are
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        if any(t.content.isalpha() for t in self.tokenizer.get_added_tokens_decoder().values()):
            self.letters = self.tokenizer
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.slot: dict[int, int] = {}
        self.ids, self.sizes, self.starts = np.array([end], np.uint32), np.array([1], np.int64), np.zeros(1, np.int64)
        self.uses = np.zeros(1, np.int64)  # slices that each piece was met in

    def _forget(self) -> None:
        """Keeps the pieces that most slices had, half of _KEPT at most and none that one slice alone had; what they were used counts half from now on."""
        often = np.argsort(-self.uses[1:], kind="stable")[: _KEPT // 2] + 1
        often = np.concatenate([[0], np.sort(often[self.uses[often] > 1])])
        place = np.full(len(self.uses), -1)
        place[often] = np.arange(len(often))
        place = place.tolist()
        self.slot = {h: place[i] for h, i in self.slot.items() if place[i] > 0}
        sizes = self.sizes[often]
        starts = np.cumsum(sizes) - sizes
        self.ids = self.ids[np.arange(sizes.sum()) + np.repeat(self.starts[often] - starts, sizes)]
        self.sizes, self.starts, self.uses = sizes, starts, self.uses[often] // 2

    def _learn(self, hashes: list[int], pieces: list[str]) -> None:
        """Encodes pieces. Lower-case Latin words are one pre-token each, whose last id alone closes a word, so many
        of them go to the tokenizer as one text."""
        plain = [p.isalpha() and p.islower() and (p.isascii() or max(p) < "\u0250") for p in pieces]
        groups = [[i for i, x in enumerate(plain) if x and pieces[i].isascii()], [i for i, x in enumerate(plain) if x and not pieces[i].isascii()]]
        order, ids, sizes = [], np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for group, tokenizer in zip(groups, (self.letters, self.tokenizer), strict=True):
            its, size = self._words([pieces[i] for i in group], tokenizer)
            if size is not None:
                order, ids, sizes = order + group, np.concatenate([ids, its]), np.concatenate([sizes, size])
        taken = set(order)
        rest = [i for i in range(len(pieces)) if i not in taken]
        found = [e.ids for e in self.tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False)]
        more = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.concatenate([ids, np.fromiter(chain.from_iterable(found), np.uint32, int(more.sum()))])
        sizes = np.concatenate([sizes, more])
        self.slot.update(zip([hashes[i] for i in [*order, *rest]], range(len(self.sizes), len(self.sizes) + len(sizes)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.uses = np.concatenate([self.uses, np.zeros(len(sizes), np.int64)])
        self.sizes, self.ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])

    def _words(self, words: list[str], tokenizer) -> tuple[np.ndarray, np.ndarray | None]:
        texts = [" ".join(words[i : i + 256]) for i in range(0, len(words), 256)]
        found = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(found), np.uint32)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words) or len(ids) and ends[-1] != len(ids):
            return ids, None
        return ids, np.diff(ends, prepend=0)

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, each closed by the end id, and where each begins and ends."""
        starts, ends = np.zeros(0, np.int64), np.zeros(0, np.int64)
        low = raw
        if len(raw):
            kind = _KIND[raw]
            join = _JOINS[raw]
            cut = np.ones(len(raw), bool)
            cut[1:] = (kind[1:] != kind[:-1]) & ((kind[1:] == 0) | (kind[:-1] == 0) | ~(join[1:] | join[:-1]))
            cut[at[:-1][at[:-1] < len(raw)]] = True
            edges = np.flatnonzero(cut)
            live = kind[edges] != 0
            starts, ends = edges[live], np.append(edges[1:], len(raw))[live]
            low = _LOWER[raw]
            bars = np.flatnonzero(raw == 0x7C)
            for i in np.unique(np.searchsorted(starts, bars, "right") - 1) if len(bars) else ():
                low[starts[i] : ends[i]] = raw[starts[i] : ends[i]]  # special tokens are in lower case only
        codes, hashes = pd.factorize(span_hashes(low, starts, ends))
        first = np.zeros(len(hashes), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        if len(self.slot) > _KEPT:
            self._forget()
        hashes = hashes.tolist()
        slots = np.fromiter(map(self.slot.get, hashes, repeat(-1)), np.int64, len(hashes))
        new = np.flatnonzero(slots < 0)
        if len(new):
            data, a, b = low.tobytes(), starts[first[new]].tolist(), ends[first[new]].tolist()
            missing = [hashes[i] for i in new]
            self._learn(missing, [data[x:y].decode() for x, y in zip(a, b, strict=True)])
            slots[new] = np.fromiter(map(self.slot.__getitem__, missing), np.int64, len(missing))
        self.uses[slots] += 1
        per_text = np.searchsorted(starts, at)
        slots = np.insert(slots[codes], per_text[1:], 0)
        sizes = self.sizes[slots]
        total = np.cumsum(sizes)
        flat = np.arange(total[-1] if len(total) else 0) + np.repeat(self.starts[slots] - (total - sizes), sizes)
        return self.ids[flat], np.concatenate([[0], total])[per_text + np.arange(len(per_text))]


_encoders: dict[tuple[str, int], Encoder] = {}


def _encoder(path: str, end: int) -> Encoder:
    if (path, end) not in _encoders:
        _encoders[path, end] = Encoder(path, end)
    return _encoders[path, end]


def tokens(docs: DataFrame, path: str, end: int = 1) -> DataFrame:
    """doc_id, source, part, begin, n, ids of every row of docs (doc_id, text, source), as a written table.

    ids are little-endian unsigned 32-bit; part is the task that read the row and begin the number of ids of the same source
    before it in that task. A null text is empty: the end id alone."""

    def encode(batches):
        part, sent, encoder = TaskContext.get().partitionId(), {}, _encoder(path, end)
        for batch in batches:
            raw, at = text_bytes(batch["text"])
            sources = batch["source"].to_pylist()
            i = 0
            while i < len(sources):
                j = min(len(sources), max(i + 1, int(np.searchsorted(at, at[i] + _SLICE))))
                ids, cuts = encoder.encode(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                n, begin = np.diff(cuts), []
                for s, x in zip(sources[i:j], n.tolist(), strict=True):
                    begin.append(sent.get(s, 0))
                    sent[s] = begin[-1] + x
                data = pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((cuts * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), batch["source"].slice(i, j - i), pa.array([part] * (j - i), pa.int32()), pa.array(begin, pa.int64()), pa.array(n), data], names=["doc_id", "source", "part", "begin", "n", "ids"])
                i = j

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    return written(rows.mapInArrow(lambda batches: lean(encode(batches)), "doc_id bigint, source string, part int, begin bigint, n bigint, ids binary"), "packing-tokens")


class Schedule:
    """Which tokens of each queue a window holds. Sources with less than 1/256 of all tokens share queues."""

    def __init__(self, sources: Sequence[str | None], sizes: Sequence[int], length: int = 2048):
        self.length, self.total = length, int(sum(sizes))
        least = self.total / min(256, length // 2)
        queues, pool = [], []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], sources[i] is None, sources[i] or "")):
            pool.append(i)
            if sum(sizes[j] for j in pool) >= least:
                queues.append(pool)
                pool = []
        if pool:
            queues = [*queues[:-1], (queues[-1] if queues else []) + pool]
        self.place: dict[str | None, tuple[int, int]] = {}
        for q, members in enumerate(queues):
            before = 0
            for i in members:
                self.place[sources[i]] = (q, before)
                before += int(sizes[i])
        self.sizes = np.array([sum(int(sizes[i]) for i in m) for m in queues], np.int64)
        self.windows = -(-self.total // length)

    def sent(self, windows: np.ndarray) -> np.ndarray:
        """How many tokens each queue has sent before each window: the whole part of its due, one more for the largest deficits."""
        t = np.minimum(windows * self.length, self.total)
        due = self.sizes * (t / max(self.total, 1))[:, None]
        out = np.floor(due).astype(np.int64)
        left = t - out.sum(axis=1)
        rank = np.argsort(np.argsort(-(due - out), axis=1, kind="stable"), axis=1, kind="stable")
        out += rank < left[:, None]
        last = out.shape[1] - 1
        out -= (rank > last + left[:, None]) & (left[:, None] < 0)  # rounding gave one too many
        return out

    def pieces(self, queue: int, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """For runs [begin, begin + n) of a queue: run, start in it, length, sequence and offset of every piece."""
        scale = self.total / self.sizes[queue] / self.length
        lo = max(0, int(begin.min() * scale) - 2)
        hi = min(self.windows, int((begin + n).max() * scale) + 3)
        w = np.arange(lo, hi + 1)
        sent = self.sent(w)
        mine, ahead = sent[:, queue], (sent[1:, :queue] - sent[:-1, :queue]).sum(axis=1)
        first = np.searchsorted(mine, begin, "right") - 1
        last = np.searchsorted(mine, begin + n - 1, "right") - 1
        count = last - first + 1
        run = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count) + first[run]
        a, b = np.maximum(begin[run], mine[k]), np.minimum((begin + n)[run], mine[k + 1])
        some = b > a
        run, k, a, b = run[some], k[some], a[some], b[some]
        return self._short(run, a - begin[run], b - a, w[k], ahead[k] + a - mine[k])

    def _short(self, run, start, size, window, offset):
        """The last window, if it is short, as sequences of powers of two."""
        rest = self.total % self.length
        tail = np.flatnonzero(window == self.windows - 1) if rest else ()
        if not len(tail):
            return run, start, size, window, offset
        powers = [1 << i for i in reversed(range(rest.bit_length())) if rest >> i & 1]
        cuts = np.concatenate([[0], np.cumsum(powers)])
        more = []
        for i in tail:
            a, b = int(offset[i]), int(offset[i] + size[i])
            for j in range(len(powers)):
                x, y = max(a, int(cuts[j])), min(b, int(cuts[j + 1]))
                if x < y:
                    more.append((run[i], start[i] + x - a, y - x, window[i] + j, x - int(cuts[j])))
        keep = np.ones(len(run), bool)
        keep[tail] = False
        return tuple(np.concatenate([old[keep], np.array(new, np.int64)]) for old, new in zip((run, start, size, window, offset), zip(*more, strict=True), strict=True))


def pack(docs: DataFrame, path: str, length: int = 2048, end: int = 1, max_sources: int = 100_000) -> DataFrame:
    """doc_id, source, start, length, ids, doc_tokens, sequence_id, offset of every piece of every row of docs.

    docs has doc_id, text and source (null is a source of its own), other columns are not looked at; a null text is empty.
    ids are little-endian unsigned 32-bit. Rows that share a doc_id are packed one by one. No rows give no pieces.
    """
    small_batches(docs.sparkSession)
    table = tokens(docs, path, end)
    by_part = table.groupBy("source", "part").agg(F.sum("n").alias("n"))
    totals = by_part.groupBy("source").agg(F.sum("n").alias("n")).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    schedule = Schedule([r["source"] for r in totals], [r["n"] for r in totals], length)
    order = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select(F.col("source").alias("its_source"), F.col("part").alias("its_part"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    rows = table.join(before, F.col("source").eqNullSafe(F.col("its_source")) & (F.col("part") == F.col("its_part")))
    rows = rows.select("doc_id", "source", "ids", "n", (F.col("before") + F.col("begin")).alias("begin"))
    schema = T._parse_datatype_string("doc_id bigint, source string, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")

    def cut(batches):
        for batch in batches:
            raw, at = text_bytes(batch["ids"].cast(pa.large_binary()))
            at = at // 4
            data = np.frombuffer(raw.tobytes(), "<u4")
            n, begin = np.asarray(batch["n"]), np.asarray(batch["begin"])
            by: dict[str | None, list[int]] = {}
            for i, s in enumerate(batch["source"].to_pylist()):
                by.setdefault(s, []).append(i)
            for s, members in by.items():
                members = np.array(members)
                queue, base = schedule.place[s]
                run, start, size, sequence, offset = schedule.pieces(queue, begin[members] + base, n[members])
                row = members[run]
                total = np.cumsum(size)
                flat = np.arange(total[-1]) + np.repeat(at[row] + start - (total - size), size)
                ids = pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((np.concatenate([[0], total]) * 4).astype(np.int32)), pa.py_buffer(data[flat])])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(row)), pa.array([s] * len(row), pa.string()), pa.array(start), pa.array(size), ids, pa.array(n[row]), pa.array(sequence), pa.array(offset)], schema=None, names=schema.names)

    return rows.mapInArrow(lambda batches: lean(cut(batches)), schema)
