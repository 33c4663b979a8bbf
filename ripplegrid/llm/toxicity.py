"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index.

Terms are the lower-cased words of the examples (``max_examples`` labelled rows at most), by 64-bit hash; none is left out. A
term weighs (1 + log count) * idf, with document frequencies of all documents, times a factor that grows with how far it tells
the labels of the examples apart (the root of its chi-square, with a floor), so that insults count for more than topics. The
examples lie in an inverted index whose postings are cut into blocks of examples with the largest weight of each term in each
block; the terms of many examples have all their weights in a matrix, block by block. A text first visits the blocks of the
highest bounds; then only those whose bound reaches its k-th best cosine, so the neighbours are the exact ones. Their labels, weighted by closeness, vote; a logistic curve, fitted on the votes that the
examples themselves get without their own text, makes the vote a probability. The neighbours are the evidence.

Only the bounded examples and their terms' frequencies reach the driver; documents are read twice, in narrow maps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegrid.llm.common import held_out, lean, scratch, small_batches, written
from ripplegrid.llm.wordbytes import LETTERS, span_hashes, text_bytes, word_spans

_SLICE = 1 << 18
_ROWS = 1024  # texts of a slice, at most
_COMMON = 512  # terms whose weights lie in a matrix, at most: those that one in _SHARE examples has
_SHARE = 16
_FIRST = 2  # blocks that a text visits before its bound is known
_TINY = 1e-9


def _ranges(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs [start, start + size): which run each place is of, and the places."""
    run = np.repeat(np.arange(len(size)), size)
    return run, np.arange(len(run)) + np.repeat(start - (np.cumsum(size) - size), size)


def _slices(column, terms: np.ndarray | None):
    """For slices of the texts: first row, last row, and row, term and count of each distinct term of each text. Terms are
    numbers in the ascending hashes ``terms`` (others are passed over), or the hashes themselves."""
    raw, at = text_bytes(pc.utf8_lower(column))
    i, n = 0, len(at) - 1
    while i < n:
        j = min(n, i + _ROWS, max(i + 1, int(np.searchsorted(at, at[i] + _SLICE))))
        part, cuts = raw[at[i] : at[j]], at[i : j + 1] - at[i]
        starts, ends, first = word_spans(part, cuts, LETTERS)
        row, h = np.repeat(np.arange(j - i), np.diff(first)), span_hashes(part, starts, ends)
        if terms is not None:
            number = np.minimum(np.searchsorted(terms, h), max(len(terms) - 1, 0))
            known = terms[number] == h if len(terms) else np.zeros(len(h), bool)
            row, h = row[known], number[known]
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        edge = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.zeros(0, np.int64)
        yield i, j, row[edge], h[edge], np.diff(np.append(edge, len(h)))
        i = j


class Index:
    """Examples as unit vectors in postings by term, cut into blocks of ``block`` examples."""

    def __init__(self, ids, keys, labels, rows, terms, counts, weights, block: int = 64):
        self.weights, self.block = weights, block
        weight, n = (1 + np.log(counts)) * weights[terms], len(ids)
        norm = np.sqrt(np.bincount(rows, weight * weight, minlength=n))
        strongest = np.full(n, -1)
        by = np.argsort(weight, kind="stable")
        strongest[rows[by]] = terms[by]  # the last assignment stays, which is the heaviest term
        order = np.lexsort((ids, strongest))  # neighbours share blocks, so bounds are tight
        place = np.empty(n, int)
        place[order] = np.arange(n)
        self.ids, self.keys, self.labels = ids[order], keys[order], labels[order]
        rows, unit = place[rows], weight / np.maximum(norm[rows], _TINY)
        by = np.lexsort((rows, terms))
        self.rows, self.unit, terms = rows[by].astype(np.int32), unit[by], terms[by]
        self.blocks = max(1, -(-n // block))
        cell = terms * self.blocks + self.rows // block
        self.lo = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        self.size = np.diff(np.append(self.lo, len(cell)))
        self.most = np.maximum.reduceat(self.unit, self.lo) if len(cell) else np.zeros(0)
        self.in_block = (cell[self.lo] % self.blocks).astype(np.int64)
        self.cells = np.searchsorted(cell[self.lo] // self.blocks, np.arange(len(weights) + 1))
        self.held = np.diff(np.searchsorted(terms, np.arange(len(weights) + 1)))  # examples of each term
        self.matrix: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self.prior = (labels.sum() + 1) / (n + 2) if n else 0.0
        self.curve: tuple[float, float] | None = None

    def common(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each common term stands in the matrix (-1: it has postings alone), its largest weight in each block, and its
        weight in each example. Made where it is used first, so that it is not sent."""
        if self.matrix is None:
            most = np.argsort(-self.held, kind="stable")[:_COMMON]
            most = most[self.held[most] * _SHARE > len(self.ids)]
            slot = np.full(len(self.weights), -1)
            slot[most] = np.arange(len(most))
            weight = np.zeros((len(most), self.blocks * self.block))
            first = np.cumsum(self.held) - self.held
            of, at = _ranges(first[most], self.held[most])
            weight[of, self.rows[at]] = self.unit[at]
            self.matrix = slot, weight.reshape(len(most), self.blocks, self.block).max(axis=2), weight
        return self.matrix

    def nearest(self, row: np.ndarray, terms: np.ndarray, counts: np.ndarray, n: int, k: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, place and cosine of the k nearest examples (and of all as near as the k-th) of n texts, nearest first; those
        with a cosine of 0 and those of an equal text (by key) are none. Terms are grouped by text."""
        q = (1 + np.log(counts)) * self.weights[terms]
        q = q / np.maximum(np.sqrt(np.bincount(row, q * q, minlength=n)), _TINY)[row]
        slot, most, weight = self.common()
        dense = np.zeros((n, len(most)))
        of, rare = slot[terms], slot[terms] < 0
        dense[row[~rare], of[~rare]] = q[~rare]
        row, terms, q = row[rare], terms[rare], q[rare]
        entry, cell = _ranges(self.cells[terms], self.cells[terms + 1] - self.cells[terms])
        of = row[entry] * self.blocks + self.in_block[cell]
        bound = np.bincount(of, q[entry] * self.most[cell], minlength=n * self.blocks).reshape(n, self.blocks)
        bound = bound + dense @ most
        score = np.zeros((n, self.blocks * self.block))
        visit = np.zeros((n, self.blocks), bool)
        first = np.argpartition(-bound, min(_FIRST, self.blocks) - 1, axis=1)[:, :_FIRST]
        np.put_along_axis(visit, first, True, axis=1)
        own = np.zeros((n, 0), bool)
        for again in (False, True):
            if again:
                seen = np.where(own, 0.0, score[:, : len(self.ids)])
                kth = np.partition(seen, -k, axis=1)[:, -k] if seen.shape[1] >= k else np.zeros(n)
                visit = (bound >= kth[:, None] - _TINY) & ~visit
            mine = np.flatnonzero(visit.reshape(-1)[of] & (bound.reshape(-1)[of] > 0))
            pick, at = _ranges(self.lo[cell[mine]], self.size[cell[mine]])
            e = entry[mine][pick]
            np.add(score.reshape(-1), np.bincount(row[e] * score.shape[1] + self.rows[at], q[e] * self.unit[at], minlength=score.size), out=score.reshape(-1))
            for b in np.flatnonzero(visit.any(axis=0)).tolist() if len(most) else ():
                some, part = np.flatnonzero(visit[:, b]), slice(b * self.block, (b + 1) * self.block)
                score[some, part] += dense[some] @ weight[:, part]
            own = keys[:, None] == self.keys[None, :] if not again else own
        score = np.where(own, 0.0, score[:, : len(self.ids)])
        kth = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k else np.zeros(n)
        text, place = np.nonzero((score > _TINY) & (score >= kth[:, None] - _TINY))
        cosine = score[text, place]
        order = np.lexsort((place, -cosine, text))
        return text[order], place[order], cosine[order]

    def votes(self, column, keys: np.ndarray, terms: np.ndarray, k: int):
        """The vote of every text (the prior where it has no neighbour), and ids and cosines of its first five neighbours."""
        out, near = np.full(len(keys), self.prior), [[] for _ in range(len(keys))]
        for i, j, row, term, count in _slices(column, terms):
            text, place, cosine = self.nearest(row, term, count, j - i, k, keys[i:j])
            vote = 1 / (0.05 + np.maximum(0.0, 1 - cosine))
            total, toxic = np.bincount(text, vote, minlength=j - i), np.bincount(text, vote * self.labels[place], minlength=j - i)
            out[i:j] = (toxic + self.prior) / (total + 1)
            cuts = np.searchsorted(text, np.arange(j - i + 1))
            for d, (a, b) in enumerate(zip(cuts[:-1], np.minimum(cuts[1:], cuts[:-1] + 5), strict=True)):
                near[i + d] = [{"doc_id": x, "cosine": y} for x, y in zip(self.ids[place[a:b]].tolist(), cosine[a:b].tolist(), strict=True)]
        return out, near

    def calibrated(self, vote: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return vote
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * _logit(vote), -50, 50)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float] | None:
    """Intercept and slope (0 at least) of the logistic curve of y over x, by Newton's method with a small ridge; None if
    one label is all there is."""
    if not 0 < y.sum() < len(y):
        return None
    z, w = np.stack([np.ones(len(x)), x], axis=1), np.array([0.0, 1.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (y - p) - 1e-3 * (w - [0.0, 1.0]))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), max(0.0, float(w[1]))


def _counts(frame: DataFrame, terms: np.ndarray) -> np.ndarray:
    """In how many texts each term stands."""

    def count(batches):
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for _, _, _, term, _ in _slices(batch["text"], terms):
                total += np.bincount(term, minlength=len(terms))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "n"])

    out = np.zeros(len(terms), np.int64)
    found = frame.select("text").mapInArrow(lambda batches: lean(count(batches)), "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # the terms of the examples, at most
    out[found["term"].to_numpy()] = found["n"].to_numpy()
    return out


def fit(docs: DataFrame, labels: DataFrame, max_examples: int, k: int) -> tuple[Index, np.ndarray]:
    """The index of the examples with its curve, and the hashes of their terms."""
    sample = (
        labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    )
    with scratch(docs.sparkSession):
        one = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))  # max_examples ids bound the broadcast
        examples = written(one.withColumn("key", F.xxhash64("text")), "toxicity-examples")

        def spell(batches):
            for batch in batches:
                for i, j, row, term, count in _slices(batch["text"], None):
                    cuts = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*[batch[c].slice(i, j - i) for c in ("doc_id", "key", "y")], pa.ListArray.from_arrays(cuts, pa.array(term.view(np.int64))), pa.ListArray.from_arrays(cuts, pa.array(count.astype(np.int32)))], names=["doc_id", "key", "y", "terms", "counts"])

        rows = examples.mapInArrow(spell, "doc_id bigint, key bigint, y int, terms array<bigint>, counts array<int>").toArrow().sort_by("doc_id").combine_chunks()  # max_examples rows at most
        if rows.num_rows:
            lists = rows["terms"].chunk(0) if isinstance(rows["terms"], pa.ChunkedArray) else rows["terms"]
            size = np.diff(np.asarray(lists.offsets))
            terms, number = np.unique(np.asarray(lists.flatten()).view(np.uint64), return_inverse=True)
            counts = np.asarray(rows["counts"].combine_chunks().flatten(), dtype=float)
        else:
            size, terms, number, counts = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)
        y, of = np.asarray(rows["y"], dtype=float), np.repeat(np.arange(len(size)), size)
        n, n1, total, positive = np.bincount(number, minlength=len(terms)), np.bincount(number, y[of], minlength=len(terms)), float(len(y)), float(y.sum())
        gap = n1 * total - n * positive
        chi2 = gap * gap * total / np.maximum(n * (total - n) * max(positive, 1) * max(total - positive, 1), 1)
        idf = np.log(1 + docs.count() / np.maximum(_counts(docs, terms), 1))
        index = Index(np.asarray(rows["doc_id"]), np.asarray(rows["key"].fill_null(0)), y, of, number, counts, idf * (0.1 + np.sqrt(np.minimum(chi2, 400.0))))

        def own(batches):
            for batch in batches:
                vote, _ = index.votes(batch["text"], np.asarray(batch["key"].fill_null(0)), terms, k)
                yield pa.RecordBatch.from_arrays([pa.array(vote), batch["y"]], names=["vote", "y"])

        votes = examples.repartition(max(1, docs.sparkSession.sparkContext.defaultParallelism)).mapInArrow(lambda batches: lean(own(batches)), "vote double, y int").toArrow()
        votes = votes.sort_by([("vote", "ascending"), ("y", "ascending")])
        index.curve = logistic(_logit(np.asarray(votes["vote"])), np.asarray(votes["y"], dtype=float)) if votes.num_rows else None
    return index, terms


def score(docs: DataFrame, labels: DataFrame, max_examples: int = 3000, k: int = 15) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier), predicted, neighbours (array of ids and cosines, the evidence).

    docs has doc_id and text, labels has doc_id and toxic; other columns are not looked at. Rows of the held-out fold,
    null ids and null labels teach nothing; a document with several labels counts as toxic if one says so, and of several texts
    of a learned id the smallest is the example. Each row of docs is scored by its text alone, so rows that repeat an id or a text
    score one by one; an example with the very text is no neighbour, so that no label speaks for its own document; all examples
    as near as the k-th vote. Null and empty texts, and texts without a word of the examples, get the share of label 1 (calibrated);
    without labels all score 0.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index, terms = fit(docs, labels, max_examples, k)

    def vote(batches):
        for batch in batches:
            raw, near = index.votes(batch["text"], np.asarray(batch["key"].fill_null(0)), terms, k)
            value = index.calibrated(raw)
            near = pa.array(near, pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())])))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(value), pa.array((value >= 0.5).astype(np.int32)), near], names=["doc_id", "score", "predicted", "neighbours"])

    keyed = docs.withColumn("key", F.xxhash64("text"))
    return keyed.mapInArrow(lambda batches: lean(vote(batches)), "doc_id bigint, score double, predicted int, neighbours array<struct<doc_id:bigint,cosine:double>>")
