"""License scan: an exact set-similarity join of text blocks with license templates.

A block is any run of consecutive words that is a quarter longer than the template, wherever lines break. It joins the template
if it holds at least ``threshold`` of its distinct words and all of its key words, which tell licenses of like wording apart.
Words have a global order, rarest in the corpus first. A block can only meet the threshold if it holds one of the template's
rarest ``size - needed + 1`` words (prefix filter: texts without one are left), if the text has enough of the template's
words at all (length filter) and if enough of them stand from the block's first word on (positional filter). What
passes is counted exactly, for all blocks of a text in one sweep, so every block that meets the threshold is found. Places
where the words of a base phrase stand next to each other are counted besides.

Templates are the small side: a list, or a table of at most ``max_templates`` rows. Two narrow maps over the texts: word frequencies
of the whole corpus, then the join; only one number per template word reaches the driver.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplegrid.llm.common import lean, small_batches
from ripplegrid.llm.wordbytes import ALNUM, distinct, span_hashes, text_bytes, word_spans

#: Fixed by the contract: phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
class Template(NamedTuple):
    """Wording of a license, the label that it gives, and words that a block must hold."""

    text: str
    label: str
    keys: tuple[str, ...] = ()


TEMPLATES = (
    Template("this work is licensed under the gnu general public license version 3", "gpl-notice", ("gnu",)),
    Template("licensed under the apache license version 2 0", "apache-notice", ("apache",)),
    Template("released under the mit license", "mit-notice", ("mit",)),
    Template("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit-notice"),
    Template("licensed under cc by nc 4 0", "cc-notice", ("cc",)),
    Template("licensed under a creative commons attribution license", "cc-notice", ("creative", "commons")),
    Template("redistribution and use in source and binary forms with or without modification are permitted", "bsd-notice"),
    Template("subject to the terms of the mozilla public license version 2 0", "mpl-notice", ("mozilla",)),
)
_SLACK = 1.25
_FAR = 1 << 40  # more words than a text has
_SLICE = 1 << 20


def _hash(words: list[str]) -> np.ndarray:
    data = " ".join(words).encode()
    raw = np.frombuffer(data, np.uint8)
    return span_hashes(raw, *word_spans(raw, np.array([0, len(raw)]), ALNUM)[:2], lower=True)


def _words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


class Lexicon:
    """The words of phrases and templates by hash, and the numbers of the words in each of them."""

    def __init__(self, phrases: dict[str, str], templates: Sequence[Template]):
        self.phrases, self.templates = dict(phrases), [t for t in templates if _words(t.text)]
        words = sorted({w for text in [*phrases, *(" ".join([t.text, *t.keys]) for t in self.templates)] for w in _words(text)})
        h = _hash(words)
        order = np.argsort(h)
        self.hashes, self.words = h[order], [words[i] for i in order]
        number = {w: i for i, w in enumerate(self.words)}
        self.sequences = [[number[w] for w in p.split()] for p in phrases]
        self.sets = [sorted({number[w] for w in _words(t.text)}) for t in self.templates]
        self.keys = [sorted({number[w] for k in t.keys for w in _words(k)}) for t in self.templates]
        self.widths = [int(np.ceil(_SLACK * len(_words(t.text)))) for t in self.templates]

    def numbers(self, raw, starts, ends) -> np.ndarray:
        """The number of every word, -1 for words in no phrase or template."""
        h = span_hashes(raw, starts, ends, lower=True)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)


def _slices(column):
    raw, at = text_bytes(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(at, at[i] + _SLICE))))
        part, cuts = raw[at[i] : at[j]], at[i : j + 1] - at[i]
        yield i, j, part, cuts, *word_spans(part, cuts, ALNUM)
        i = j


def word_counts(docs: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """How often each word of the lexicon stands in all texts."""

    def count(batches):
        total = np.zeros(len(lexicon.words), np.int64)
        for batch in batches:
            for _, _, part, _, starts, ends, _ in _slices(batch["text"]):
                number = lexicon.numbers(part, starts, ends)
                total += np.bincount(number[number >= 0], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["word", "n"])

    out = np.zeros(len(lexicon.words), np.int64)
    for r in docs.select("text").mapInArrow(count, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r["word"]] = r["n"]
    return out


def _in_blocks(starts: np.ndarray, at: np.ndarray, word: np.ndarray, width: int) -> np.ndarray:
    """How many distinct words each block [start, start + width) holds; at: the ascending places of words, which are _FAR apart
    between texts. A word counts in a block for its first place there, so each place counts for a run of starts."""
    order = np.lexsort((at, word))
    last = np.full(len(at), -_FAR)
    same = np.flatnonzero(word[order][1:] == word[order][:-1]) + 1
    last[order[same]] = at[order[same - 1]]
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, np.searchsorted(starts, np.maximum(last, at - width) + 1), 1)
    np.add.at(change, np.searchsorted(starts, at, "right"), -1)
    return np.cumsum(change[:-1])


def join_blocks(row: np.ndarray, place: np.ndarray, number: np.ndarray, lexicon: Lexicon, rank: np.ndarray, threshold: float) -> list[tuple[int, int, int, float]]:
    """(text, template, word, share) of every text and template with a block that meets the threshold: the first of its fullest
    blocks. Of each word of the lexicon in the texts: text (ascending), place in it (ascending), number; rank: global order."""
    out, size = [], len(rank)
    for t, (words, keys, width) in enumerate(zip(lexicon.sets, lexicon.keys, lexicon.widths, strict=True)):
        mine = np.array(words)[np.argsort(rank[words])]
        need = int(np.ceil(threshold * len(mine) - 1e-9))
        of_set, of_prefix = np.zeros(size, bool), np.zeros(size, bool)
        of_set[mine], of_prefix[mine[: len(mine) - need + 1]] = True, True
        texts = int(row[-1]) + 1 if len(row) else 0
        held = of_set[number]
        open_ = (np.bincount(row, of_prefix[number], minlength=texts) > 0) & (np.bincount(row, held, minlength=texts) >= need)
        hit = np.flatnonzero(held & open_[row]) if texts else np.zeros(0, np.int64)
        if not len(hit):
            continue
        at, word = row[hit] * _FAR + place[hit], number[hit]
        starts = at[np.searchsorted(at, at + width) - np.arange(len(at)) >= need]  # enough of them from here on
        count = _in_blocks(starts, at, word, width)
        ok = count >= need
        if keys:
            key = np.isin(number, keys) & open_[row]
            ok &= _in_blocks(starts, row[key] * _FAR + place[key], number[key], width) == len(keys)
        found, best = starts[ok], count[ok]
        order = np.lexsort((found, -best, found // _FAR))
        first = order[np.concatenate([[True], np.diff(found[order] // _FAR) != 0])] if len(order) else order
        out += [(int(s // _FAR), t, int(s % _FAR), float(n / len(mine))) for s, n in zip(found[first], best[first], strict=True)]
    return out


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: Sequence[Template] | DataFrame | None = None, threshold: float = 0.8, max_templates: int = 10_000) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and matches of every row of docs.

    docs has doc_id and text, other columns are not looked at; a null text is empty; rows that repeat an id, or have none, are
    scanned one by one. first_word and last_word are null where no base phrase stands. score is 1 for a base phrase, else the
    largest share of a template that a block holds if it meets the threshold, else 0. matches lists word (the block's first,
    from 0), label and share of each template that is met. templates may be a table (text, label, keys array<string>).
    """
    small_batches(docs.sparkSession)
    if isinstance(templates, DataFrame):
        rows = templates.select("text", "label", "keys").limit(max_templates + 1).collect()
        if len(rows) > max_templates:
            raise ValueError(f"more than {max_templates} templates")
        templates = [Template(r["text"] or "", r["label"], tuple(r["keys"] or ())) for r in rows]
    lexicon = Lexicon(PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = word_counts(docs, lexicon)
    rank = np.empty(len(counts), int)
    rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
    labels = list(lexicon.phrases.values())
    added = [t.label for t in lexicon.templates]

    def of_batch(batch):
        n = batch.num_rows
        n_words, n_base = np.zeros(n, np.int64), np.zeros(n, np.int64)
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        base: list[set] = [set() for _ in range(n)]
        matches: list[list] = [[] for _ in range(n)]
        for a, b, part, cuts, starts, ends, first in _slices(batch["text"]):
            number = lexicon.numbers(part, starts, ends)
            n_words[a:b] = np.diff(first)
            row = np.repeat(np.arange(b - a), np.diff(first))
            for sequence, label in zip(lexicon.sequences, labels, strict=True):
                at = np.flatnonzero(number == sequence[0])
                at = at[at + len(sequence) <= len(number)]
                at = at[row[at] == row[at + len(sequence) - 1]]
                for j, word in enumerate(sequence[1:], 1):
                    at = at[number[at + j] == word]
                of = row[at]
                n_base[a:b] += np.bincount(of, minlength=b - a)
                np.minimum.at(low, of + a, at - first[of])
                np.maximum.at(high, of + a, at - first[of])
                for i in distinct(of):
                    base[a + i].add(label)
            known = np.flatnonzero(number >= 0)
            for i, t, word, share in join_blocks(row[known], known - first[row[known]], number[known], lexicon, rank, threshold):
                matches[a + i].append((word, added[t], share))
        some = n_base > 0
        score = np.array([1.0 if s else max((m[2] for m in found), default=0.0) for s, found in zip(some, matches, strict=True)])
        names = lambda sets: pa.array([",".join(sorted(x)) for x in sets], pa.string())
        return pa.RecordBatch.from_arrays([
            batch["doc_id"], pa.array(n_words), pa.array(n_base), pa.array(low, mask=~some), pa.array(high, mask=~some), names(base),
            names([b | {m[1] for m in found} for b, found in zip(base, matches, strict=True)]), pa.array(score),
            pa.array([[{"word": x, "label": y, "share": z} for x, y, z in sorted(found)] for found in matches], pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string()), ("share", pa.float64())]))),
        ], names=[f.name for f in schema.fields])

    schema = T._parse_datatype_string("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, matches array<struct<word:bigint,label:string,share:double>>")
    return docs.mapInArrow(lambda batches: lean(map(of_batch, batches)), schema)
