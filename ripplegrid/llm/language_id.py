"""Language identification by error-correcting output codes.

Every language has a codeword; one binary classifier per bit (logistic regression on hashed byte trigrams,
trained in numpy) predicts that bit of a text's language. Decoding sums, over the bits, the logistic loss
of each codeword, weighted by how well the bit's classifier does, and takes the codeword with the least;
a small lead over the second flags the text as ambiguous.

The classifiers are fitted on a bounded sample of labelled rows, ``per_language`` of each language at most
on average, chosen by a hash of the id. Scoring is a narrow map: no shuffle, no state that grows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplegrid.llm.common import held_out, lean, small_batches
from ripplegrid.llm.wordbytes import text_bytes

UNDETERMINED = "und"
_BLOCK = 1 << 20
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[0x41:0x5B] += 0x20
_LOWER[0x09:0x0E] = 0x20


def trigram_counts(raw: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Counts of hashed byte trigrams: a row of ``width`` cells for every text."""
    n = len(at) - 1
    out = np.zeros(n * width, dtype=np.float32)
    shift = np.uint32(32 - int(np.log2(width)))
    for a in range(0, max(len(raw) - 2, 0), _BLOCK):
        b = min(a + _BLOCK + 2, len(raw))
        x = _LOWER[raw[a:b]]
        h = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1]) * np.uint32(0x85EBCA77) + x[2:]
        cell = ((h * np.uint32(0xC2B2AE3D)) ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> shift
        lo, hi = np.searchsorted(at, a, "right") - 1, np.searchsorted(at, b - 3, "right") - 1
        lengths = np.diff(np.clip(at[lo : hi + 2], a, b - 2))
        row = np.repeat(np.arange(hi - lo + 1), lengths)
        whole = at[lo + 1 : hi + 2][row] - np.arange(a, b - 2) >= 3  # inside one text
        out[lo * width : (hi + 1) * width] += np.bincount(row[whole] * width + cell[whole], minlength=(hi - lo + 1) * width)
    return out.reshape(n, width)


def _features(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts)
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-6)
    return x


def _slices(at: np.ndarray, most: int = 256, size: int = _BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of texts, of about ``size`` bytes and ``most`` texts at most."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, min(i + most, int(np.searchsorted(at, at[i] + size))))
        yield i, min(j, n)
        i = j


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n rows of +1 and -1: the exhaustive code for up to 5 languages, else the best of 64 random dense codes."""
    if n <= 1:
        return np.zeros((n, 0))
    if n <= 5:
        bits = np.arange(2 ** (n - 1) - 1)
        table = np.array([[1] * len(bits), *[(bits >> j) & 1 for j in range(n - 1)]])
        return np.where(table == 1, 1.0, -1.0)
    rng, best, apart = np.random.default_rng(seed), None, -1
    for _ in range(64):
        code = np.where(rng.random((n, int(np.ceil(10 * np.log2(n))))) < 0.5, 1.0, -1.0)
        code = code[:, np.abs(code.sum(axis=0)) < n]
        least = ((code[:, None, :] != code[None, :, :]).sum(axis=2) + len(code[0]) * np.eye(n)).min()
        if least > apart:
            best, apart = code, least
    return best


class Model:
    """Languages, their codewords, and weights, biases and decoding weights of the bits."""

    def __init__(self, languages: Sequence[str], counts: np.ndarray, which: np.ndarray, width: int, steps: int = 150):
        self.languages, self.width = list(languages), width
        self.code = codewords(len(languages))
        x, y = _features(counts), self.code[which]
        share = 1 / np.maximum(np.bincount(which, minlength=len(languages)), 1)
        weight = (share[which] / share[which].sum())[:, None].astype(np.float32) if len(which) else np.zeros((0, 1), np.float32)
        w, b = np.zeros((width, y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
        at_w, at_b, rate = w, b, 16.0
        for step in range(steps):  # Nesterov's accelerated gradient
            f = np.clip(y * (x @ at_w + at_b), -30, 30)
            g = (-y * weight / (1 + np.exp(f))).astype(np.float32)
            new_w, new_b = at_w - rate * (x.T @ g + 1e-5 * at_w), at_b - rate * 0.1 * g.sum(axis=0)
            push = step / (step + 3)
            at_w, at_b = new_w + push * (new_w - w), new_b + push * (new_b - b)
            w, b = new_w, new_b
        self.w, self.b = w, b
        right = ((y * (x @ w + b)) > 0).mean(axis=0) if len(x) else np.zeros(y.shape[1])
        self.of_bit = np.maximum(right - 0.5, 1e-3) / np.maximum(np.maximum(right - 0.5, 1e-3).sum(), 1e-9) if y.shape[1] else np.zeros(0)

    def decode(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The language's number, its share of the belief, and its lead over the second, for every row."""
        if len(self.languages) == 1:
            return np.zeros(len(counts), int), np.ones(len(counts)), np.ones(len(counts))
        f = _features(counts) @ self.w + self.b
        loss = np.logaddexp(0, -f[:, None, :] * self.code[None, :, :]) @ self.of_bit
        belief = np.exp(-len(self.code[0]) * (loss - loss.min(axis=1, keepdims=True)))
        belief /= belief.sum(axis=1, keepdims=True)
        first = np.argmin(loss, axis=1)
        two = np.sort(belief, axis=1)[:, -2:]
        return first, two[:, 1], two[:, 1] - two[:, 0]


def fit(docs: DataFrame, per_language: int = 1200, width: int = 2048, max_languages: int = 256) -> Model | None:
    """A model learned from text and lang of the rows outside the held-out fold; None if no such row has a letter."""
    small_batches(docs.sparkSession)
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    seen = labelled.groupBy("lang").count().limit(max_languages + 1).collect()
    if len(seen) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not seen:
        return None
    rates = F.create_map(*[F.lit(v) for r in seen for v in (r["lang"], min(1.0, per_language / r["count"]))])
    sample = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) <= rates[F.col("lang")] * float(1 << 30)).select("lang", "text")

    def count(batches):
        for batch in batches:
            raw, at = text_bytes(batch["text"])
            for i, j in _slices(at):
                c = np.minimum(trigram_counts(raw[at[i] : at[j]], at[i : j + 1] - at[i], width), 65535).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([batch["lang"].slice(i, j - i), pa.array([r.tobytes() for r in c], pa.binary())], ["lang", "counts"])

    rows = sample.mapInArrow(lambda batches: lean(count(batches)), "lang string, counts binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["counts"]))
    languages = sorted({r["lang"] for r in rows})
    counts = np.frombuffer(b"".join(r["counts"] for r in rows), np.uint16).reshape(-1, width).astype(np.float32)
    return Model(languages, counts, np.array([languages.index(r["lang"]) for r in rows], dtype=int), width) if rows else None


def identify(docs: DataFrame, model: Model | None, lead: float = 0.1, carry: Sequence[str] | None = None) -> DataFrame:
    """docs (the columns in carry, all by default) with lang_pred, score (0 to 1) and ambiguous; these replace columns of the same name.

    Null texts and texts without a letter are ``und`` with score 0, and so are all texts if nothing could be learned.
    ambiguous: the best codeword leads the second by less than ``lead``.
    """
    made = ("lang_pred", "score", "ambiguous")
    carried = [c for c in (docs.columns if carry is None else carry) if c not in made]
    schema = T.StructType([*docs.select(*carried).schema.fields, *T._parse_datatype_string("lang_pred string, score double, ambiguous boolean").fields])
    flagged = docs.select(*carried, F.col("text").cast("string").alias("__text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__letter"))

    def decode(batches):
        for batch in batches:
            raw, at = text_bytes(batch["__text"])
            letter = np.asarray(batch["__letter"].to_numpy(zero_copy_only=False), dtype=bool)
            n = len(letter)
            which, score, apart = np.zeros(n, int), np.zeros(n), np.zeros(n)
            if model is not None:
                for i, j in _slices(at):
                    which[i:j], score[i:j], apart[i:j] = model.decode(trigram_counts(raw[at[i] : at[j]], at[i : j + 1] - at[i], model.width))
            else:
                letter[:] = False
            names = np.array([*(model.languages if model else []), UNDETERMINED], dtype=object)
            names = names[np.where(letter, which, len(names) - 1)]
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in carried], pa.array(names, pa.string()), pa.array(np.where(letter, score, 0.0)), pa.array(~letter | (apart < lead))],
                schema=None, names=[*carried, *made],
            )

    return flagged.mapInArrow(lambda batches: lean(decode(batches)), schema)
