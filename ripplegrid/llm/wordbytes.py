"""Vectorised word access to Arrow string columns: byte classes, word spans and word hashes.

Everything works on the UTF-8 bytes of a whole Arrow column with numpy, so a task touches Python
objects per document at most, never per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: ASCII white space: 0x20 and 0x09 to 0x0D; every other byte belongs to a word ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Digits, ASCII letters and all bytes of non-ASCII code points: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z is lower-cased.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: As ALNUM without digits.
LETTERS = ALNUM.copy()
LETTERS[0x30:0x3A] = False

_SEED = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[0x41:0x5B] = _BYTE[0x61:0x7B]
_BASE = 0x9E3779B97F4A7C13  # odd, 3 modulo 8
_BLOCK = 1 << 20
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        n = max(n, _BLOCK + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            out = np.full(n, np.uint64(base), dtype=np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text begins and ends; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_spans(raw: np.ndarray, at: np.ndarray, table: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word, and the number of words before each text (one more than texts)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = table[raw]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    edges = at[(at > 0) & (at < len(raw))]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of every span; spans are in order of their first byte."""
    out = np.empty(len(starts), dtype=np.uint64)
    values = _BYTE_LOWER if lower else _BYTE
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + _BLOCK)))
        lo, hi = int(starts[i]), int(ends[i:j].max())
        up, down = _power(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(values[raw[lo:hi]] * up[: hi - lo], out=sums[1:])
        out[i:j] = (sums[ends[i:j] - lo] - sums[starts[i:j] - lo]) * down[starts[i:j] - lo]
        i = j
    return mix(out)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive values (len(h) - k + 1 of them); windows may span texts, callers mask those."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= np.uint64(_BASE)
        out += h[j : j + n]
    return mix(out)


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, ascending."""
    out = np.sort(values)
    return out[np.concatenate([[True], out[1:] != out[:-1]])] if len(out) else out
