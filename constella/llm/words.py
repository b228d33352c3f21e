"""Vectorised word and shingle hashing over Arrow string columns (numpy, no per-word Python objects).

A word is a run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased; a shingle is ``k`` consecutive words.
Hashes are 64 bits wide and equal in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_MIX = _RNG.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWERED = _BYTE[_LOWER]
_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser that spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        m = max(n, 2 * len(_powers[0]), SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            _powers = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m, b, dtype=np.uint64))]) for b in (_BASE, _INV))
    return _powers


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds about ``most`` bytes of text, or a single longer one."""
    text = batch.column(column)
    if len(text) == 0:
        return
    sizes = np.diff(np.frombuffer(text.buffers()[1], dtype=np.int64 if pa.types.is_large_string(text.type) else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64))
    at, total = 0, 0
    for i, s in enumerate(sizes):
        if total and total + s > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += int(s)
    yield batch.slice(at)


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and the offsets of the texts in them; a null counts as empty."""
    if text.null_count:
        text = text.fill_null("")
    width = np.int64 if pa.types.is_large_string(text.type) else np.int32
    offsets = np.frombuffer(text.buffers()[1], dtype=width)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = text.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in the bytes, and for each text the index of its first word (and one past the last)."""
    word = ~_SPACE[raw]
    first, last = word.copy(), word.copy()
    if len(raw):
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(raw))]
        first[cut] = word[cut]
        last[cut - 1] = word[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of all texts in order, and for each text the index of its first word (and one past the last)."""
    raw, offsets = text_bytes(text)
    starts, ends, of = word_spans(raw, offsets)
    forth, back = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_LOWERED[raw] * forth[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64)), of


def shingle_hashes(words: np.ndarray, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each run of ``k`` words inside one text, and the index of each text's first (and one past the last).

    A text with 1 to ``k - 1`` words has one shingle, of all its words; one without words has none.
    """
    n = len(words)
    counts = np.diff(of)
    if n >= k:
        h = np.zeros(n - k + 1, dtype=np.uint64)
        for j in range(k):
            h += words[j : n - k + 1 + j] * _MIX[j]
        h = mix(h)
        keep = np.zeros(n + 1, dtype=np.int32)  # a shingle may start where k words of the same text follow
        long = counts >= k
        np.add.at(keep, of[:-1][long], 1)
        np.add.at(keep, of[1:][long] - k + 1, -1)
        keep = np.cumsum(keep[: n - k + 1]) > 0
        h = h[keep]
    else:
        h, long = np.zeros(0, np.uint64), counts >= k
    sizes = np.where(long, counts - k + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(sizes)])
    if (short := np.flatnonzero(~long & (counts > 0))).size:
        out = np.zeros(at[-1], dtype=np.uint64)
        full = np.ones(at[-1], dtype=bool)
        full[at[short]] = False
        out[full] = h
        for i in short:
            w = words[of[i] : of[i + 1]]
            with np.errstate(over="ignore"):
                out[at[i]] = mix(np.array([(w * _MIX[8 : 8 + len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))], dtype=np.uint64))[0]
        h = out
    return h, at


def shingle_sets(text: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, at = shingle_hashes(*word_hashes(text), k)
    return [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
