"""Elias-Fano coded monotone sequences in numpy, kept as files that processes map instead of reading."""

from __future__ import annotations

import json
import mmap
import os
import sys
import uuid

import numpy as np

_U = np.uint64


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Values of ``width`` bits each, end to end in 64-bit words, and one word more."""
    n = len(values)
    out = np.zeros((n * width + 63) // 64 + 1, dtype=_U)
    if not n or not width:
        return out
    at = np.arange(n, dtype=np.int64) * width
    word, shift = at >> 6, (at & 63).astype(_U)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
    over = np.flatnonzero((at & 63) + width > 64)
    out[word[over] + 1] |= values[over] >> (_U(64) - shift[over])
    return out


def _unpack(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(at), dtype=_U)
    bit = at * width
    word, shift = bit >> 6, (bit & 63).astype(_U)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
    return (low | high) & _U((1 << width) - 1)


def _select(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Position, in each 64-bit word, of the set bit that ``rank`` set bits precede."""
    x, r, at = words.copy(), rank.astype(np.int64), np.zeros(len(words), dtype=np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        c = np.bitwise_count(x & _U((1 << step) - 1)).astype(np.int64)
        go = r >= c
        r -= np.where(go, c, 0)
        at += np.where(go, step, 0)
        x = np.where(go, x >> _U(step), x)
    return at


class EliasFano:
    """A sorted sequence below ``universe``: low bits packed, high bits as unary gaps, zeros counted before each word."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.width, self.low, self.high, self.zeros = n, width, low, high, zeros
        self._ones: np.ndarray | None = None

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        width = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        values = values.astype(_U)
        top = (values >> _U(width)).astype(np.int64)
        bits = np.zeros((n + (universe >> width) + 2 + 63) // 64 * 64, dtype=np.uint8)
        bits[top + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(_U)
        counts = 64 - np.bitwise_count(high).astype(np.int64)
        return cls(n, width, _pack(values & _U((1 << width) - 1), width), high, np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64 if n > 2**30 else np.int32))

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Position of the zero that ``k`` zeros precede."""
        w = np.searchsorted(self.zeros, k.astype(self.zeros.dtype), side="right") - 1
        return (w << 6) + _select(~self.high[w], k - self.zeros[w])

    def at(self, i: np.ndarray) -> np.ndarray:
        if self._ones is None:
            self._ones = (np.arange(len(self.zeros), dtype=np.int64) << 6) - self.zeros
        w = np.searchsorted(self._ones, i, side="right") - 1
        top = (w << 6) + _select(self.high[w], i - self._ones[w]) - i
        return (top.astype(_U) << _U(self.width)) | _unpack(self.low, i, self.width)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, or -1; values lie below the universe."""
        if not self.n or not len(values):
            return np.full(len(values), -1, dtype=np.int64)
        values = values.astype(_U)
        top, rest = (values >> _U(self.width)).astype(np.int64), values & _U((1 << self.width) - 1)
        end = self._zero(top) - top
        begin = np.where(top > 0, self._zero(np.maximum(top - 1, 0)) + 1 - top, 0)
        lo, hi = begin.copy(), end.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            less = _unpack(self.low, mid, self.width) < rest[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        found = np.full(len(values), -1, dtype=np.int64)
        there = np.flatnonzero(lo < end)
        equal = _unpack(self.low, lo[there], self.width) == rest[there]
        found[there[equal]] = lo[there[equal]]
        return found

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.n": np.array([self.n, self.width]), f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.zeros": self.zeros}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, width = (int(x) for x in arrays[f"{name}.n"])
        return cls(n, width, arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.zeros"])


def write(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file for all arrays: the length of a description, the description, the arrays. It appears whole or not at all."""
    at, places = 0, {}
    for name, a in arrays.items():
        places[name] = [a.dtype.str, at, len(a)]
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(places).encode()
    head += b" " * (-(8 + len(head)) % 64)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head)
        for a in arrays.values():
            f.write(np.ascontiguousarray(a).tobytes() + bytes(-a.nbytes % 64))
    os.replace(part, path)  # a second try writes the same


def mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped; the map needs no open file and ends with the last array."""
    with open(path, "rb") as f:
        m = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **({"trackfd": False} if sys.version_info >= (3, 13) else {}))
    first = 8 + (size := int.from_bytes(m[:8], "little"))
    return {name: np.frombuffer(m, dtype, n, first + at) if n else np.zeros(0, dtype) for name, (dtype, at, n) in json.loads(m[8 : 8 + size]).items()}
