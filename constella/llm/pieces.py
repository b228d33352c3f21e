"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and lossless decoding.

The pieces come from a model file; a piece's weight falls with its rank there, ``(rank + 2) ** -theta``. The probability of a
segmentation is the product of its pieces' weights over the sum of all segmentations' products; the forward pass sums them
up to each position, and the backward pass draws pieces from the end.

A space is written as the mark of the piece model. No piece has the mark after another character, so the lattice of a text
parts into the units between. Both passes run over all units of a few texts, or of a part of a long one, at once, position by
position; a unit longer than a part holds its lattice for a window at a time, so memory grows with a text by its pieces alone. The number that
decides at a position depends on the seed, the row's key and the position in the text alone: the same row gives the same
pieces wherever it runs.

Characters outside the pieces, and the mark itself, become byte pieces, so that decoding gives back every text exactly.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import once
from .words import mix, slices

THETA, SEED, SHORT, PART, WINDOW = 0.5, 1, 64, 200_000, 20_000
_HEAD = re.compile("(?<! ) ")
_END = "\U0010ffff"  # parts the texts of a batch; in a text it is a character outside the pieces, like in any position
_CHAR_BITS, _TABLE_BITS = 13, 20
_BYTES = -2


class Pieces:
    """The vocabulary of a model file, ready for sampling."""

    def __init__(self, path: str, theta: float = THETA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.weight = np.zeros(n)
        self.bytes: list[bytes] = [b""] * n
        self.byte_ids = np.full(256, -1, dtype=np.int32)
        self.byte_weight = (n + 2.0) ** -theta
        ids: dict[str, int] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_control(i) or sp.is_unknown(i):
                continue
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.bytes[i] = i, bytes([value])
                continue
            text = piece.replace("\u2581", " ")
            if " " in text.lstrip(" "):
                raise ValueError(f"piece {i} has a mark after another character")
            ids[text], self.bytes[i] = i, text.encode()
            self.weight[i] = (min(n, max(0.0, -sp.get_score(i))) + 2.0) ** -theta
        if self.byte_ids.min() < 0:
            raise ValueError("the model has no byte pieces")
        self.longest = max(map(len, ids))
        chars = sorted({c for t in ids for c in t})
        self.char = np.zeros(0x110000, dtype=np.int64)
        self.char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self._trie(ids)

    def _trie(self, ids: dict[str, int]) -> None:
        """Prefixes as states; their transitions in an open hash table."""
        states, final, keys, to = {"": 0}, [-1], [], []
        for text in sorted(ids):
            for j in range(1, len(text) + 1):
                if text[:j] not in states:
                    states[text[:j]] = len(final)
                    keys.append(states[text[: j - 1]] << _CHAR_BITS | int(self.char[ord(text[j - 1])]))
                    to.append(len(final))
                    final.append(-1)
            final[states[text]] = ids[text]
        self.final = np.array(final, dtype=np.int64)
        keys, to = np.array(keys, dtype=np.int64), np.array(to, dtype=np.int64)
        if self.char.max() >= 1 << _CHAR_BITS or len(keys) * 2 > 1 << _TABLE_BITS:
            raise ValueError("the vocabulary is too large for the table")
        self.keys, self.to = np.full(1 << _TABLE_BITS, -1, dtype=np.int64), np.full(1 << _TABLE_BITS, -1, dtype=np.int64)
        left, self.probes = np.arange(len(keys)), 0
        while len(left):
            slot = self._slot(keys[left], self.probes)
            slot, first = np.unique(slot, return_index=True)
            free = self.keys[slot] < 0
            self.keys[slot[free]], self.to[slot[free]] = keys[left[first[free]]], to[left[first[free]]]
            left = np.delete(left, first[free])
            self.probes += 1

    @staticmethod
    def _slot(keys: np.ndarray, probe: int) -> np.ndarray:
        return (((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64) + probe) & ((1 << _TABLE_BITS) - 1)

    def _next(self, keys: np.ndarray) -> np.ndarray:
        """The state each transition leads to, or -1."""
        slot = self._slot(keys, 0)
        there = self.keys[slot]
        out = np.where(there == keys, self.to[slot], -1)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        for probe in range(1, self.probes):
            if not len(open_):
                break
            slot = self._slot(keys[open_], probe)
            there = self.keys[slot]
            hit = there == keys[open_]
            out[open_[hit]] = self.to[slot[hit]]
            open_ = open_[~hit & (there >= 0)]
        return out

    def _lattice(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By length and end position: the weight of the piece that ends there, or 0, and its id."""
        n, most = len(code), self.longest
        char = self.char[code]
        weight, ids = np.zeros((most + 1, n + 1)), np.full((most + 1, n + 1), -1, dtype=np.int32)
        at, state = np.arange(n), np.zeros(n, dtype=np.int64)
        for length in range(1, most + 1):
            inside = at + length <= n
            at, state = at[inside], state[inside]
            state = self._next(state << _CHAR_BITS | char[at + length - 1])
            at, state = at[state >= 0], state[state >= 0]
            if not len(at):
                break
            piece = self.final[state]
            real = piece >= 0
            weight[length, at[real] + length] = self.weight[piece[real]]
            ids[length, at[real] + length] = piece[real]
        alone = np.flatnonzero(ids[1, 1:] < 0)
        weight[1, alone + 1] = self.byte_weight ** _width(code[alone])
        ids[1, alone + 1] = _BYTES
        return weight, ids

    def encode(self, texts: list[str], keys: list[int], seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and the offsets of the texts in them. Long texts are cut at heads of units."""
        out, counts, held, size = [], np.zeros(len(texts), dtype=np.int64), [], 0

        def flush() -> None:
            ids, n = self._encode([texts[i][a:b] for i, a, b in held], [keys[i] for i, _, _ in held], seed, [a for _, a, _ in held])
            out.append(ids)
            np.add.at(counts, [i for i, _, _ in held], n)
            held.clear()

        for i, text in enumerate(texts):
            for a, b in _parts(text):
                if b - a > PART:  # one unit
                    if held:
                        flush()
                        size = 0
                    ids = self._unit(text[a:b], keys[i], seed, a)
                    out.append(ids)
                    counts[i] += len(ids)
                    continue
                if held and size + b - a > PART:
                    flush()
                    size = 0
                held.append((i, a, b))
                size += b - a + 1
        if held:
            flush()
        return np.concatenate([*out, np.zeros(0, np.int32)]), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    def _encode(self, texts: list[str], keys: list[int], seed: int, shifts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The same for parts of texts that begin at ``shifts``."""
        code = np.frombuffer((_END.join(texts) + _END).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64)
        n = len(code)
        inside = np.ones(n, dtype=bool)
        inside[begin + lengths] = False
        space = code == 32
        head = np.zeros(n + 1, dtype=bool)
        head[1:n] = space[1:] & ~space[:-1]
        head[begin] = True
        head[:n] &= inside
        start = np.flatnonzero(head[:n])
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        of_text = np.searchsorted(begin, start, side="right") - 1
        end = np.minimum(np.append(start[1:], n), (begin + lengths)[of_text])
        weight, ids = self._lattice(code)
        with np.errstate(over="ignore"):
            base = _base(keys, seed)
        zero = begin - np.array(shifts, dtype=np.int64)  # where each text would begin
        # forward: ways into each position, and out of it; at the head of a unit the latter is 1
        ways, go = np.zeros(n + 1), np.zeros(n + 1)
        go[start] = 1.0
        short = np.flatnonzero(end - start <= SHORT)
        sizes = (end - start)[short]
        order = np.argsort(-sizes, kind="stable")
        by_size, sizes = start[short][order], sizes[order]
        for t in range(1, int(sizes[0]) + 1 if len(sizes) else 1):
            e = by_size[: np.searchsorted(-sizes, -t, side="right")] + t
            total = go[e - 1] * weight[1, e]
            for length in range(2, min(t, self.longest) + 1):
                total += go[e - length] * weight[length, e]
            ways[e] = total
            within = ~head[e]
            go[e[within]] = total[within]
        # backward
        picked = np.full(n, -1, dtype=np.int32)
        fine = short[ways[end[short]] > 1e-250]
        e, low, text = end[fine], start[fine], of_text[fine]
        while len(e):
            u = _uniform(base[text], e - zero[text])
            rest, chosen, last = u * ways[e], np.zeros(len(e), dtype=np.int64), np.zeros(len(e), dtype=np.int64)
            open_ = np.arange(len(e))
            for length in range(1, self.longest + 1):
                open_ = open_[e[open_] - low[open_] >= length]
                if not len(open_):
                    break
                part = go[e[open_] - length] * weight[length, e[open_]]
                last[open_[part > 0]] = length
                rest[open_] -= part
                done = rest[open_] < 0
                chosen[open_[done]] = length
                open_ = open_[~done]
            chosen = np.where(chosen == 0, last, chosen)  # rounding at the upper end
            picked[e - chosen] = ids[chosen, e]
            e = e - chosen
            more = e > low
            e, low, text = e[more], low[more], text[more]
        rare = np.setdiff1d(np.arange(len(start)), fine, assume_unique=True)
        for i in rare:
            a, b = int(start[i]), int(end[i])
            self._long(picked[a:b], code[a:b], base[of_text[i]], a - int(zero[of_text[i]]))
        return self._spelled(picked, code, np.append(begin, n))

    def _spelled(self, picked: np.ndarray, code: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the picked pieces, characters outside them as bytes, and how many lie between the bounds."""
        at = np.flatnonzero(picked != -1)
        piece = picked[at]
        many = np.ones(len(at), dtype=np.int64)
        raw = piece == _BYTES
        many[raw] = _width(code[at[raw]])
        out = np.repeat(piece, many)
        out[np.repeat(raw, many)] = self.byte_ids[np.frombuffer("".join(map(chr, code[at[raw]])).encode(), dtype=np.uint8)]
        total = np.concatenate([[0], np.cumsum(many)])
        cut = total[np.searchsorted(at, bounds)]
        return out, np.diff(cut)

    def _unit(self, unit: str, key: int, seed: int, shift: int) -> np.ndarray:
        """The ids of one unit of any length."""
        code = np.frombuffer(unit.encode("utf-32-le"), dtype=np.uint32)
        picked = np.full(len(code), -1, dtype=np.int32)
        self._long(picked, code, _base([key], seed)[0], shift)
        return np.concatenate([self._spelled(picked[a : a + PART], code[a : a + PART].astype(np.int64), np.array([0, PART]))[0] for a in range(0, len(code), PART)])

    def _window(self, code: np.ndarray, a: int, b: int) -> tuple[list[list[float]], list[list[int]]]:
        """For each end position from ``a`` to ``b - 1`` the weights and ids of the pieces that end there, by length."""
        first = max(0, a - self.longest)
        weight, ids = self._lattice(code[first : b - 1].astype(np.int64))
        return weight[:, a - first :].T.tolist(), ids[:, a - first :].T.tolist()

    def _long(self, picked: np.ndarray, code: np.ndarray, base: np.uint64, shift: int) -> None:
        """Picks the pieces of one unit, in logarithms; the lattice is held for a window of positions at a time."""
        n = len(code)
        total = np.zeros(n + 1)
        recent = [0.0]  # the totals of the last positions
        for a in range(1, n + 1, WINDOW):
            b = min(a + WINDOW, n + 1)
            made = []
            for column in self._window(code, a, b)[0]:
                ways = [recent[-k] + math.log(w) for k, w in enumerate(column[: len(recent) + 1]) if w > 0]
                top = max(ways)
                recent.append(top + math.log(sum([math.exp(x - top) for x in ways])))
                made.append(recent[-1])
                if len(recent) > 4 * self.longest:
                    del recent[: -self.longest]
            total[a:b] = made
        j = n
        for a in range((n - 1) // WINDOW * WINDOW + 1, 0, -WINDOW):
            b = min(a + WINDOW, n + 1)
            weights, ids = self._window(code, a, b)
            draws = _uniform(np.full(b - a, base), np.arange(a, b) + shift).tolist()
            while j >= a:
                rest, chosen = draws[j - a], 0
                for k, w in enumerate(weights[j - a][: j + 1]):
                    if w > 0:
                        chosen = k
                        rest -= math.exp(total[j - k] + math.log(w) - total[j])
                        if rest < 0:
                            break
                picked[j - chosen] = ids[j - a][chosen]
                j -= chosen

    def forward(self, unit: str) -> tuple[list[list[tuple[int, int, float]]], float]:
        """For each end position the pieces as ``(start, id, weight)``, and the logarithm of the sum over all segmentations."""
        code = np.array([ord(c) for c in unit], dtype=np.int64)
        weight, ids = self._lattice(code)
        into = [[(j - k, int(ids[k, j]), float(weight[k, j])) for k in range(1, min(j, self.longest) + 1) if weight[k, j] > 0] for j in range(len(unit) + 1)]
        total = [1.0] + [0.0] * len(unit)
        for j in range(1, len(unit) + 1):
            total[j] = sum(total[i] * w for i, _, w in into[j])
        return into, math.log(total[-1])

    def decodes_to(self, ids: np.ndarray, text: str) -> bool:
        """Whether the pieces spell the text, compared part by part."""
        whole, at = text.encode(), 0
        for i in range(0, len(ids), PART):
            part = b"".join(map(self.bytes.__getitem__, ids[i : i + PART].tolist()))
            if not whole.startswith(part, at):
                return False
            at += len(part)
        return at == len(whole)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode()


def _parts(text: str) -> Iterator[tuple[int, int]]:
    """Cuts a text at heads of units into parts of about ``PART`` characters; a longer part is one unit."""
    at = 0
    while len(text) - at > PART:
        cut = text.rfind(" ", at + 1, at + PART)
        while cut > at and text[cut - 1] == " ":
            cut -= 1
        if cut <= at:
            head = _HEAD.search(text, at + 1)
            cut = head.start() if head else len(text)
        yield at, cut
        at = cut
    if at < len(text) or not text:
        yield at, len(text)


def _base(keys: list[int], seed: int) -> np.ndarray:
    return mix(np.array(keys, dtype=np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def _width(code: np.ndarray) -> np.ndarray:
    """Bytes of each character in UTF-8."""
    return 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)


def _uniform(base: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (mix(base ^ mix(place.astype(np.uint64) + np.uint64(1))) >> np.uint64(11)) * 2.0**-53


def _encoder(path: str, theta: float, seed: int, digest: bool, others: list[str]):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = once(f"{path} {theta}", lambda: Pieces(path, theta))
        for whole in batches:
            for b in slices(whole):
                texts = [t or "" for t in b.column("text").to_pylist()]
                ids, at = pieces.encode(texts, b.column("__key").to_pylist(), seed)
                count = pa.array(np.diff(at))
                if digest:
                    sums = [hashlib.sha256(ids[i:j].tobytes()).hexdigest() for i, j in zip(at[:-1], at[1:], strict=True)]
                    same = [pieces.decodes_to(ids[i:j], t) for i, j, t in zip(at[:-1], at[1:], texts, strict=True)]
                    more = [count, pa.array(sums, pa.string()), pa.array(same, pa.bool_())]
                else:
                    more = [count, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), *more], names=[*others, *(["n_pieces", "pieces_sha256", "lossless"] if digest else ["n_pieces", "pieces"])])

    return encode


def sampled(docs: DataFrame, model_path: str, theta: float = THETA, seed: int = SEED, digest: bool = False, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of each document with ``n_pieces`` and ``pieces``, an array of ids; no shuffle.

    ``digest``: instead of the ids, the SHA-256 of them as little-endian 32-bit integers, and whether decoding them gives the
    text back. The key of a row is its doc_id; a null id is a key of its own. Null or empty text: no pieces. Repeated rows get
    the same pieces. Empty table: no rows.
    """
    keep = keep or ["doc_id"]
    given = docs.select(*keep, F.xxhash64("doc_id").alias("__key"), F.col("text").alias("text") if "text" not in keep else F.lit(None).cast("int").alias("__none"))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    made = "n_pieces long, pieces_sha256 string, lossless boolean" if digest else "n_pieces long, pieces array<int>"
    return given.mapInArrow(_encoder(model_path, theta, seed, digest, keep), ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), made]))


def decoder(model_path: str):
    """A function that gives the texts of batches of ``doc_id, pieces``, for mapInArrow with schema ``doc_id long, text string``."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = once(f"{model_path} {THETA}", lambda: Pieces(model_path))
        for b in batches:
            texts = [pieces.decode(x or []) for x in b.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return decode


def decoded(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` of rows of ``doc_id, pieces``; null pieces give the empty text."""
    return encoded.select("doc_id", "pieces").mapInArrow(decoder(model_path), "doc_id long, text string")
