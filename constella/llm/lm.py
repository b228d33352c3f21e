"""Language-model scores from an n-gram trie in Elias-Fano levels.

Level 1 holds the training words: their sorted 64-bit hashes in Elias-Fano code, whose index is the word's id, and counts.
Level 2 holds, for each context word, its successors, and level 3, for each pair, the words that follow it. A shard keeps its
context ids, the monotone pointers to the successor ranges, the successors as one monotone sequence relative to their context
(``context * words + word``), and discounted probabilities in 16-bit logarithmic steps; the pairs' own places in the shard are
the contexts of level 3, whose pointers, successors and probabilities lie in the same shard. A query finds the context, then
searches the successor inside that context's range, and goes on from the place it found.

A shard is one file in the folder all executors share. Executors map a shard when a query first needs it and keep at most
``OPEN`` of them mapped, so a process holds only what it touches, however many shards there are; the pages are shared.

The model discounts absolutely and interpolates down to the additive unigram model of the base score:
``P(w|uv) = max(c(uvw) - D, 0) / c(uv) + D * N1(uv) / c(uv) * P(w|v)``, likewise ``P(w|v)`` with ``P1(w)``; an unseen context
leaves the shorter one's probability. Each text starts in a start context and ends with one end token. ``order`` 2 leaves out
level 3.

Counts cover all training texts. They are combined in each task before the shuffle. Contexts with a large share of all
tokens are split over shards by the next word, so no task holds a hot context alone; how far follows from the word's count.
"""

from __future__ import annotations

import os
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .eliasfano import EliasFano, mapped, write
from .runs import runs
from .store import Scratch
from .words import mix, slices, word_hashes

DISCOUNT, ORDER = 0.75, 3
END = np.uint64(0x8F1BBCDCCA62C1D6)
SPAN = 9.6  # decades that the quantised logarithms cover
WORDS_A_SHARD, TOKENS_A_SHARD, LEAST_SHARDS, OPEN = 500_000, 1_000_000, 16, 128
MOST_TASKS = 20_000  # a task builds several shards beyond that
HELD_TOKENS = 1_000_000  # tokens a task gathers before it combines counts


def _local(folder: str) -> str:
    """The folder as a path that processes can map; the shared folder is mounted under the same path everywhere."""
    url = urlparse(folder)
    if url.scheme not in ("", "file"):
        raise ValueError(f"language-model files are mapped, so spark.checkpoint.dir has to be a mounted folder, not {url.scheme}:")
    return unquote(url.path) if url.scheme else folder


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end token after each text, and for each text the index of its first token (and one past the last)."""
    h, of = word_hashes(text)
    return np.insert(h, of[1:], END), of + np.arange(len(of))


class Files:
    """Mapped shards of a level, at most ``OPEN`` at a time; a shard without a file is empty."""

    def __init__(self, folder: str, kind: str, levels: tuple[str, ...]):
        self.path, self.levels, self.most = f"{folder}/{kind}-", levels, OPEN
        self.held: OrderedDict[int, tuple[dict[str, np.ndarray], dict[str, EliasFano]] | None] = OrderedDict()

    def get(self, shard: int) -> tuple[dict[str, np.ndarray], dict[str, EliasFano]] | None:
        if shard not in self.held:
            if len(self.held) >= self.most:
                self.held.popitem(last=False)
            path = f"{self.path}{shard}"
            arrays = mapped(path) if os.path.exists(path) else None
            self.held[shard] = arrays and (arrays, {x: EliasFano.of(arrays, x) for x in self.levels if f"{x}.n" in arrays})
        self.held.move_to_end(shard)
        return self.held[shard]


@dataclass(frozen=True)
class Model:
    """What a process needs to know of a trie: where it lies and how it is dealt over shards."""

    folder: str
    order: int
    bits: int
    sizes: list[int]
    size: int = 0
    total: int = 0
    texts: int = 0
    shards: int = 1
    share: int = 1

    @property
    def start(self) -> int:
        return self.size


class Words:
    """Level 1."""

    def __init__(self, model: Model):
        self.bits, self.starts = model.bits, np.concatenate([[0], np.cumsum(model.sizes)]).astype(np.int64)
        self.files = Files(model.folder, "words", ("hash",))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of sorted hashes."""
        ids, counts = np.full(len(hashes), -1, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        for s, a, b in _ranges(_top(hashes, self.bits)):
            if found := self.files.get(s):
                i = found[1]["hash"].find(_rest(hashes[a:b], self.bits))
                has = i >= 0
                ids[a:b][has] = i[has] + self.starts[s]
                counts[a:b][has] = found[0]["count"][i[has]]
        return ids, counts

    def count(self, ids: np.ndarray) -> np.ndarray:
        """Counts of sorted ids."""
        out = np.zeros(len(ids), dtype=np.int64)
        for s, a, b in _ranges(np.searchsorted(self.starts, ids, side="right") - 1):
            out[a:b] = self.files.get(s)[0]["count"][ids[a:b] - self.starts[s]]
        return out


def _ranges(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each value of a sorted array and where it lies."""
    if len(shard):
        cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(shard[a]), a, b


def _top(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), dtype=np.int64)


def _rest(h: np.ndarray, bits: int) -> np.ndarray:
    return h & np.uint64((1 << (64 - bits)) - 1) if bits else h


def _route(context: np.ndarray, word: np.ndarray, count: np.ndarray, model: Model) -> np.ndarray:
    """The shard of each pair; a context with a count beyond the share lies in several."""
    part = np.where(count > model.share, word % (count // model.share + 1), 0)
    return (mix(context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64) + np.uint64(1)) % np.uint64(model.shards)).astype(np.int64)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens of several texts, and where each text starts."""
    parts, starts, n = [], [], 0
    for whole in batches:
        for b in slices(whole):
            h, of = tokens(b.column("text"))
            parts.append(h), starts.append(of[:-1] + n)
            n += len(h)
            if n >= HELD_TOKENS:
                yield np.concatenate(parts), np.concatenate(starts)
                parts, starts, n = [], [], 0
    if parts:
        yield np.concatenate(parts), np.concatenate(starts)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for h, _ in _gathered(batches):
        word, count = np.unique(h, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(count.astype(np.int64))], names=["hash", "count"])


def _write_words(folder: str, bits: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, ["shard"]):
            s = run.column("shard")[0].as_py()
            h, c = run.column("hash").to_numpy().view(np.uint64), run.column("count").to_numpy()
            order = np.argsort(h)
            write(f"{folder}/words-{s}", EliasFano.build(_rest(h[order], bits), 1 << (64 - bits)).arrays("hash") | {"count": c[order]})
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([len(h)], pa.int64())], names=["shard", "n"])

    return build


def _pairs(h: np.ndarray, starts: np.ndarray, words: Words, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: its id, its context's id, its count, its context's count."""
    unique, inverse = np.unique(h, return_inverse=True)
    ids, counts = words.find(unique)
    word, count = ids[inverse], counts[inverse]
    context, before = np.empty_like(word), np.empty_like(count)
    context[1:], before[1:] = word[:-1], count[:-1]
    context[starts], before[starts] = model.start, model.texts
    return word, context, count, before


def _count_pairs(model: Model):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = Words(model)
        for h, starts in _gathered(batches):
            word, context, _, before = _pairs(h, starts, level, model)
            key, first, back, n = np.unique((context.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64), return_index=True, return_inverse=True, return_counts=True)
            shard = _route(context[first], word[first], before[first], model)
            order = np.argsort(shard, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            key, n = key[order], n[order]
            columns = {"contexts": (key >> np.uint64(32)).astype(np.uint32), "words": (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), "counts": np.minimum(n, 2**32 - 1).astype(np.uint32)}
            cuts = np.searchsorted(shard[order], np.arange(model.shards + 1)) if model.shards < len(order) else None
            spans = list(_ranges(shard[order])) if cuts is None else [(s, a, b) for s, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
            blobs = {c: [x[a:b].tobytes() for _, a, b in spans] for c, x in columns.items()}
            if model.order > 2:
                inner = np.ones(len(word), dtype=bool)
                inner[starts] = False
                at = np.flatnonzero(inner)
                key, n = np.unique((place[back[at - 1]].astype(np.uint64) << np.uint64(32)) | word[at].astype(np.uint64), return_counts=True)
                pair = (key >> np.uint64(32)).astype(np.int64)
                pointers = np.searchsorted(pair, np.arange(len(order) + 1))
                many = np.diff(pointers).astype(np.uint32)
                third, n = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.minimum(n, 2**32 - 1).astype(np.uint32)
                blobs["many"] = [many[a:b].tobytes() for _, a, b in spans]
                blobs |= {c: [x[pointers[a] : pointers[b]].tobytes() for _, a, b in spans] for c, x in (("thirds", third), ("third_counts", n))}
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in spans], pa.int32()), *(pa.array(x, pa.binary()) for x in blobs.values())], names=["shard", *blobs])

    return count


def _quantise(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((np.log10(p) + SPAN) * (65535 / SPAN)), 0, 65535).astype(np.uint16)


def _coded(contexts: int, of: np.ndarray, word: np.ndarray, n: np.ndarray, total: np.ndarray, size: int, kind: str) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Pointers and files of the successors of ``contexts`` contexts; ``of`` and ``word`` are sorted and differ."""
    pointers = np.searchsorted(of, np.arange(contexts + 1))
    files = EliasFano.build(pointers, len(of) + 1).arrays(f"pointer{kind}") | EliasFano.build(of * size + word, max(1, contexts * size)).arrays(f"successor{kind}")
    return pointers, files | {f"p{kind}": _quantise((n - DISCOUNT) / total[of])}


def _write_pairs(model: Model):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = Words(model)
        for run in runs(batches, ["shard"]):
            s = run.column("shard")[0].as_py()
            read = lambda c: np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in run.column(c)])  # noqa: E731, B023
            key, n = (read("contexts").astype(np.uint64) << np.uint64(32)) | read("words"), read("counts").astype(np.int64)
            key, back = np.unique(key, return_inverse=True)
            n = np.bincount(back, weights=n, minlength=len(key)).astype(np.int64)
            context, word = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
            own, local = np.unique(context, return_inverse=True)
            total = np.full(len(own), model.texts, dtype=np.int64)
            total[own != model.start] = level.count(own[own != model.start])
            pointers, files = _coded(len(own), local, word, n, total, model.size, "2")
            files |= EliasFano.build(own, model.size + 1).arrays("context")
            if model.order > 2:
                key3 = (np.repeat(back, read("many")).astype(np.uint64) << np.uint64(32)) | read("thirds")
                key3, back3 = np.unique(key3, return_inverse=True)
                n3 = np.bincount(back3, weights=read("third_counts"), minlength=len(key3)).astype(np.int64)
                pair, third = (key3 >> np.uint64(32)).astype(np.int64), (key3 & np.uint64(0xFFFFFFFF)).astype(np.int64)
                total3 = np.bincount(pair, weights=n3, minlength=len(key)).astype(np.int64)
                pointers3, more = _coded(len(key), pair, third, n3, total3, model.size, "3")
                files |= more | {"rest3": _quantise(np.maximum(DISCOUNT * np.diff(pointers3), 1e-9) / np.maximum(total3, 1))}
            write(f"{model.folder}/pairs-{s}", files)
            wide = np.flatnonzero(total > model.share)
            of = [-1, *own[wide].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([s] * len(of), pa.int32()), pa.array(of, pa.int64()), pa.array([len(key), *np.diff(pointers)[wide].tolist()], pa.int64())], names=["shard", "word", "n"])

    return build


def _write_wide(model: Model):
    """One file with the number of successors of each context that lies in several shards."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [b for b in batches if b.num_rows]
        if table:
            word, n = (np.concatenate([b.column(c).to_numpy() for b in table]) for c in ("word", "n"))
            order = np.argsort(word)
            write(f"{model.folder}/wide-0", {"word": word[order], "n": n[order]})
            yield pa.RecordBatch.from_arrays([pa.array([len(word)], pa.int64())], names=["n"])

    return build


class Trie:
    """All levels, for queries."""

    def __init__(self, model: Model):
        self.model, self.words = model, Words(model)
        self.files = Files(model.folder, "pairs", ("context", "pointer2", "successor2", "pointer3", "successor3"))
        self.wide = Files(model.folder, "wide", ())

    def score(self, h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token whether it is known, the base probability, and the model's."""
        m = self.model
        word, context, count, before = _pairs(h, of[:-1], self.words, m)
        p1 = (count + 0.5) / (m.total + 0.5 * (m.size + 1))
        p = p1.copy()
        at = np.flatnonzero((context >= 0) & (before > 0))
        if not len(at):
            return count > 0, p1, p
        key, first, back = np.unique((context[at].astype(np.uint64) << np.uint64(32)) | (word[at] + 1).astype(np.uint64), return_index=True, return_inverse=True)
        heads, tails, often = context[at[first]], word[at[first]], before[at[first]]
        shard = _route(heads, np.maximum(tails, 0), often, m)
        order = np.argsort(shard, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        heads, tails, often = heads[order], tails[order], often[order]
        seen, follow = np.zeros(len(heads)), np.zeros(len(heads), dtype=np.int64)
        pair_of = np.full(len(h), -1, dtype=np.int64)  # the place of each token's pair among the different ones
        pair_of[at] = rank[back]
        # tokens whose two words before are a known pair, by the shard of that pair
        inner = np.ones(len(h), dtype=bool)
        inner[of[:-1]] = False
        third = np.flatnonzero(inner)
        third = third[pair_of[third - 1] >= 0] if m.order > 2 else third[:0]
        third = third[np.argsort(pair_of[third - 1], kind="stable")]
        ahead = pair_of[third - 1]
        p3, rest3 = np.zeros(len(third)), np.ones(len(third))
        for s, a, b in _ranges(shard[order]):
            if not (found := self.files.get(s)):
                continue
            files, level = found
            local = level["context"].find(heads[a:b])
            has = np.flatnonzero(local >= 0)
            follow[a + has] = (level["pointer2"].at(local[has] + 1) - level["pointer2"].at(local[has])).astype(np.int64)
            has = has[tails[a + has] >= 0]
            pair = np.full(b - a, -1, dtype=np.int64)
            pair[has] = level["successor2"].find(local[has] * m.size + tails[a + has])
            known = np.flatnonzero(pair >= 0)
            seen[a + known] = _real(files["p2"][pair[known]])
            c, d = np.searchsorted(ahead, [a, b])
            if c == d:
                continue
            mine = pair[ahead[c:d] - a]
            good = np.flatnonzero(mine >= 0)
            if not len(good):
                continue
            rest3[c + good] = _real(files["rest3"][mine[good]])
            good = good[word[third[c + good]] >= 0]
            i = level["successor3"].find(mine[good] * m.size + word[third[c + good]])
            p3[c + good[i >= 0]] = _real(files["p3"][i[i >= 0]])
        if (spread := np.flatnonzero(often > m.share)).size:
            wide = self.wide.get(0)[0]
            follow[spread] = wide["n"][np.searchsorted(wide["word"], heads[spread])]
        weight = np.where(follow > 0, DISCOUNT * follow / np.maximum(often, 1), 1.0)
        p[at] = p1[at] * weight[pair_of[at]] + seen[pair_of[at]]
        p[third] = p[third] * rest3 + p3
        return count > 0, p1, p


def _real(steps: np.ndarray) -> np.ndarray:
    return 10.0 ** (steps * (SPAN / 65535) - SPAN)


def _scorer(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(model)
        for whole in batches:
            for b in slices(whole, most=2 << 20):
                h, of = tokens(b.column("text"))
                known, p1, p = trie.score(h, of)
                n, first = np.diff(of), of[:-1]
                sums = [np.add.reduceat(x, first) if len(first) else np.zeros(0) for x in (known.astype(np.int64), np.log10(p1), np.log10(p))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(n.astype(np.int64)), pa.array(sums[0].astype(np.int64)), pa.array(np.full(len(n), model.total, dtype=np.int64)), pa.array(sums[1]), pa.array(sums[2])], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return score


def train(spark: SparkSession, training: DataFrame, order: int = ORDER) -> Model:
    """A trie over the column ``text``, in files under the folder that all executors share.

    The folder has to be a mounted path, as its files are mapped; anything else raises at once.
    """
    scratch = Scratch(spark)
    folder = _local(scratch.folder)
    os.makedirs(folder, exist_ok=True)
    counts = scratch.save(training.mapInArrow(_count_words, "hash long, count long").groupBy("hash").agg(F.sum("count").alias("count")))
    total, size = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    if size > 2**32 - 2:
        raise ValueError("more than 2**32 - 2 different words")
    bits = max(0, (size // WORDS_A_SHARD).bit_length())
    top = F.shiftrightunsigned("hash", 64 - bits).cast("int") if bits else F.lit(0)
    # one row for each shard of words, of which there are at most 2 ** 14
    made = counts.withColumn("shard", top).repartition(1 << bits, "shard").sortWithinPartitions("shard").mapInArrow(_write_words(folder, bits), "shard int, n long").collect()
    sizes = {r[0]: r[1] for r in made}
    texts = next((r[0] for r in counts.where(F.col("hash") == int(END.astype(np.int64))).select("count").collect()), 0)
    scratch.drop(counts)
    shards = max(LEAST_SHARDS, total // TOKENS_A_SHARD)
    model = Model(folder, order, bits, [sizes.get(s, 0) for s in range(1 << bits)], size, total, texts, shards, max(1, total // (4 * shards)))
    fields = ["contexts", "words", "counts", *(["many", "thirds", "third_counts"] if order > 2 else [])]
    dealt = training.mapInArrow(_count_pairs(model), "shard int, " + ", ".join(f"{c} binary" for c in fields))
    made = scratch.save(dealt.repartition(min(shards, MOST_TASKS), "shard").sortWithinPartitions("shard").mapInArrow(_write_pairs(model), "shard int, word long, n long"))
    made.where("word >= 0").groupBy("word").agg(F.sum("n").alias("n")).repartition(1).mapInArrow(_write_wide(model), "n long").collect()  # one row
    scratch.drop(made)
    return model


def lm_scores(spark: SparkSession, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", order: int = ORDER) -> DataFrame:
    """One row a document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` (base-10 logarithms).

    Training texts are those whose crc32 of the id as text leaves a remainder other than 1 by 5. Null text: empty, one end
    token. Null id: counts as the text ''. Repeated rows count each time. Without training texts both scores come from
    the additive model alone. Empty table: no rows. Extra columns are ignored.
    """
    held = (F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % 5) == 1
    given = docs.select(F.col(id_column).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_column).alias("text"))
    model = train(spark, given.where(~F.col("held_out")).select("text"), order)
    return given.mapInArrow(_scorer(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
