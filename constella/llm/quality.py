"""Quality classifier by co-training.

Two views of a document: its text (shape and repetition of words, kinds of characters, shares of hashed words and word pairs)
and its page metadata (source, language, stated length). A logistic model for each view is fitted on labelled documents. In
each round both models, calibrated on labelled documents kept aside, label all unlabelled documents; each view is then fitted
by Newton steps on the labelled documents and on all those that the other view is sure of, from a probability on from which
its labels of the kept-aside documents are proven right. The sums of a step are added up in
the tasks over all unlabelled documents with different texts, weighted by class so that together they count at most as much as
the labelled ones and keep their proportions. In the end the calibrated views are combined by weights that the kept-aside
documents decide, so that an uninformative view gets none, and all documents are scored.

Only the labelled documents are bounded, to ``LABELLED`` ids in hash order. Features are written once and read in each step;
texts are never shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runs import fixed
from .store import Scratch, beside
from .words import slices, text_bytes, word_hashes, word_spans

LABELLED, ROUNDS, STEPS, CONFIDENT, SOURCES, LANGUAGES, LENGTHS, WORDS, PAIRS = 20_000, 3, 2, 0.97, 64, 16, 12, 128, 32
SHAPES, FLOOR, HASHED = 18, 1 / 16, 50.0  # the many hashed columns are held back more than the shapes


def text_view(text: pa.Array) -> np.ndarray:
    """A row of half-precision numbers for each text; all from whole texts."""
    raw, offsets = text_bytes(text)
    words, of = word_hashes(text)
    starts, ends, _ = word_spans(raw, offsets)
    n = np.diff(of)
    size = np.diff(offsets)
    kinds = np.zeros(256, dtype=np.int64)
    kinds[65:91], kinds[97:123], kinds[48:58], kinds[128:], kinds[[32, 9, 10, 11, 12, 13]] = 1, 2, 3, 4, 5
    # 0: signs
    kind = kinds[raw]
    per = [np.concatenate([[0], np.cumsum(kind == k)]) for k in range(6)]
    per.append(np.concatenate([[0], np.cumsum(raw == 10)]))
    counts = [c[offsets[1:]] - c[offsets[:-1]] for c in per]
    solid = np.maximum(size - counts[5], 1)
    many = np.maximum(n, 1)
    same = np.concatenate([[False], words[1:] == words[:-1]]) if len(words) else np.zeros(0, bool)
    last = kind[ends - 1] == 0 if len(words) else np.zeros(0, bool)
    first_up = kind[starts] == 1 if len(words) else np.zeros(0, bool)
    length = ends - starts
    share = lambda flags: (lambda c: (c[of[1:]] - c[of[:-1]]) / many)(np.concatenate([[0], np.cumsum(flags)]))
    mean = share(length)
    var = share(length.astype(np.float64) ** 2) - mean**2
    distinct, top, twice = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
    for i in range(len(n)):
        w = words[of[i] : of[i + 1]]
        if len(w):
            s = np.sort(w)
            runs = np.diff(np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]])))
            distinct[i], top[i] = len(runs) / len(w), runs.max() / len(w)
            if len(w) > 1:
                g = np.sort(w[1:] * np.uint64(31) + w[:-1])
                twice[i] = (g[1:] == g[:-1]).mean() if len(g) > 1 else 0
    columns = [np.log1p(size), np.log1p(n), mean, np.sqrt(np.maximum(var, 0)), distinct, distinct * np.log1p(n), top, twice, share(same), share(last), share(first_up), *(c / solid for c in counts[:5]), counts[5] / np.maximum(size, 1), counts[6] / many]
    row = np.repeat(np.arange(len(n)), n)
    hashed = lambda h, bins, rows: np.bincount(rows * bins + (h % np.uint64(bins)).astype(np.int64), minlength=len(n) * bins).reshape(len(n), bins)
    inner = np.flatnonzero(row[1:] == row[:-1])
    pairs = (words[inner] * np.uint64(31) + words[inner + 1]) >> np.uint64(7)
    shares = [np.sqrt(hashed(words >> np.uint64(5), WORDS, row) / many[:, None]), np.sqrt(hashed(pairs, PAIRS, row[inner]) / many[:, None])]
    return np.hstack([np.stack(columns, axis=1), *shares]).astype(np.float16)


def metadata_view(source: pa.Array, lang: pa.Array, chars: pa.Array) -> np.ndarray:
    """Places of the hashed source and language, and of the stated length in steps; nothing from the text."""
    places = lambda column, bins: [zlib.crc32((s or "").encode()) % bins for s in column.to_pylist()]
    steps = np.clip(np.log2(np.maximum(chars.fill_null(0).to_numpy(zero_copy_only=False), 1)) / 1.5, 0, LENGTHS - 1)
    return np.stack([np.array(places(source, SOURCES), dtype=np.uint8), np.array(places(lang, LANGUAGES), dtype=np.uint8), steps.astype(np.uint8)], axis=1)


def _text_columns(t: np.ndarray) -> np.ndarray:
    return t.astype(np.float64)


def _metadata_columns(m: np.ndarray) -> np.ndarray:
    out, rows = np.zeros((len(m), SOURCES + LANGUAGES + LENGTHS)), np.arange(len(m))
    for j, first in enumerate((0, SOURCES, SOURCES + LANGUAGES)):
        out[rows, first + m[:, j]] = 1
    return out


COLUMNS: tuple[Callable[[np.ndarray], np.ndarray], ...] = (_text_columns, _metadata_columns)


class Logistic:
    """Ridge logistic regression on standardised columns, fitted by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0)
        self.scale[self.scale < 1e-9] = 1
        z = self._design(x)
        self.w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[0] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty) + 1e-9 * np.eye(z.shape[1])
            step = np.linalg.solve(h, z.T @ (y - p) - penalty * self.w)
            self.w += step
            if np.abs(step).max() < 1e-6:
                break

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.ones((len(x), 1)), np.clip((x - self.mean) / self.scale, -8, 8)])

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._design(x) @ self.w, -30, 30)


def _chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _sums(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log-likelihood of ``y`` at ``w``, and its curvature; rows that are all but decided count with
    ``FLOOR``, so that a row on the wrong side moves the weights a little instead of throwing them far."""
    p = _chance(z @ w)
    return z.T @ (y - p), (z * np.maximum(p * (1 - p), FLOOR)[:, None]).T @ z


def proven(p: np.ndarray, right: np.ndarray) -> float:
    """The least probability, ``CONFIDENT`` at least, from which on that share of labels is right; over 1 if there is none."""
    order = np.argsort(-p, kind="stable")
    share = (np.cumsum(right[order]) + 0.5) / (np.arange(len(p)) + 2)
    good = np.flatnonzero((share >= CONFIDENT) & (p[order] >= CONFIDENT))
    return float(p[order][good[-1]]) if len(good) else 2.0


class View:
    """Ridge logistic regression on columns standardised over the labelled rows, with Newton steps and a calibration."""

    def __init__(self, columns: Callable[[np.ndarray], np.ndarray], rows: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.columns = columns
        x = columns(rows)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0)
        self.scale[self.scale < 1e-9] = 1
        self.z, self.y = self.design(rows), y
        self.penalty = np.full(self.z.shape[1], ridge)
        self.penalty[0] = 1e-6
        if columns is _text_columns:
            self.penalty[1 + SHAPES :] = HASHED * ridge
        self.w = np.zeros(self.z.shape[1])
        for _ in range(100):
            if self.step(0.0, 0.0) < 1e-6:
                break

    def design(self, rows: np.ndarray) -> np.ndarray:
        x = self.columns(rows)
        return np.hstack([np.ones((len(x), 1)), np.clip((x - self.mean) / self.scale, -8, 8)])

    def step(self, gradient: np.ndarray | float, curvature: np.ndarray | float) -> float:
        """A Newton step on the labelled rows and the given sums."""
        g, h = _sums(self.z, self.y, self.w)
        move = np.linalg.solve(h + curvature + np.diag(self.penalty) + 1e-9 * np.eye(len(self.w)), g + gradient - self.penalty * self.w)
        self.w += move
        return float(np.abs(move).max())

    def margin(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(self.design(rows) @ self.w, -30, 30)

    def calibrate(self, rows: np.ndarray, y: np.ndarray) -> None:
        """Probabilities, and from which ones on the labels are proven right on ``rows``."""
        self.scaled = Logistic(self.margin(rows)[:, None], y, ridge=1e-3)
        p = _chance(self.calibrated(rows))
        self.sure = 1 - proven(1 - p, y == 0), proven(p, y == 1)

    def calibrated(self, rows: np.ndarray) -> np.ndarray:
        return self.scaled.margin(self.margin(rows)[:, None])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("z", "y")}  # scoring needs no labelled rows


def pseudo_sums(views: list[View], weights: list[np.ndarray], rows: list[np.ndarray]) -> list[np.ndarray]:
    """For each view and class the number of rows that the other view is sure of, and their gradient and curvature.

    ``views`` label the rows; the sums are taken at ``weights``.
    """
    out = []
    for v in (0, 1):
        p, (low, high) = _chance(views[1 - v].calibrated(rows[1 - v])), views[1 - v].sure
        for label in (0.0, 1.0):
            sure = np.flatnonzero(p >= high if label else p <= low)
            z = views[v].design(rows[v][sure])
            g, h = _sums(z, np.full(len(z), label), weights[v])
            out.append(np.concatenate([[len(sure)], g, h[np.triu_indices(len(g))]]))
    return out


class CoTrained:
    """Two calibrated views and their combination; ``None`` views where labels cannot tell the classes apart."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, totals: Callable[[list[View], list[np.ndarray]], list[np.ndarray]] | None, rounds: int = ROUNDS):
        """``rows``: for each view those of the labelled documents; ``totals``: ``pseudo_sums`` over all others."""
        self.handed: list[tuple[int, int]] = []
        y = labels.astype(np.float64)
        self.prior = float(y.mean()) if len(y) else 1.0
        self.views: list[View] | None = None
        kept = np.arange(len(y)) % 4 == 0
        if min((y[kept] == c).sum() for c in (0, 1)) < 2 or min((y[~kept] == c).sum() for c in (0, 1)) < 2:
            return
        views = [View(COLUMNS[v], rows[v][~kept], y[~kept]) for v in (0, 1)]
        for v in (0, 1):
            views[v].calibrate(rows[v][kept], y[kept])
        for _ in range(rounds if totals else 0):
            sure = [_frozen(v) for v in views]
            for _ in range(STEPS):
                sums = totals(sure, [v.w for v in views])
                for v in (0, 1):
                    views[v].step(*self._weighted(sums[2 * v : 2 * v + 2], (~kept).sum(), len(views[v].w)))
            self.handed.append(tuple(int(sums[2 * v][0] + sums[2 * v + 1][0]) for v in (0, 1)))
            for v in (0, 1):
                views[v].calibrate(rows[v][kept], y[kept])
        self.views = views
        self.mixture = Logistic(np.stack([views[v].calibrated(rows[v][kept]) for v in (0, 1)], axis=1), y[kept], ridge=1e-2)

    def _weighted(self, by_class: list[np.ndarray], most: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of both classes, in the labelled proportions and with at most the labelled rows' weight."""
        counts = [s[0] for s in by_class]
        share = min(most, sum(counts))
        g, h = np.zeros(width), np.zeros((width, width))
        upper = np.triu_indices(width)
        for s, part in zip(by_class, (1 - self.prior, self.prior), strict=True):
            weight = min(1.0, share * part / s[0]) if s[0] else 0.0
            g += weight * s[1 : width + 1]
            h[upper] += weight * s[width + 1 :]
        return g, h + np.triu(h, 1).T

    def score(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of good quality by each view, and combined."""
        if self.views is None:
            return [np.full(len(rows[0]), self.prior)] * 3
        margins = [v.calibrated(r) for v, r in zip(self.views, rows, strict=True)]
        return [_chance(m) for m in (*margins, self.mixture.margin(np.stack(margins, axis=1)))]


def _frozen(view: View) -> View:
    """The view as it labels now, without its labelled rows."""
    out = View.__new__(View)
    out.__dict__ |= view.__getstate__() | {"w": view.w.copy()}
    return out


def _views(b: pa.RecordBatch) -> list[np.ndarray]:
    return [text_view(b.column("text")), metadata_view(b.column("source"), b.column("lang"), b.column("n_chars"))]


def _unpacked(b: pa.RecordBatch) -> list[np.ndarray]:
    if not b.num_rows:
        return [np.zeros((0, SHAPES + WORDS + PAIRS), np.float16), np.zeros((0, 3), np.uint8)]
    return [fixed(pa.chunked_array([b.column(c)]), kind, width) for c, kind, width in (("t", np.float16, SHAPES + WORDS + PAIRS), ("m", np.uint8, 3))]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole):
            t, m = _views(b)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("same"), pa.array([x.tobytes() for x in t], pa.binary()), pa.array([x.tobytes() for x in m], pa.binary())], names=["doc_id", "same", "t", "m"])


def _summed(views: list[View], weights: list[np.ndarray]):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            own = pseudo_sums(views, weights, _unpacked(b))
            total = own if total is None else [x + y for x, y in zip(total, own, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in total], names=list("abcd"))

    return sums


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for r in b.to_pylist():
            own = [np.frombuffer(r[c]) for c in "abcd"]
            total = own if total is None else [x + y for x, y in zip(total, own, strict=True)]
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in total], names=list("abcd"))


def _scorer(model: CoTrained):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.score(_unpacked(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x) for x in p), pa.array(p[2] >= 0.5)], names=["doc_id", "p_text", "p_metadata", "score", "accepted"])

    return score


def _keeper(model: CoTrained):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "__text"):
                own = pa.RecordBatch.from_arrays([b.column(f"__{c}") for c in ("text", "source", "lang", "n_chars")], names=["text", "source", "lang", "n_chars"])
                columns = [i for i, c in enumerate(b.schema.names) if c not in ("__text", "__source", "__lang", "__n_chars")]
                yield b.select(columns).filter(pa.array(model.score(_views(own))[2] >= 0.5))

    return keep


def accepted(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns; rows that repeat are judged alike."""
    model, scratch, rows = fit(spark, docs, labels)
    scratch.drop(rows)
    given = docs.select("*", *[c.alias(f"__{n}") for n, c in zip(("doc_id", "text", "source", "lang", "n_chars"), _given(docs), strict=True) if n != "doc_id"])
    return given.mapInArrow(_keeper(model), docs.schema)


def _given(docs: DataFrame) -> list:
    has = set(docs.columns)
    column = lambda c, kind: (F.col(c) if c in has else F.lit(None)).cast(kind).alias(c)
    return [column("doc_id", "long"), column("text", "string"), column("source", "string"), column("lang", "string"), column("n_chars", "long")]


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> tuple[CoTrained, Scratch, DataFrame]:
    """A model from at most ``labelled`` labelled documents and all others; with it the table of features and its store.

    Labels that are null or other than 0 and 1, and those of several values for one id, don't count. Of rows that repeat a
    labelled id the one with the least features counts. With too few labels of either class every document gets the share
    of good ones, or 1 without any label.
    """
    scratch = Scratch(spark)
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
    marks = scratch.save(marks.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")))
    wanted = scratch.save(marks.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(labelled))
    given = docs.select(*_given(docs)).withColumn("same", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = scratch.save(given.mapInArrow(_featured, "doc_id long, same long, t binary, m binary"))
    known = rows.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct("t", "m")).alias("r")).select("doc_id", "quality", "r.t", "r.m").toPandas()
    known = known.assign(o=[zlib.crc32(str(i).encode()) for i in known.doc_id]).sort_values(["o", "doc_id"])
    matrix = lambda c, kind, width: np.frombuffer(b"".join(known[c]), dtype=kind).reshape(-1, width)
    # all documents without a label, those with equal texts once
    pool = rows.join(beside(marks.select("doc_id")), "doc_id", "left_anti").groupBy("same").agg(F.min(F.struct("t", "m")).alias("r")).select("r.t", "r.m")
    pool = scratch.save(pool)

    def totals(views: list[View], weights: list[np.ndarray]) -> list[np.ndarray]:
        parts = pool.mapInArrow(_summed(views, weights), "a binary, b binary, c binary, d binary")
        few = max(1, int(pool.rdd.getNumPartitions() ** 0.5))  # sums are added in two levels, so that the driver gets few
        sums = parts.repartition(few).mapInArrow(_added, "a binary, b binary, c binary, d binary").collect()
        if not sums:
            return pseudo_sums(views, weights, _unpacked(pa.RecordBatch.from_pylist([], pa.schema([("t", pa.binary()), ("m", pa.binary())]))))
        return [np.sum([np.frombuffer(r[c]) for r in sums], axis=0) for c in range(4)]

    model = CoTrained([matrix("t", np.float16, SHAPES + WORDS + PAIRS), matrix("m", np.uint8, 3)], known.quality.to_numpy(dtype=float), totals)
    scratch.drop(marks, wanted, pool)
    return model, scratch, rows


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: ``doc_id, p_text, p_metadata, score, accepted``; accepted where the combined probability is 0.5 or more.

    Null or empty text, null metadata: scored like others, as empty. Null and repeated ids: a row each. Missing metadata
    columns count as null, others are ignored. Empty table: no rows.
    """
    model, _, rows = fit(spark, docs, labels)
    return rows.select("doc_id", "t", "m").mapInArrow(_scorer(model), "doc_id long, p_text double, p_metadata double, score double, accepted boolean")
