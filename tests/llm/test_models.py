"""Language model, sampled pieces, quality classifier, pipeline."""

import collections
import hashlib
import math
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from constella.llm import contain, lm, minhash, pieces, pii, quality
from constella.llm.eliasfano import EliasFano
from constella.llm.queries import PIECES, QUERIES


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, universe in ((0, 10), (1, 1), (5, 5), (1000, 1000), (3000, 10**6), (3000, 2**63)):
        v = np.unique(rng.integers(0, universe, n, dtype=np.uint64))
        ef = EliasFano.build(v, universe)
        assert (ef.find(v) == np.arange(len(v))).all() and (ef.at(np.arange(len(v))) == v).all()
        other = rng.integers(0, universe, 500, dtype=np.uint64)
        place = {int(x): i for i, x in enumerate(v)}
        assert ef.find(other).tolist() == [place.get(int(x), -1) for x in other]
    v = np.sort(rng.integers(0, 50, 200).astype(np.uint64))  # repeats, as pointers have
    assert (EliasFano.build(v, 50).at(np.arange(200)) == v).all()


def brute_scores(rows, order):
    train, pairs, triples = collections.Counter(), collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    texts = [((x or "").encode().lower().split() + ["end"], zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1) for i, x in rows]
    for w, held in texts:
        if not held:
            train.update(w)
            for a, b in zip(["start", *w[:-1]], w, strict=True):
                pairs[a][b] += 1
            for a, b, c in zip(["start", *w[:-2]], w[:-1], w[1:], strict=False):
                triples[a, b][c] += 1
    n, v = sum(train.values()), len(train)
    p1 = lambda w: (train[w] + 0.5) / (n + 0.5 * (v + 1))

    def backed(h, w, shorter):
        if not h:
            return shorter
        c = sum(h.values())
        return max(h[w] - lm.DISCOUNT, 0) / c + lm.DISCOUNT * len(h) / c * shorter

    out = []
    for w, held in texts:
        score = 0
        for t, x in enumerate(w):
            p = backed(pairs.get(w[t - 1] if t else "start"), x, p1(x))
            if t and order > 2:
                p = backed(triples.get((w[t - 2] if t > 1 else "start", w[t - 1])), x, p)
            score += math.log10(p)
        out.append((held, len(w), sum(train[x] > 0 for x in w), n, sum(math.log10(p1(x)) for x in w), score))
    return out


def check_scores(found, rows, order):
    got = collections.defaultdict(list)
    for r in found:
        got[r["doc_id"]].append(r)
    for (i, _), (held, n, known, total, base, score) in zip(rows, brute_scores(rows, order), strict=True):
        r = next(r for r in got[i] if r["n_tokens"] == n)
        assert (r["held_out"], r["n_known"], r["train_tokens"]) == (held, known, total)
        assert r["base_score"] == pytest.approx(base, abs=1e-6 * n) and r["score"] == pytest.approx(score, abs=2e-4 * n)


def test_lm_scores(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(9001, None), (9002, ""), (None, "The the THE"), (9003, "the " * 30_000), (9004, "one unheard-of word"), (9004, "one unheard-of word twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"shard": __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1), "hash": __import__("pyspark.sql.functions", fromlist=["lit"]).lit(2)})
    held = {}
    for order in (2, 3):
        got = [r.asDict() for r in lm.lm_scores(spark, docs, order=order).collect()]
        assert len(got) == len(rows)
        check_scores(got, rows, order)
        held[order] = sum(r["score"] for r in got if r["held_out"])
        base = sum(r["base_score"] for r in got if r["held_out"])
    assert held[3] > held[2] > base


def test_lm_of_many_shards_keeps_few_files_open(spark, small, monkeypatch):
    import resource

    monkeypatch.setattr(lm, "LEAST_SHARDS", 2000)
    monkeypatch.setattr(lm, "OPEN", 20)
    monkeypatch.setattr(lm, "MOST_TASKS", 8)
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    model = lm.train(spark, spark.createDataFrame([(t,) for (_, t), h in zip(rows, held, strict=True) if not h], "text string"))
    assert model.shards == 2000
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "held_out": held, "text": [t for _, t in rows]})
    limits = resource.getrlimit(resource.RLIMIT_NOFILE)
    open_now = len(os.listdir("/proc/self/fd"))
    resource.setrlimit(resource.RLIMIT_NOFILE, (open_now + 12, limits[1]))
    try:
        out = [r for b in lm._scorer(model)(iter([batch])) for r in b.to_pylist()]
        maps = open("/proc/self/maps").read().count("/pairs-")
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, limits)
    check_scores(out, rows, 3)
    assert maps <= 21


def test_lm_without_training_texts(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    check_scores([r.asDict() for r in lm.lm_scores(spark, spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()], [(held, "a b")], 3)
    assert lm.lm_scores(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces(PIECES)


HARD = ["", " ", "▁ a ▁▁  b", "\n\n  x", "🙂é\x00ß", "a" * 3000, " " * 300, "x▁y" * 50, "日本語" * 400, "\U0010ffff a", "𝕏" * 64 + " 𝕏"]


def test_pieces_round_trip_and_do_not_depend_on_the_batch(vocabulary):
    ids, at = vocabulary.encode(HARD, list(range(len(HARD))))
    for k, (text, a, b) in enumerate(zip(HARD, at[:-1], at[1:], strict=True)):
        assert vocabulary.decode(ids[a:b].tolist()) == text
        assert (vocabulary.encode([text], [k])[0] == ids[a:b]).all()


def test_long_texts_in_parts_give_the_same_pieces(vocabulary, monkeypatch):
    texts = [*HARD, "one two  three   " * 40, "x" * 500 + " y" * 200, "   " * 100 + "a b", "é" * 130 + " " + "日本語テキスト" * 60, ""]
    keys = list(range(len(texts)))
    whole = vocabulary.encode(texts, keys)
    for part, window in ((30, 7), (100, 16), (1, 50)):
        monkeypatch.setattr(pieces, "PART", part)
        monkeypatch.setattr(pieces, "WINDOW", window)
        ids, at = vocabulary.encode(texts, keys)
        assert (at == whole[1]).all() and (ids == whole[0]).all()
        assert all(vocabulary.decodes_to(ids[a:b], t) for a, b, t in zip(at[:-1], at[1:], texts, strict=True))
        assert not vocabulary.decodes_to(ids[:5], "no") and not vocabulary.decodes_to(ids[:0], "no")


def test_memory_of_very_long_texts(vocabulary):
    import subprocess
    import sys

    code = """
import resource, sys
sys.path.insert(0, {root!r})
from constella.llm import pieces
v = pieces.Pieces({path!r})
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for text in ("some words of a long text " * 800_000, "unbroken" * 40_000):
    ids, at = v.encode([text], [1])
    assert v.decodes_to(ids, text)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    out = subprocess.run([sys.executable, "-c", code.format(root=root, path=PIECES)], capture_output=True, text=True, check=True, timeout=600).stdout
    assert int(out) < 500


@pytest.mark.parametrize("unit", [" theth", "theée", " inerent"])
def test_pieces_are_drawn_by_their_probability(vocabulary, unit):
    into, total = vocabulary.forward(unit)
    exact = collections.Counter()

    def walk(j, ids, w):
        if j == 0:
            exact[ids] += w
        for i, k, x in into[j] if j else ():
            walk(i, (k, *ids), w * x)

    walk(len(unit), (), 1.0)
    assert math.log(sum(exact.values())) == pytest.approx(total)
    ids, at = vocabulary.encode([unit] * 30_000, list(range(30_000)))
    seen = collections.Counter(tuple(ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True))
    byte = vocabulary.byte_ids
    spelled = lambda ids: tuple(k for i, c in zip(ids, _chars(vocabulary, ids, unit), strict=True) for k in ([i] if i >= 0 else byte[list(c.encode())].tolist()))
    for way, w in exact.items():
        p = w / sum(exact.values())
        assert abs(seen[spelled(way)] / 30_000 - p) < 5 * math.sqrt(p * (1 - p) / 30_000) + 1e-4


def _chars(vocabulary, ids, unit):
    at, out = 0, []
    for i in ids:
        n = len(vocabulary.bytes[i].decode()) if i >= 0 else 1
        out.append(unit[at : at + n])
        at += n
    return out


def test_op5_digest_and_decoding(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op5_sentencepiece"](spark, small).collect()}
    assert len(got) == docs.count() and all(r.lossless for r in got.values())
    rows = pieces.sampled(docs, PIECES).collect()
    for r in rows[:50]:
        assert hashlib.sha256(np.array(r.pieces, np.int32).tobytes()).hexdigest() == got[r.doc_id].pieces_sha256
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert {r.doc_id: r.text for r in pieces.decoded(pieces.sampled(docs, PIECES), PIECES).collect()} == texts
    odd = spark.createDataFrame([(None, "a b"), (1, None), (1, None), (2, "")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_pieces > 0) for r in pieces.sampled(odd, PIECES).collect()) == [(0, True), (1, False), (1, False), (2, False)]


def test_classifier_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where("doc_id % 2 = 0")
    got = {r.doc_id: r for r in quality.classify(spark, docs, known).collect()}
    assert len(got) == docs.count()
    test = [(r.quality, got[r.doc_id].accepted) for r in labels.where("doc_id % 2 = 1").collect()]
    assert sum((q == 1) == a for q, a in test) >= 0.97 * len(test)
    model = quality.fit(spark, docs, known)[0]
    assert model.handed and sum(map(sum, model.handed)) > 0  # the views did hand labels to each other


def plain_cotraining(t, m, y, pool_t, pool_m, rounds, steps):
    """The same in one piece: every Newton step over labelled and pseudo-labelled rows with weights."""
    kept = np.arange(len(y)) % 4 == 0
    one_hot = lambda p: np.hstack([np.eye(n)[p[:, j]] for j, n in enumerate((quality.SOURCES, quality.LANGUAGES, quality.LENGTHS))])
    given, pool, views = [t.astype(float), one_hot(m)], [pool_t.astype(float), one_hot(pool_m)], []
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30)))

    def newton(z, y, weight, w, ridge, floor):
        penalty = np.append(1e-6, np.full(z.shape[1] - 1, ridge))
        if z.shape[1] == 1 + quality.SHAPES + quality.WORDS + quality.PAIRS:
            penalty[1 + quality.SHAPES :] = ridge * quality.HASHED
        p = sigmoid(z @ w)
        h = (z * (weight * np.maximum(p * (1 - p), floor))[:, None]).T @ z + np.diag(penalty) + 1e-9 * np.eye(len(w))
        move = np.linalg.solve(h, z.T @ (weight * (y - p)) - penalty * w)
        return w + move, np.abs(move).max()

    def settled(z, y, ridge, floor, turns):
        w = np.zeros(z.shape[1])
        for _ in range(turns):
            w, move = newton(z, y, np.ones(len(y)), w, ridge, floor)
            if move < 1e-6:
                break
        return w

    def platt(x, y, ridge):
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale < 1e-9] = 1
        design = lambda v: np.hstack([np.ones((len(v), 1)), np.clip((v - mean) / scale, -8, 8)])
        w = settled(design(x), y, ridge, 0, 30)
        return lambda v: np.clip(design(v) @ w, -30, 30)

    for x in given:
        mean, scale = x[~kept].mean(axis=0), x[~kept].std(axis=0)
        scale[scale < 1e-9] = 1
        views.append(lambda v, mean=mean, scale=scale: np.hstack([np.ones((len(v), 1)), np.clip((v - mean) / scale, -8, 8)]))
    w = [settled(d(x[~kept]), y[~kept], 1.0, quality.FLOOR, 100) for d, x in zip(views, given, strict=True)]
    margin = lambda v, x, w: np.clip(views[v](x) @ w, -30, 30)[:, None]
    scales = [platt(margin(v, given[v][kept], w[v]), y[kept], 1e-3) for v in (0, 1)]

    def least(p, right):
        best = 2.0
        for c in sorted(p[p >= quality.CONFIDENT], reverse=True):
            if (right[p >= c].sum() + 0.5) / ((p >= c).sum() + 1) >= quality.CONFIDENT:
                best = c
        return best

    for _ in range(rounds):
        p = [sigmoid(scales[v](margin(v, pool[v], w[v]))) for v in (0, 1)]
        aside = [sigmoid(scales[v](margin(v, given[v][kept], w[v]))) for v in (0, 1)]
        lows, highs = [1 - least(1 - a, y[kept] == 0) for a in aside], [least(a, y[kept] == 1) for a in aside]
        for _ in range(steps):
            for v in (0, 1):
                sure = [np.flatnonzero(p[1 - v] <= lows[1 - v]), np.flatnonzero(p[1 - v] >= highs[1 - v])]
                share = min((~kept).sum(), sum(map(len, sure)))
                weight = [min(1, share * part / max(len(s), 1)) for s, part in zip(sure, (1 - y.mean(), y.mean()), strict=True)]
                z = np.vstack([views[v](given[v][~kept]), *[views[v](pool[v][s]) for s in sure]])
                label = np.concatenate([y[~kept], *[np.full(len(s), c) for s, c in zip(sure, (0.0, 1.0), strict=True)]])
                w[v], _ = newton(z, label, np.concatenate([np.ones((~kept).sum()), *[np.full(len(s), x) for s, x in zip(sure, weight, strict=True)]]), w[v], 1.0, quality.FLOOR)
        scales = [platt(margin(v, given[v][kept], w[v]), y[kept], 1e-3) for v in (0, 1)]
    both = lambda part: np.stack([scales[v](margin(v, part[v], w[v])) for v in (0, 1)], axis=1)
    mixed = platt(both([x[kept] for x in given]), y[kept], 1e-2)
    return lambda t, m: sigmoid(mixed(both([t.astype(float), one_hot(m)])))


def test_classifier_equals_plain_cotraining(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source", "lang", "n_chars")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    table = docs.toArrow().to_batches()
    t, m = (np.concatenate(x) for x in zip(*[quality._views(b) for b in table], strict=True))
    ids, texts = [r.doc_id for r in docs.collect()], [r.text or "" for r in docs.collect()]
    known = sorted([i for i in ids if labels.get(i) in (0, 1)], key=lambda i: (zlib.crc32(str(i).encode()), i))
    at = {i: n for n, i in enumerate(ids)}
    first = {}
    for n, i in enumerate(ids):
        if i not in labels:
            first.setdefault(texts[n], []).append(n)
    free = [min(ns, key=lambda n: (t[n].tobytes(), m[n].tobytes())) for ns in first.values()]
    mine = [at[i] for i in known]
    score = plain_cotraining(t[mine], m[mine], np.array([float(labels[i]) for i in known]), t[free], m[free], quality.ROUNDS, quality.STEPS)
    want = dict(zip(ids, score(t, m), strict=True))
    got = {r.doc_id: r.score for r in quality.classify(spark, docs, spark.read.parquet(f"{small}/labels.parquet")).collect()}
    assert max(abs(got[i] - want[i]) for i in ids) < 1e-6


def test_a_labelled_id_on_many_rows_gives_one_row_to_the_fit(spark):
    rows = [(1, f"word{i} text", "en", "s", i) for i in range(3000)] + [(2 + i, f"good text number {i}", "en", "s", 20) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"same": __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1), "t": __import__("pyspark.sql.functions", fromlist=["lit"]).lit(2)})
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 30)], "doc_id long, quality int")
    assert len(quality.fit(spark, docs, labels)[0].views[0].y) < 29
    assert quality.classify(spark, docs, labels).count() == len(rows)
    assert quality.accepted(spark, docs, labels).columns == docs.columns


def test_classifier_edge_cases(spark):
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "x " * 50_000, "en", "s", 5), (2, "x", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.accepted for r in quality.classify(spark, docs, none).collect()] == [True] * 4
    assert quality.accepted(spark, docs, none).count() == 4
    odd = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 7)], "doc_id long, quality int")
    assert quality.classify(spark, docs, odd).count() == 4
    assert quality.classify(spark, docs.limit(0), odd).collect() == []


def test_pipeline_stage_by_stage(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    frames = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        frames.append({r.doc_id: r for r in docs.collect()})
        assert n == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    quality_kept, one_each, clean, masked, encoded = frames
    labels = spark.read.parquet(f"{small}/labels.parquet").collect()
    assert all((r.doc_id in quality_kept) == (r.quality == 1) for r in labels)
    sets = {i: _five(r.text) for i, r in quality_kept.items()}
    ids = sorted(sets)
    low = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if b < a and sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                old, new = max(low[a], low[b]), min(low[a], low[b])
                low = {k: new if v == old else v for k, v in low.items()}
    assert set(one_each) == {i for i in ids if low[i] == i}
    items = [_five(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert set(clean) == {i for i in one_each if not any(10 * len(s & sets[i]) >= 8 * len(s) for s in items if s)}
    assert set(masked) == set(clean) == set(encoded)
    vocabulary = pieces.Pieces(PIECES)
    assert all(vocabulary.decode(list(r.pieces)) == masked[i].text for i, r in encoded.items())
    again = {r.doc_id: tuple(r.pieces) for r in corpus_pipeline.run(spark, small).collect()}
    assert again == {i: tuple(r.pieces) for i, r in encoded.items()}


def _five(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_stages_with_odd_rows(spark, small):
    rows = [(1, None, "en", "s", 0), (None, "a b c d e f", "en", "s", 11), (2, "", None, None, None), (3, "a b c d e f", "en", "s", 11), (3, "a b c d e f", "en", "s", 11), (4, "a b c d e f", "en", "s", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.minhash_near_dedup(spark, docs, small).collect()) == [0, 1, 2, 3]
    assert corpus_pipeline.benchmark_decontamination(spark, docs, small).count() == 6
    assert corpus_pipeline.pii_masking(spark, docs, small).count() == 6
    assert corpus_pipeline.sentencepiece_encoding(spark, docs, small).count() == 6
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), small).count() == 0


def test_methods_are_used():
    assert minhash.PERMS * 2 % minhash.ROWS == 0 and contain.PERMS and pii.ROUNDS
