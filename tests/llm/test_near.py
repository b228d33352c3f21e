"""Near-duplicates of texts and vectors against brute force."""

import numpy as np
import pytest

from constella.llm import minhash, vectors
from constella.llm.queries import ORACLE_SQL, QUERIES
from constella.llm.store import Scratch, components


def closure(ids, links):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def expected(rows, k):
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    ids = list(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[:x] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c, c == i) for i, c in closure(ids, links).items()}


@pytest.mark.parametrize("name", ["op1_minhash_near_dedup", "op4_embedding_near_dedup"])
def test_query_equals_its_sql(spark, small, oracle, answer, name):
    assert answer(QUERIES[name](spark, small)) == oracle(ORACLE_SQL[name])


def test_edge_cases_and_a_hot_group(spark):
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(0, 5000)}"
    base = [word() for _ in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):  # near copies, many of them close to the base alone
        w = list(base)
        for _ in range(rng.integers(1, 6)):
            w[rng.integers(0, len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base[:60])) for i in range(50)]
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "one two"), (2004, "ONE  two"), (2005, "one two three"), (2006, "x " * 5000), (2007, "x " * 4000), (2008, "Été " + " ".join(base[:8])), (2009, "été " + " ".join(base[:8])), (None, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"component": __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1)})
    got = minhash.near_duplicates(spark, df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == expected(rows, 4)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_very_long_texts(spark):
    long = " ".join(f"w{i % 70_000}" for i in range(300_000))
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, "x" * 2_000_000), (4, "x" * 2_000_000)], "doc_id long, text string")
    assert sorted(map(tuple, minhash.near_duplicates(spark, df).collect())) == [(1, 70_000, 1, True), (2, 70_001, 1, False), (3, 1, 3, True), (4, 1, 3, False)]


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    assert sorted(tuple(r) for r in minhash.near_duplicates(spark, df).collect()) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    assert minhash.near_duplicates(spark, df.limit(0)).collect() == []
    assert vectors.near_vectors(spark, spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def brute_rows(rows, linked):
    """For each row the least id of its component: rows are linked by their values or by an equal id."""
    low = closure(range(len(rows)), [(a, b) for a in range(len(rows)) for b in range(a) if rows[a][0] == rows[b][0] or linked(rows[a][1], rows[b][1])])
    least = {}
    for n, (i, _) in enumerate(rows):
        least[low[n]] = min(i, least.get(low[n], i))
    return [least[low[n]] for n in range(len(rows))]


def test_one_id_on_different_texts(spark):
    rng = np.random.default_rng(9)
    word = lambda: f"w{rng.integers(0, 9000)}"
    bases = [[word() for _ in range(60)] for _ in range(12)]
    rows = []
    for n in range(300):
        w = list(bases[n % 12])
        for _ in range(rng.integers(0, 5)):
            w[rng.integers(0, 60)] = word()
        rows.append((int(rng.integers(0, 200)) if n % 3 else n, " ".join(w)))
    rows += [(5, bases[0][0]), (5, " ".join(bases[1][:30])), (6, " ".join(bases[1][:30])), (8, " ".join(bases[1][:29])), *[(77, f"{i} a b c d e") for i in range(40)]]
    similar = lambda x, y: 100 * len(shingles(x, 4) & shingles(y, 4)) >= 80 * len(shingles(x, 4) | shingles(y, 4))
    want = sorted((i, len(shingles(t, 4)), c, c == i) for (i, t), c in zip(rows, brute_rows(rows, similar), strict=True))
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert sorted(tuple(r)[:4] for r in minhash.near_duplicates(spark, df).collect()) == want


def test_one_id_on_different_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((80, 32))
    x[1::4] = x[::4] + 0.03 * rng.standard_normal((20, 32))
    rows = [(5, x[0]), (5, x[4]), (6, x[1]), (7, x[5]), *[(100 + i // 2, x[i]) for i in range(8, 80)], (100, x[8])]
    got = vectors.near_vectors(spark, spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>").repartition(3)).collect()
    u = np.stack([v / np.linalg.norm(v) for _, v in rows])
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    low = closure(range(len(rows)), np.argwhere(near))
    least = {c: min(rows[n][0] for n in low if low[n] == c) for c in set(low.values())}
    assert sorted(map(tuple, got)) == sorted((i, int(near[n].sum()), least[low[n]], least[low[n]] == i) for n, (i, _) in enumerate(rows))


def test_null_components_and_rows_without_id(spark):
    rows = [(1, [1.0, None]), (2, [1.0, 2.0]), (3, [2.0, 4.0]), (None, [1.0, 2.0]), (4, None), (5, [])]
    got = vectors.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in got) == [(0, 0, None, True), (1, 0, 1, True), (2, 1, 2, True), (3, 1, 2, False), (4, 0, 4, True), (5, 0, 5, True)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    got = dict(map(tuple, components(Scratch(spark), spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}}


def test_vectors_recall_hot_group_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 48))
    hot = rng.standard_normal(48)
    x[:600] = hot + 0.12 * rng.standard_normal((600, 48))  # a group larger than a block
    for i in range(700, 1100, 2):  # pairs close to the threshold
        d = x[i] / np.linalg.norm(x[i])
        e = rng.standard_normal(48)
        e -= (e @ d) * d
        c = rng.uniform(0.9, 0.93)
        x[i + 1] = c * d + np.sqrt(1 - c * c) * e / np.linalg.norm(e)
    x[1200] = x[1201] * 3
    x[1202] = x[1203]
    bad = [None, [], [0.0] * 48, [float("nan")] * 48, [float("inf")] + [1.0] * 47, [1.0] * 20]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(5000 + i, v, 1) for i, v in enumerate(bad)]
    got = {r.vec_id: r for r in vectors.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int")).collect()}
    assert len(got) == len(rows)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    links = np.array([got[i].n_links for i in range(len(x))])
    assert (links <= near.sum(axis=1)).all() and links.sum() >= 0.9 * near.sum()
    assert got[1201].component_id == 1200 and got[1203].n_links == near[1203].sum()
    low = closure(range(len(x)), np.argwhere(near))
    assert np.mean([got[i].component_id == low[i] for i in range(len(x))]) > 0.95
    assert all(got[5000 + i].n_links == 0 and got[5000 + i].kept for i in range(len(bad)))
