"""Near-duplicate documents by min-max hashing.

Each permutation gives two signature values, the least and the greatest permuted shingle, so a signature of ``2 * PERMS``
values costs ``PERMS`` evaluations a shingle (Ji et al. 2013). Bands of ``ROWS`` values make buckets. In every bucket all
members are first compared with one of them, the one that shares buckets with most others, on full shingle sets; only buckets whose members still lie in several
components go on, in blocks, to a comparison of wide signatures whose survivors are compared on full sets again. There the
members outside the first one's component meet all others; those inside meet none of their own.

Rows with equal shingle sets are one class from the start, so copies are never paired with each other; all links join classes.
Missing pairs: at similarity 0.8 a pair shares no band with probability (1 - 0.8**4)**24 < 4e-6, and is lost by the wide
signature with less than 1e-6; no other step drops a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runs import fixed, runs
from .store import Scratch, beside, components
from .words import mix, shingle_hashes, slices, word_hashes

PERMS, ROWS = 48, 4
WIDE = 256  # permutations of the wide signature: twice as many values
BLOCK = 256  # members of a bucket that one task compares with as many others
_RNG = np.random.default_rng(77)
_A = _RNG.integers(0, 2**64, WIDE, dtype=np.uint64) | np.uint64(1)


def _min_max(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Minima then maxima under ``n`` permutations; a row for each text that has shingles."""
    first = at[:-1][np.diff(at) > 0]
    out = np.empty((len(first), 2 * n), dtype=np.uint32)
    for j in range(n):
        v = ((h ^ (h >> np.uint64(29 + j % 7))) * _A[j]) >> np.uint64(32)
        out[:, j] = np.minimum.reduceat(v, first)
        out[:, n + j] = np.maximum.reduceat(v, first)
    return out


def _bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; a band holds the minimum and the maximum under each of ``ROWS // 2`` permutations."""
    s, half, n = signature.astype(np.uint64), ROWS // 2, signature.shape[1] // 2
    out = np.empty((len(s), 2 * PERMS // ROWS), np.uint64)
    for j in range(out.shape[1]):
        v = np.full(len(s), j + 1, np.uint64)
        for c in range(half * j, half * (j + 1)):
            v = mix(mix(v + s[:, c]) + s[:, n + c])
        out[:, j] = v
    return out


def _distinct(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    return (np.concatenate(parts) if parts else h), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _sketcher(k: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                h, at = _distinct(*shingle_hashes(*word_hashes(b.column("text")), k))
                n = np.diff(at)
                has = n > 0
                one, two = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                bands = np.zeros((len(n), 2 * PERMS // ROWS), np.uint64)
                if has.any():
                    first = at[:-1][has]
                    one[has], two[has] = np.add.reduceat(mix(h + np.uint64(1)), first), np.add.reduceat(mix(h ^ np.uint64(0x5BD1E995)), first)
                    bands[has] = _bands(_min_max(h, at, PERMS))
                at_bands = pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands.shape[1])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("same"), pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.ListArray.from_arrays(at_bands, pa.array(bands.reshape(-1).view(np.int64)))], names=["doc_id", "same", "n", "one", "two", "bands"])

    return sketch


def _setter(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                h, at = _distinct(*shingle_hashes(*word_hashes(b.column("text")), k))
                has = np.flatnonzero(np.diff(at))
                signature = _min_max(h, at, WIDE) if len(h) else np.zeros((0, 2 * WIDE), np.uint32)
                wide = (mix(signature.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)
                columns = [b.column("id").take(pa.array(has)), *(pa.array([x.tobytes() for x in c], pa.binary()) for c in ([h[at[i] : at[i + 1]] for i in has], wide, _bands(signature)))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "items", "wide", "bands"])

    return sets


def _linker(percent: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(b.column("x"), b.column("y"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = _shared(x, y)
                    keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return linked


def _likely(percent: int):
    """Gives the pairs of a run that may be linked, lie in different components, and meet in no band before this one."""
    # an estimate lies below this with probability under 1e-6 when the similarity is at the threshold
    t = percent / 100
    least = (t - 5.2 * (t * (1 - t) / (2 * WIDE)) ** 0.5) * 2 * WIDE

    def pairs(run: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
        comp, n, side = (run.column(c).to_numpy() for c in ("component", "n", "block"))
        wide, bands = fixed(run.column("wide"), np.uint8, 2 * WIDE), fixed(run.column("bands"), np.int64, 2 * PERMS // ROWS)
        key, p, q = (run.column(c)[0].as_py() for c in ("key", "p", "q"))
        band = int(np.flatnonzero(bands[0] == key)[0])
        left = np.flatnonzero(side == p)
        right = left if p == q else np.flatnonzero(side == q)
        for i in left:
            r = right[(comp[right] != comp[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
            if p == q:
                r = r[r > i]
            r = r[(wide[r] == wide[i]).sum(axis=1) >= least]
            if band:
                r = r[~(bands[r, :band] == bands[i, :band]).any(axis=1)]
            if len(r):
                yield int(i), r

    return pairs


def _open(percent: int):
    """The rows of each run that are in a likely pair."""
    likely = _likely(percent)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, ["key", "p", "q"]):
            if run.num_rows > 1:
                keep = np.zeros(run.num_rows, dtype=bool)
                for i, r in likely(run):
                    keep[i] = keep[r] = True
                if keep.any():
                    yield from run.select(["key", "p", "q", "id", "n", "component", "block"]).filter(pa.array(keep)).to_batches()

    return rows


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many items two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _closer(percent: int):
    """Links each run's likely pairs whose full sets agree; at most one link a row leaves a run."""
    likely = _likely(percent)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, ["key", "p", "q"]):
            ids = run.column("id").to_numpy()
            items = [np.frombuffer(x.as_buffer(), np.uint64) for x in run.column("items")]
            label = np.arange(len(ids))
            for i, r in likely(run):
                for j in r:
                    if label[i] != label[j]:
                        both = _shared(items[i], items[j])
                        if 100 * both >= percent * (len(items[i]) + len(items[j]) - both):
                            label[label == label[j]] = label[i]
            other = np.flatnonzero(label != np.arange(len(ids)))
            if len(other):
                yield pa.RecordBatch.from_arrays([pa.array(ids[label[other]]), pa.array(ids[other])], names=["a", "b"])

    return links


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = 4, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a document: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked when 100 * |A & B| >= percent * |A | B| over their sets of ``k``-word shingles.
    Null or wordless texts: an empty set, linked with nothing, kept. Fewer than ``k`` words: one shingle. A null id: its row
    stays, with a null component, kept. Rows that share an id are the same document: each keeps its own set and its own
    links, and all of them lie in one component. Extra columns are ignored. Empty table: no rows.
    """
    scratch = Scratch(spark)
    text = F.col(text_column)
    given = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("same"), text.alias("text"))
    sketch = scratch.save(given.mapInArrow(_sketcher(k), "doc_id long, same long, n long, one long, two long, bands array<long>"))
    full = sketch.where("n > 0 and doc_id is not null")
    # A class is all rows with one set. Its number is made as the table is written, and ids may lie in several classes.
    classes = full.groupBy("one", "two", "n").agg(F.min(F.struct("doc_id", "same", "bands")).alias("r"))
    classes = scratch.save(classes.select("one", "two", "n", "r.*", F.monotonically_increasing_id().alias("id")))
    banded = classes.select("id", "n", F.explode("bands").alias("key"))
    buckets = scratch.save(banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    members = scratch.save(banded.join(buckets, "key"))
    # The member that meets most others stands nearest to the middle of its bucket, so most of the bucket hangs on it.
    met = members.groupBy("id").agg(F.sum("size").alias("met"))
    middle = F.max(F.struct("met", F.negate("id").alias("last"))).alias("m")
    pivots = scratch.save(members.join(met, "id").groupBy("key").agg(middle).select("key", F.negate("m.last").alias("pivot")))
    # Text of the candidates alone is read again, one row for each class, so the join splits nowhere hot.
    wanted = scratch.save(members.select("id").distinct().join(classes.select("id", "doc_id", "same"), "id"))
    again = given.where("doc_id is not null").join(beside(wanted), ["doc_id", "same"]).select("id", "text")
    sets = scratch.save(again.mapInArrow(_setter(k), "id long, items binary, wide binary, bands binary").dropDuplicates(["id"]))

    x, y = (sets.select(F.col("id").alias(i), F.col("items").alias(v)) for i, v in (("a", "x"), ("b", "y")))
    stars = scratch.save(members.join(pivots, "key").where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct())
    links = scratch.save(stars.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_linker(percent), "a long, b long"))
    found = scratch.save(components(scratch, links))
    open_ = members.join(found, members.id == found.node, "left").select("key", "id", "n", "size", F.coalesce("component", "id").alias("component"))
    # Members of the pivot's component need no comparison with each other, only with those outside it.
    inside = pivots.join(found, pivots.pivot == found.node, "left").select("key", F.coalesce("component", "pivot").alias("main"))
    outside = F.col("component") != F.col("main")
    open_ = scratch.save(open_.join(inside, "key").select("key", "id", "n", "size", "component", outside.alias("outside")))
    parts = scratch.save(open_.groupBy("key").agg(F.count_if("outside").alias("outer")).where("outer > 0"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    dealt = (
        open_.join(parts, "key")
        .withColumn("apart", blocks(F.col("outer")))
        .withColumn("rest", blocks(F.col("size") - F.col("outer")))
        .withColumn("block", F.when(F.col("outside"), F.pmod(F.xxhash64("id"), "apart")).otherwise(F.col("apart") + F.pmod(F.xxhash64("id"), "rest")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("apart") - 1 + F.when(F.col("outside"), F.col("rest")).otherwise(0))))
        .select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "id", "n", "component", "block")
    )
    side_by_side = lambda df: df.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    likely = side_by_side(dealt.join(sets.select("id", "wide", "bands"), "id")).mapInArrow(_open(percent), "key long, p int, q int, id long, n long, component long, block int")
    likely = scratch.save(likely)
    more = scratch.save(side_by_side(likely.join(sets, "id")).mapInArrow(_closer(percent), "a long, b long"))
    scratch.drop(open_, parts, members, buckets, pivots, sets, wanted, stars, likely)
    # Rows of one id with different sets: their classes belong together.
    lowest, highest = (f(F.struct("one", "two", "n")) for f in (F.min, F.max))
    repeated = scratch.save(full.groupBy("doc_id").agg(lowest.alias("lo"), highest.alias("hi")).where("lo <> hi").select("doc_id"))
    several = full.join(repeated, "doc_id", "left_semi").select("doc_id", "one", "two", "n").distinct().join(classes.select("one", "two", "n", "id"), ["one", "two", "n"])
    several = scratch.save(several.select("doc_id", "id"))
    together = several.join(several.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").select("a", F.col("id").alias("b"))
    final = scratch.save(components(scratch, found.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).union(more).union(together)))
    scratch.drop(links, more, found, repeated, several)
    by_set = classes.join(final, classes.id == final.node, "left").select("one", "two", "n", "doc_id", F.coalesce("component", "id").alias("component"))
    lowest = by_set.groupBy("component").agg(F.min("doc_id").alias("least"))
    by_set = scratch.save(by_set.join(lowest, "component").select("one", "two", "n", "least"))
    scratch.drop(classes, final)
    own = sketch.select("doc_id", "one", "two", "n").join(by_set, ["one", "two", "n"], "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("least", "doc_id"))
    return own.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


#: Links and their closure, for a query that ends in ``SELECT``; wants ``n(id, size)`` and ``link(a, b)`` with both directions.
CLOSURE_SQL = "reach(id, other) AS (SELECT a, b FROM link UNION SELECT reach.id, link.b FROM reach JOIN link ON reach.other = link.a)"


def oracle_sql(k: int = 4, percent: int = 80) -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = f"list_filter(string_split_regex(translate(text, '{letters}', '{letters.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    runs = f"CASE WHEN len(w) >= {k} THEN list_transform(range(len(w) - {k - 1}), lambda i: array_to_string(w[i + 1:i + {k}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {words} AS w FROM documents),
s AS (SELECT DISTINCT doc_id AS id, unnest({runs}) AS shingle FROM w),
n AS (SELECT id, count(*) AS size FROM s GROUP BY id),
p AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM s x JOIN s y USING (shingle) WHERE x.id <> y.id GROUP BY ALL),
link AS (SELECT a, b FROM p JOIN n x ON a = x.id JOIN n y ON b = y.id WHERE 100 * shared >= {percent} * (x.size + y.size - shared)),
{CLOSURE_SQL},
c AS (SELECT id, least(id, min(other)) AS component FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.size, 0) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id, coalesce(c.component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.id = d.doc_id LEFT JOIN c ON c.id = d.doc_id"""
