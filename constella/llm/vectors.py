"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, rerank on the vectors themselves.

Rotations are learned on a bounded sample (``SAMPLE`` vectors in hash order) so that the signs of rotated vectors make
balanced codes of small quantisation loss (Gong and Lazebnik 2011). Codes are cut into substrings; each substring position is
a hash table, and two vectors meet where a substring is equal. A pair at the threshold agrees in a bit with probability
``1 - acos(threshold) / pi``; the substring length follows the number of vectors, and as many tables are made as give the
wanted recall at the threshold itself. All vectors are indexed; met pairs count only when their cosine in double precision
reaches the threshold.

Equal vectors are one class from the start. Buckets beyond ``BLOCK`` members are dealt over pairs of blocks. First only
``SHORT`` bits of the codes are dealt, and rows go on that are within a wide Hamming bound of another in their bucket; only
those meet the whole codes and the vectors, so a row of a table has a fixed size. No
pair leaves a task: a task gives, for each vector, how many new links it has there and the least vector of its local
component. A pair that meets in several tables counts in the first of them only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .minhash import CLOSURE_SQL
from .runs import fixed, runs
from .store import Scratch, components

SAMPLE, ITERATIONS, BLOCK, RECALL, SHORT = 10_000, 30, 256, 0.985, 256


def learn_rotations(x: np.ndarray, count: int, seed: int = 7) -> list[np.ndarray]:
    """Orthogonal matrices, each from another random start, that fit the signs of the rotated rows best."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    _, basis = np.linalg.eigh(x.T @ x)
    v = x @ basis
    out = []
    for _ in range(count):
        r, _ = np.linalg.qr(rng.standard_normal((d, d)))
        for _ in range(ITERATIONS if len(x) else 0):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        out.append(basis @ r)
    return out


def plan(vectors: int, dims: int, threshold: float) -> tuple[int, int]:
    """Bits of a substring, and the number of tables."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = max(1, min(dims, 30, round(math.log2(max(vectors, 2))) - 3))
    return bits, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - agree**bits)))


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All components end to end, each vector scaled to length 1; offsets of the vectors; which of them can be linked."""
    sizes = np.array(pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    of = np.concatenate([[0], np.cumsum(sizes)])
    flat = column.flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # a null component becomes NaN
    good = sizes > 0
    if good.any():
        first = of[:-1][good]
        most = np.maximum.reduceat(np.abs(values), first)
        good[good] = np.isfinite(most) & (most > 0)
        scale = np.ones(len(sizes))
        scale[sizes > 0] = np.where(np.isfinite(most) & (most > 0), most, 1)
        values = values / np.repeat(scale, sizes)
        length = np.ones(len(sizes))
        length[sizes > 0] = np.sqrt(np.add.reduceat(values * values, first))
        length[~good] = 1
        values = values / np.repeat(length, sizes)
    return values, of, good


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector scaled to length 1, as bytes; null where it can't be linked."""
    for b in batches:
        values, of, good = _units(b.column("embedding"))
        unit = [values[i:j].tobytes() if g else None for i, j, g in zip(of[:-1], of[1:], good, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(unit, pa.binary()), pa.array(np.diff(of).astype(np.int32))], names=["vec_id", "unit", "dims"])


def _coder(rotations: list[np.ndarray], dims: int, bits: int, tables: int):
    each = max(1, dims // bits)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                x = fixed(pa.chunked_array([b.column("unit")]), np.float64, dims)
                signs = np.hstack([((x @ r) >= 0)[:, : each * bits] for r in rotations])[:, : tables * bits]
                codes, keys = np.packbits(signs, axis=1), _keys(signs, bits)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("weight"), b.column("unit"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([c.tobytes() for c in codes[:, : SHORT // 8]], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables), pa.array(keys.reshape(-1)))],
                    names=["id", "weight", "unit", "codes", "short", "list"],
                )

    return code


def _keys(signs: np.ndarray, bits: int) -> np.ndarray:
    """The key of each vector in each table."""
    return (signs.reshape(len(signs), -1, bits) @ (1 << np.arange(bits)).astype(np.int64)).astype(np.int32)


def _sides(run: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    p, q = run.column("p")[0].as_py(), run.column("q")[0].as_py()
    block = run.column("block").to_numpy()
    left = np.flatnonzero(block == p)
    return left, left if p == q else np.flatnonzero(block == q)


def _likely(bits: int, tables: int, threshold: float):
    """The rows of each run whose code is near that of another row."""
    total, differ = min(SHORT, bits * tables), math.acos(threshold) / math.pi
    most = total * differ + 9 * math.sqrt(total * differ * (1 - differ))  # bits of one pair are not independent
    width = (total + 7) // 8

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, ["table", "key", "p", "q"]):
            if run.num_rows < 2:
                continue
            codes = fixed(run.column("short"), np.uint8, width)
            left, right = _sides(run)
            keep = np.zeros(run.num_rows, dtype=bool)
            for i in left:
                r = right[right > i] if left is right else right
                r = r[np.bitwise_count(codes[r] ^ codes[i]).sum(axis=1, dtype=np.int64) <= most]
                if len(r):
                    keep[i] = keep[r] = True
            if keep.any():
                yield from run.drop_columns(["short"]).filter(pa.array(keep)).combine_chunks().to_batches()

    return near


def _joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index of each item's component under the links ``(i, j)``."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def _linker(dims: int, bits: int, tables: int, threshold: float):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_out, links_out, least_out = [], [], []
        for run in runs(batches, ["table", "key", "p", "q"]):
            if run.num_rows < 2:
                continue
            t, ids = run.column("table")[0].as_py(), run.column("id").to_numpy()
            run = run.take(pa.array(np.argsort(ids)))
            ids, weight = run.column("id").to_numpy(), run.column("weight").to_numpy()
            x, codes = fixed(run.column("unit"), np.float64, dims), fixed(run.column("codes"), np.uint8, (bits * tables + 7) // 8)
            keys = _keys(np.unpackbits(codes, axis=1, count=bits * tables), bits)
            left, right = _sides(run)
            i, j = np.nonzero(x[left] @ x[right].T >= threshold)
            i, j = left[i], right[j]
            once = i < j if left is right else np.ones(len(i), dtype=bool)
            i, j = i[once], j[once]
            if t:
                new = ~(keys[i, :t] == keys[j, :t]).any(axis=1)
                i, j = i[new], j[new]
            if not len(i):
                continue
            n = len(ids)
            links = np.bincount(i, weights=weight[j], minlength=n) + np.bincount(j, weights=weight[i], minlength=n)
            least = ids[_joined(n, i, j)]
            has = links > 0
            ids_out.append(ids[has]), links_out.append(links[has].astype(np.int64)), least_out.append(least[has])
            if len(ids_out) > 500:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids_out, links_out, least_out)], names=["id", "links", "least"])
                ids_out, links_out, least_out = [], [], []
        if ids_out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids_out, links_out, least_out)], names=["id", "links", "least"])

    return link


def near_vectors(spark: SparkSession, vectors: DataFrame, threshold: float = 0.9, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row a vector: ``vec_id, n_links, component_id, kept``.

    Null, empty or zero vectors and those with null or non-finite components link with nothing. Vectors of different
    lengths don't link; each length is indexed by itself, so a table has few of them. A null id: its row stays, without
    links, component null. Repeated ids: a row each, and each counts as a vector with its own links and component. Empty
    table: no rows. Extra columns are ignored.
    """
    scratch = Scratch(spark)
    packed = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("embedding")).mapInArrow(_packer, "vec_id long, unit binary, dims int")
    packed = scratch.save(packed.withColumns({"h1": F.xxhash64("unit"), "h2": F.xxhash64("unit", F.lit(1))}))
    usable = packed.where("vec_id is not null and unit is not null")
    # A class is all rows with one unit vector; its number is made as the table is written.
    classes = usable.groupBy("dims", "unit").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("h1").alias("h1"), F.first("h2").alias("h2"))
    classes = scratch.save(classes.withColumn("id", F.monotonically_increasing_id()))
    found = spark.createDataFrame([], "id long, links long, least long")
    for dims, count in sorted((r[0], r[1]) for r in classes.groupBy("dims").count().collect()):
        own = classes.where(F.col("dims") == dims)
        bits, tables = plan(count, dims, threshold)
        sample = own.select("unit", F.xxhash64("unit").alias("o")).orderBy("o", "unit").limit(SAMPLE).select("unit").toArrow()
        x = fixed(sample.column("unit"), np.float64, dims)
        rotations = learn_rotations(x, math.ceil(tables / max(1, dims // bits)))
        coded = scratch.save(own.select("id", "weight", "unit").mapInArrow(_coder(rotations, dims, bits, tables), "id long, weight long, unit binary, codes binary, short binary, list array<int>"))
        sizes = coded.select(F.posexplode("list").alias("table", "key")).groupBy("table", "key").agg(F.count("*").alias("size")).where("size > 1")
        sizes = scratch.save(sizes.select("table", "key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
        met = coded.select("id", "short", F.posexplode("list").alias("table", "key")).join(sizes, ["table", "key"])
        met = met.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        met = met.select("table", "key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "id", "short")
        side_by_side = lambda df: df.repartition("table", "key", "p", "q").sortWithinPartitions("table", "key", "p", "q")
        likely = scratch.save(side_by_side(met).mapInArrow(_likely(bits, tables, threshold), "table int, key int, p int, q int, block int, id long"))
        met = side_by_side(likely.join(coded.select("id", "weight", "unit", "codes"), "id"))
        found = found.union(scratch.save(met.mapInArrow(_linker(dims, bits, tables, threshold), "id long, links long, least long")))
        scratch.drop(likely, coded, sizes)
    joined = scratch.save(components(scratch, found.select(F.col("id").alias("a"), F.col("least").alias("b"))))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = classes.drop("unit").join(links, "id", "left").join(joined, classes.id == joined.node, "left")
    known = scratch.save(known.select("h1", "h2", "dims", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("part")))
    known = known.join(known.groupBy("part").agg(F.min("least").alias("component")), "part").select("h1", "h2", "dims", "n_links", "component")
    out = packed.withColumn("live", F.col("vec_id").isNotNull() & F.col("unit").isNotNull()).select("vec_id", "live", "h1", "h2", "dims").join(known, ["h1", "h2", "dims"], "left")
    component = F.when(F.col("live"), F.col("component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("live"), F.col("n_links")).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def oracle_sql(threshold: float = 0.9) -> str:
    return f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(e, lambda x: abs(x))) > 0),
link AS (SELECT x.id AS a, y.id AS b FROM u x JOIN u y ON x.id <> y.id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= {threshold}),
{CLOSURE_SQL},
c AS (SELECT id, least(id, min(other)) AS component FROM reach GROUP BY id),
l AS (SELECT a, count(*) AS links FROM link GROUP BY a)
SELECT v.id AS vec_id, coalesce(l.links, 0) AS n_links, coalesce(c.component, v.id) AS component_id, coalesce(c.component, v.id) = v.id AS kept
FROM v LEFT JOIN l ON l.a = v.id LEFT JOIN c ON c.id = v.id"""
