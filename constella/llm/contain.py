"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame operations only.

A short item inside a long document has a small Jaccard similarity but a large containment, so the item alone is sketched:
under each of ``PERMS`` permutations its least shingle is drawn, and a document that holds a share ``c`` of the item's
shingles holds each draw with probability ``c``, whatever its own length (containment MinHash, Koslicki and Zabeti 2019).
Items are partitioned by size, as in LSH Ensemble; each class has the share of shingles that its items have to keep at least
(small ones all, as counts are whole), with it the number of draws that must be present, so that an item at the threshold is
missed with probability below ``MISS``, and a least document size, which prunes shorter documents.
An item of fewer than ``k`` words is one shingle of all its words and searched with its own length. Pairs that pass are confirmed by the exact count of shared shingles.

Only sketch entries and candidates meet in joins; Spark broadcasts the sketch when it is small and shuffles otherwise.
"""

from __future__ import annotations

from math import ceil, comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch, beside

PERMS, MISS = 24, 1e-6
LARGEST_CLASS = 24  # sizes are grouped by powers of two up to 2 ** 24


def least_draws(percent: float, draws: int = PERMS, miss: float = MISS) -> int:
    """The greatest count that an item at the threshold falls short of with probability at most ``miss``; 1 at least."""
    c, tail, t = percent / 100, 0.0, 0
    if c >= 1:
        return draws
    while t < draws:
        tail += comb(draws, t) * c**t * (1 - c) ** (draws - t)
        if tail > miss:
            break
        t += 1
    return max(1, t)


def _word_array(text: Column) -> Column:
    return F.split(F.btrim(F.lower(text), F.lit(" \t\n\x0b\f\r")), "[ \\t-\\r]+")


def class_share(number: int, percent: int) -> float:
    """The least share of its shingles that an item with ``2 ** number`` to ``2 ** (number + 1) - 1`` of them has to keep, in percent."""
    sizes = range(2**number, min(2 ** (number + 1), 2**number + 100))
    return min(100 * ceil(n * percent / 100) / n for n in sizes) if number < 7 else percent


def shingles(text: Column, k: int, short: bool = False) -> Column:
    """Hashes of all runs of ``k`` words, lower-cased, as an array; null below ``k`` words, or with ``short`` one of all words."""
    words = _word_array(text)

    def runs(w: Column) -> Column:
        full = F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])))
        for n in range(1, k if short else 1):
            full = full.when((F.size(w) == n) & (F.get(w, F.lit(0)) != ""), F.array(F.xxhash64(*[F.get(w, F.lit(j)) for j in range(n)])))
        return full

    return F.get(F.transform(F.array(words), runs), F.lit(0))  # a bound variable, so that the words are split once


def contained(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Pairs ``doc_id, item_id, shared, item_size``: the document holds at least ``percent`` % of the item's ``k``-word shingles.

    An item of fewer words is one shingle of its own length, which a document holds where the words follow each other.
    Null texts and texts without words hold no shingles and are in no pair, nor are rows without an id. Repeated ids:
    the rows of one id count as one document or item that holds the shingles of all of them. Empty tables: no rows.
    """
    scratch = Scratch(spark)
    item = items.where("item_id is not null").select("item_id", shingles(F.col("text"), k, short=True).alias("all"), F.least(F.size(_word_array(F.col("text"))), F.lit(k)).alias("length"))
    item_rows = scratch.save(item.select("item_id", "length", F.explode("all").alias("shingle")).distinct())
    sizes = item_rows.groupBy("item_id").agg(F.count("*").alias("item_size"), *[F.min_by(F.struct("length", "shingle"), F.xxhash64(F.lit(j), "length", "shingle")).alias(f"d{j}") for j in range(PERMS)])
    sketch = sizes.withColumn("class", F.least(F.floor(F.log2("item_size")), F.lit(LARGEST_CLASS)).cast("int"))
    shares = [class_share(n, percent) for n in range(LARGEST_CLASS + 1)]
    of_class = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("class") + 1)
    # The least size of a document that can hold enough of any item of the class.
    sketch = sketch.withColumn("least", of_class([max(1, ceil(2**n * x / 100)) for n, x in enumerate(shares)])).withColumn("needed", of_class([least_draws(x) for x in shares]))
    sketch = sketch.select("item_id", "least", "needed", F.explode(F.array(*[f"d{j}" for j in range(PERMS)])).alias("d")).select("item_id", "least", "needed", "d.length", "d.shingle")
    sketch = scratch.save(sketch.groupBy("item_id", "least", "needed", "length", "shingle").agg(F.count("*").alias("draws")))
    lengths = sorted(r[0] for r in item_rows.select("length").distinct().collect())  # at most k of them
    scratch_items = scratch.save(sizes.select("item_id", "item_size"))

    def held(rows: DataFrame) -> DataFrame:
        """The shingles of documents, of each length that an item has."""
        out = None
        for n in lengths:
            own = rows.select("doc_id", shingles(F.col("text"), n).alias("all")).where("all is not null")
            own = own.select("doc_id", F.lit(n).alias("length"), F.size("all").alias("size"), F.explode("all").alias("shingle"))
            out = own if out is None else out.union(own)
        return out

    named = docs.where("doc_id is not null").select("doc_id", "text")
    if not lengths:
        return spark.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, shared long, item_size long")
    met = held(named).join(sketch, ["length", "shingle"]).where((F.col("size") >= F.col("least")) | (F.col("length") < k)).select("doc_id", "item_id", "length", "shingle", "draws", "needed").distinct()
    candidates = scratch.save(met.groupBy("doc_id", "item_id").agg(F.sum("draws").alias("draws"), F.first("needed").alias("needed")).where("draws >= needed").select("doc_id", "item_id"))
    wanted = scratch.save(candidates.select("doc_id").distinct())
    again = held(named.join(beside(wanted), "doc_id", "left_semi"))
    shared = again.join(item_rows, ["length", "shingle"]).select("doc_id", "item_id", "length", "shingle").distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))
    exact = shared.join(candidates, ["doc_id", "item_id"], "left_semi").join(scratch_items, "item_id")
    return exact.where(F.col("shared") * 100 >= F.col("item_size") * percent).select("doc_id", "item_id", "shared", "item_size")


def oracle_sql(k: int = 5, percent: int = 80) -> str:
    def worded(table: str, key: str) -> str:
        words = "string_split_regex(trim(lower(text), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[ \\t-\\r]+')"
        return f"SELECT {key}, list_filter({words}, lambda x: x <> '') AS w FROM {table} WHERE {key} IS NOT NULL AND text IS NOT NULL"

    runs = "SELECT DISTINCT {key}, {n} AS n, unnest(list_transform(range(len(w) - {n} + 1), lambda i: array_to_string(w[i + 1:i + {n}], ' '))) AS shingle FROM {table} WHERE len(w) >= {n}"
    held = " UNION ALL ".join(runs.format(key="doc_id", n=n, table="dw") for n in range(1, k + 1))
    return f"""
WITH dw AS ({worded("documents", "doc_id")}),
iw AS ({worded("benchmark", "item_id")}),
i AS ({runs.format(key="item_id", n=k, table="iw")} UNION ALL SELECT DISTINCT item_id, len(w) AS n, array_to_string(w, ' ') AS shingle FROM iw WHERE len(w) BETWEEN 1 AND {k - 1}),
d AS ({held}),
n AS (SELECT item_id, count(*) AS item_size FROM i GROUP BY item_id),
s AS (SELECT doc_id, item_id, count(*) AS shared FROM d JOIN i USING (n, shingle) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, shared, item_size FROM s JOIN n USING (item_id) WHERE shared * 100 >= item_size * {percent}"""
