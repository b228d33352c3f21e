"""Proportional stratified interleaving into shards, in DataFrame operations only.

Rows are shuffled by a seeded hash and ranked inside their stratum; all rows are then sorted by fractional rank
``(rank - offset) / stratum size``, with a seeded offset in (0, 1) for each stratum, and cut into equal parts, so each shard
holds each stratum in its share of the whole, and strata smaller than the number of shards are spread over all of them.

Equal rows are counted first and ranked as one. No rank is taken over a whole stratum at once: the hash is cut into prefixes, counts by (stratum, prefix) give each piece
its offset, and the rank inside a piece is added. The second order is built likewise from slices of the fractional rank.
A stratum with a third of all rows is thus dealt over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Scratch

PIECE_ROWS = 2000


def interleave(spark: SparkSession, docs: DataFrame, shards: int = 8, seed: int = 42, stratum: str = "source", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, stratum``; sizes in UTF-8 bytes plus 1.

    Law ``rows``: shards hold equal counts, at most one apart; ``slot`` counts from 0 inside a shard in the interleaved order.
    Null text: size 1, crc 0. Null stratum: the stratum ''. Null ids and repeated rows are dealt like others; equal rows
    are interchangeable. Empty table: no rows. Extra columns are ignored.
    """
    scratch = Scratch(spark)
    text = F.coalesce(F.col(text_column), F.lit(""))
    # Rows without an id are told apart by their texts, so that they don't pile up at one place of the order.
    name = F.coalesce(F.col(id_column).cast("string"), F.concat(F.lit("null:"), F.md5(text)))
    own = F.coalesce(F.col(stratum).cast("string"), F.lit(""))
    base = docs.select(F.col(id_column).alias("doc_id"), own.alias("stratum"), F.md5(F.concat(F.lit(f"{seed}:"), name)).alias("key"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    base = scratch.save(base.groupBy(*base.columns).agg(F.count("*").alias("copies")))
    rows = base.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    digits = next((d for d in (1, 2, 3, 4) if 16**d * PIECE_ROWS >= rows), 4)
    pieces = 16 ** max(digits, 2)
    base = base.withColumn("prefix", F.substring("key", 1, digits))
    counts = base.groupBy("stratum", "prefix").agg(F.sum("copies").alias("rows"))
    by = Window.partitionBy("stratum")
    offsets = counts.select("stratum", "prefix", (F.sum("rows").over(by.orderBy("prefix")) - F.col("rows")).alias("before"), F.sum("rows").over(by).alias("whole"))
    offsets = scratch.save(offsets)
    inside = Window.partitionBy("stratum", "prefix").orderBy("key", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.col("before") + F.sum("copies").over(inside)
    offset = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("stratum"))), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    ranked = base.join(offsets, ["stratum", "prefix"]).withColumn("last", last)
    ranked = ranked.withColumn("rank", F.explode(F.sequence(F.col("last") - F.col("copies") + 1, F.col("last"))))
    ranked = ranked.withColumn("place", (F.col("rank") - offset) / F.col("whole")).withColumn("piece", F.floor(F.col("place") * pieces)).drop("prefix", "before", "whole", "copies", "last")
    ranked = scratch.save(ranked)
    # one row for each slice, a bounded number of them
    slices = ranked.groupBy("piece").agg(F.count("*").alias("rows"))
    starts = slices.select("piece", (F.sum("rows").over(Window.orderBy("piece")) - F.col("rows")).alias("before"))
    starts = scratch.save(starts)
    order = Window.partitionBy("piece").orderBy("place", "stratum", "rank")
    at = ranked.join(starts, "piece").withColumn("at", F.col("before") + F.row_number().over(order) - 1)
    at = at.withColumn("shard", F.expr(f"cast((at * {shards}) div {rows} as int)") if rows else F.lit(0))
    return at.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("at") - F.expr(f"(shard * {rows}L + {shards - 1}) div {shards}")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "stratum",
    )


def oracle_sql(shards: int = 8, seed: int = 42) -> str:
    table = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    step = f"xor(c >> 8, CAST({table} AS UBIGINT[])[CAST((xor(c, b) & 255) AS BIGINT) + 1])"
    data = "list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS UBIGINT))"
    crc = f"CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), {data}), lambda c, b: {step}), 4294967295) AS BIGINT)"
    return f"""
WITH base AS (
  SELECT doc_id, coalesce(source, '') AS stratum, md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))) AS key,
         (CAST(CAST('0x' || md5('{seed}:' || coalesce(source, ''))[1:8] AS UBIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE) AS offs,
         CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, text
  FROM documents),
ranked AS (
  SELECT *, (CAST(row_number() OVER (PARTITION BY stratum ORDER BY key, doc_id) AS DOUBLE) - offs) / CAST(count(*) OVER (PARTITION BY stratum) AS DOUBLE) AS place
  FROM base),
dealt AS (
  SELECT *, row_number() OVER (ORDER BY place, stratum, key, doc_id) - 1 AS pos, count(*) OVER () AS n FROM ranked),
cut AS (SELECT *, CAST((pos * {shards}) // n AS INTEGER) AS shard FROM dealt)
SELECT doc_id, size, {crc} AS text_crc32, 'rows' AS law, shard, CAST(pos - (shard * n + {shards - 1}) // {shards} AS BIGINT) AS slot,
       CAST(NULL AS INTEGER) AS grown_shard, stratum
FROM cut"""
