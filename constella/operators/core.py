"""Operators on DataFrames, one for each kind of plan item, lazily declared for Catalyst."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from constella.functions.expressions import aggregate, arithmetic, predicate


def select_rows(df: DataFrame, column: str, kind: str, *values: Any) -> DataFrame:
    return df.where(predicate(F.col(column), kind, values))


def intersect(df: DataFrame, a: Column, b: Column) -> DataFrame:
    return df.where(a & b)


def union(df: DataFrame, a: Column, b: Column) -> DataFrame:
    return df.where(a | b)


def negate(df: DataFrame, a: Column) -> DataFrame:
    return df.where(~a)


def mapped(df: DataFrame, kind: str, a: str, b: str | int | float, to: str, integral: bool = True) -> DataFrame:
    return df.withColumn(to, arithmetic(kind, F.col(a), F.col(b) if isinstance(b, str) else F.lit(b), integral))


def lookup(outer: DataFrame, inner: DataFrame, outer_key: str, inner_key: str, hint: str | None = None) -> DataFrame:
    """Equi-join with unique inner keys; adaptive execution broadcasts a side that turns out small. ``hint``: merge, shuffle_hash."""
    return outer.join(inner.hint(hint) if hint else inner, F.col(outer_key) == F.col(inner_key))


def first_match(outer: DataFrame, inner: DataFrame, key: str, position: str) -> DataFrame:
    """Each outer row meets the inner row of least ``position`` with its key. The minimum is combined before the shuffle."""
    rest = [c for c in inner.columns if c not in (key, position)]
    firsts = inner.groupBy(key).agg(F.min_by(F.struct(*rest), position).alias("r")).select(key, "r.*")
    return outer.join(firsts, key)


def theta(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """A join on any condition; a nested loop where no equality is in it."""
    return left.join(right, condition)


def summarise(df: DataFrame, **aggregates: tuple[str, str]) -> DataFrame:
    """``name=(kind, column)``; over no rows count gives 0 and the others null."""
    return df.agg(*[aggregate(k, F.col(c)).alias(n) for n, (k, c) in aggregates.items()])


def grouped(df: DataFrame, keys: Sequence[str], **aggregates: tuple[str, str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[aggregate(k, F.col(c)).alias(n) for n, (k, c) in aggregates.items()])


def ranked(df: DataFrame, *order: Column, to: str = "place") -> DataFrame:
    """Rows with their place in an order, for small results; the place needs one sequence over all of them."""
    return df.withColumn(to, F.row_number().over(Window.orderBy(*order)))


def ranked_by(df: DataFrame, keys: Sequence[str], *order: Column, to: str = "place") -> DataFrame:
    """Rows with their place among those of equal keys; tables of any size, one sort a partition of keys."""
    return df.withColumn(to, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def windowed_events(events: DataFrame, time: str, width: str, key: str, slide: str | None = None) -> DataFrame:
    return events.groupBy(F.window(time, width, slide or width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def rolled_up(df: DataFrame, keys: Sequence[str], level: str = "level", **aggregates: tuple[str, str]) -> DataFrame:
    """Groups by all prefixes of the keys; ``level`` is the bit mask of the keys that are summed over."""
    return df.rollup(*keys).agg(F.grouping_id().alias(level), *[aggregate(k, F.col(c)).alias(n) for n, (k, c) in aggregates.items()])


def cubed(df: DataFrame, keys: Sequence[str], level: str = "level", **aggregates: tuple[str, str]) -> DataFrame:
    """Groups by all subsets of the keys."""
    return df.cube(*keys).agg(F.grouping_id().alias(level), *[aggregate(k, F.col(c)).alias(n) for n, (k, c) in aggregates.items()])


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], keys: Sequence[str], **aggregates: tuple[str, str]) -> DataFrame:
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(*[aggregate(k, F.col(c)).alias(n) for n, (k, c) in aggregates.items()])


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """Each left row with the ``value`` of the latest right row of its keys at or before its ``time``; null without one, and without a key.

    Both sides are sorted together in one exchange on the keys, so no pairs are made. Of right rows at one time the greatest value counts.
    """
    a = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias(value), F.lit(1).alias("__side"))
    b = right.groupBy(*keys, time).agg(F.max(value).alias(value)).withColumn("__side", F.lit(0))
    order = Window.partitionBy(*keys).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    known = F.last(F.when(F.col("__side") == 0, F.struct(value)), ignorenulls=True).over(order)[value]
    met = F.when(~F.greatest(*[F.col(k).isNull() for k in [*keys, time]], F.lit(False)), known)
    return a.unionByName(b, allowMissingColumns=True).withColumn(value, met).where("__side = 1").drop("__side")


def in_range(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: int) -> DataFrame:
    """Pairs of a whole ``point`` with the ranges ``[low, high]`` that hold it: an equi-join on bins of ``width``, then the exact test.

    A range goes to each bin it touches, so choose ``width`` near the usual length of a range.
    """
    bins = ranges.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return points.withColumn("__bin", F.floor(F.col(point) / width)).join(bins, "__bin").where(F.col(point).between(F.col(low), F.col(high))).drop("__bin")


def sessions(events: DataFrame, time: str, gap: str, key: str) -> DataFrame:
    """Sessions of a key: events less than ``gap`` apart."""
    w = events.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), key, "n")
