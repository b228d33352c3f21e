"""Column expressions: predicates, arithmetic and aggregates of the plan operators, all inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class UnsupportedOperation(ValueError):
    """A plan asks for something that no operator does."""


COMPARISONS = ("lt", "le", "eq", "ge", "gt", "ne", "between", "in", "like")
ARITHMETIC = ("add", "sub", "mul", "div", "mod")
AGGREGATES = ("count", "sum", "min", "max", "avg")


def like_pattern(pattern: str) -> str:
    """Only ``%`` is a wildcard: ``_`` and the escape character stand for themselves."""
    return pattern.replace("\\", "\\\\").replace("_", "\\_")


def predicate(column: Column, kind: str, values: Sequence[Any]) -> Column:
    """A boolean column. ``between`` includes both bounds; a value that never occurs just never matches."""
    expected = {"between": 2}.get(kind, 1)
    if kind not in COMPARISONS:
        raise UnsupportedOperation(f"predicate {kind}")
    if kind != "in" and len(values) != expected:
        raise UnsupportedOperation(f"predicate {kind} takes {expected} value(s), got {len(values)}")
    match kind:
        case "lt":
            return column < values[0]
        case "le":
            return column <= values[0]
        case "eq":
            return column == values[0]
        case "ge":
            return column >= values[0]
        case "gt":
            return column > values[0]
        case "ne":
            return column != values[0]
        case "between":
            return column.between(values[0], values[1])
        case "in":
            return column.isin(list(values)) if values else F.lit(False)
        case _:
            return column.like(like_pattern(values[0]))


def arithmetic(kind: str, a: Column, b: Column, integral: bool = True) -> Column:
    """Integer division and remainder cut toward zero, the remainder has the dividend's sign; floating division is plain."""
    match kind:
        case "add":
            return a + b
        case "sub":
            return a - b
        case "mul":
            return a * b
        case "div":
            return F.call_function("div", a, b) if integral else a / b
        case "mod":
            if not integral:
                raise UnsupportedOperation("remainder of floating-point columns")
            return a % b
    raise UnsupportedOperation(f"arithmetic {kind}")


def aggregate(kind: str, column: Column) -> Column:
    """``count`` counts rows; sums of integers widen to BIGINT."""
    match kind:
        case "count":
            return F.count(F.lit(1))
        case "sum":
            return F.sum(column)
        case "min":
            return F.min(column)
        case "max":
            return F.max(column)
        case "avg":
            return F.avg(column)
    raise UnsupportedOperation(f"aggregate {kind}")
