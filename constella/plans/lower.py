"""A plan lowered to one lazy DataFrame.

Position lists never become row ids. A *frame* is a symbolic relation; a data column is an expression over a frame, a
position list says that the rows of one frame are rows of another. Filters and joins keep the columns below them, so moving a
column along a position list leaves its expression as it is, and early and late materialisation give the same DataFrame.
Catalyst prunes what no result needs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from constella.functions.expressions import UnsupportedOperation, aggregate, arithmetic, predicate
from constella.plans import ir
from constella.plans.validate import require, topological

Resolver = Callable[[str], DataFrame]


@dataclass(frozen=True)
class Expr:
    """``col`` name, ``map`` of two expressions, or ``lit``; equal when written equally."""

    kind: str
    args: tuple[Any, ...]

    def column(self, integral: Callable[[Expr], bool]) -> Column:
        if self.kind == "col":
            return F.col(self.args[0])
        if self.kind == "lit":
            return F.lit(self.args[0])
        op, a, b = self.args
        return arithmetic(op, a.column(integral), b.column(integral), integral(a) and integral(b))


@dataclass(eq=False)
class Frame:
    build: Callable[[], DataFrame]
    #: For a predicate frame: what it filters, and the predicate.
    source: Frame | None = None
    keep: Callable[[], Column] | None = None
    #: For groups: key expressions, and expressions taken from the first row of a group.
    keys: list[Expr] = field(default_factory=list)
    firsts: list[Expr] = field(default_factory=list)
    tables: frozenset[str] = frozenset()
    _df: DataFrame | None = None

    @property
    def df(self) -> DataFrame:
        if self._df is None:
            self._df = self.build()
        return self._df

    def integral(self, e: Expr) -> bool:
        if e.kind == "col":
            return isinstance(self.df.schema[e.args[0]].dataType, T.IntegralType)
        if e.kind == "lit":
            return isinstance(e.args[0], int)
        return all(self.integral(x) for x in e.args[1:])

    def column(self, e: Expr) -> Column:
        return e.column(self.integral)


@dataclass(frozen=True)
class Data:
    frame: Frame
    expr: Expr


@dataclass(frozen=True)
class Positions:
    """Rows of ``frame`` are rows of ``target``."""

    frame: Frame
    target: Frame
    order: tuple[tuple[Expr, bool], ...] = ()


class Lowering:
    def __init__(self, resolve: Resolver, first_match: bool = False):
        self.resolve, self.first_match = resolve, first_match
        self.known: dict[str, Data | Positions] = {}
        self.base: dict[str, Frame] = {}
        self.n = 0

    def _name(self) -> str:
        self.n += 1
        return f"c{self.n}"

    def _base(self, table: str) -> Frame:
        if table not in self.base:
            df = self.resolve(table)
            self.base[table] = Frame(lambda: df.select(*[F.col(c).alias(f"{table}__{c}") for c in df.columns]), tables=frozenset([table]))
        return self.base[table]

    def get(self, c: ir.Col) -> Data | Positions:
        if c.base:
            return Data(self._base(c.table), Expr("col", (f"{c.table}__{c.name}",)))
        if c.full not in self.known:
            raise UnsupportedOperation(f"{c.full} is not known")
        return self.known[c.full]

    def data(self, c: ir.Col) -> Data:
        if not isinstance(found := self.get(c), Data):
            raise UnsupportedOperation(f"{c.full} is a position list; its values are not data")
        return found

    def positions(self, c: ir.Col) -> Positions:
        if not isinstance(found := self.get(c), Positions):
            raise UnsupportedOperation(f"{c.full} is no position list")
        return found

    def step(self, item: ir.Item) -> None:
        match item:
            case ir.Filter():
                d = self.data(item.input)
                self._select(item.output, d.frame, lambda: predicate(d.frame.column(d.expr), item.kind, item.values))
            case ir.SetOp():
                a = self.positions(item.left)
                b = self.positions(item.right) if item.right else a
                if a.target is not b.target or not a.frame.keep or not b.frame.keep:
                    raise UnsupportedOperation(f"item {item.id}: position lists of different rows")
                p, q = a.frame.keep, b.frame.keep
                made = {"intersect": lambda: p() & q(), "union": lambda: p() | q(), "negate": lambda: ~p()}[item.kind]
                self._select(item.output, a.target, made)
            case ir.Materialize():
                self.known[item.output.full] = self._take(self.positions(item.index), self.get(item.source), item)
            case ir.Map():
                a = self.data(item.input)
                b = self.data(item.partner) if item.partner else Data(a.frame, Expr("lit", (item.scalar,)))
                if a.frame is not b.frame:
                    raise UnsupportedOperation(f"item {item.id}: columns of different rows")
                self.known[item.output.full] = Data(a.frame, Expr("map", (item.kind, a.expr, b.expr)))
            case ir.Join():
                self._join(item)
            case ir.Aggregate():
                d, name = self.data(item.input), self._name()
                g = Frame(lambda: d.frame.df.agg(aggregate(item.kind, d.frame.column(d.expr)).alias(name)))
                self.known[item.output.full] = Data(g, Expr("col", (name,)))
            case ir.Group():
                self._group(item)
            case ir.Sort():
                cols = [self.data(c) for c in item.columns]
                if any(c.frame is not cols[0].frame for c in cols):
                    raise UnsupportedOperation(f"item {item.id}: sort columns of different rows")
                before = self.positions(item.existing).order if item.existing else ()
                frame = cols[0].frame
                self.known[item.index.full] = Positions(frame, frame, tuple((c.expr, up) for c, up in zip(cols, item.ascending, strict=True)) + before)

    def _select(self, output: ir.Col, source: Frame, keep: Callable[[], Column]) -> None:
        g = Frame(lambda: source.df.filter(keep()), source=source, keep=keep, tables=source.tables)
        self.known[output.full] = Positions(g, source)

    def _take(self, index: Positions, source: Data | Positions, item: ir.Item) -> Data | Positions:
        at = source.frame
        if at is not index.target:
            raise UnsupportedOperation(f"item {item.id}: the positions address other rows than the column's")
        if isinstance(source, Positions):
            return Positions(index.frame, source.target)
        if index.frame.keys and index.frame is not index.target:
            keys, firsts = index.frame.keys, index.frame.firsts
            if source.expr in keys:
                return Data(index.frame, Expr("col", (f"key{keys.index(source.expr)}",)))
            if source.expr not in firsts:
                firsts.append(source.expr)
            return Data(index.frame, Expr("col", (f"first{firsts.index(source.expr)}",)))
        return Data(index.frame, source.expr)

    def _join(self, item: ir.Join) -> None:
        inner, outer = self.data(item.inner), self.data(item.outer)
        if inner.frame.tables & outer.frame.tables:
            raise UnsupportedOperation(f"item {item.id}: both sides hold {sorted(inner.frame.tables & outer.frame.tables)}")

        def build() -> DataFrame:
            a, b = inner.frame.df, outer.frame.df
            ka, kb = inner.frame.column(inner.expr), outer.frame.column(outer.expr)
            kinds = [f.df.select(k).schema[0].dataType for f, k in ((inner.frame, ka), (outer.frame, kb))]
            if kinds[0] != kinds[1] or isinstance(kinds[0], T.FractionalType):
                raise UnsupportedOperation(f"item {item.id}: join of {kinds[0].simpleString()} with {kinds[1].simpleString()}")
            if self.first_match:
                # one row a key, the least by its columns in order, whatever the order of tasks; combined before the shuffle
                a = a.groupBy(ka.alias("__key")).agg(F.min(F.struct(*a.columns)).alias("__row")).select("__row.*")
            return b.join(a, ka == kb)

        j = Frame(build, tables=inner.frame.tables | outer.frame.tables)
        i, o = item.outputs()
        self.known[i.full], self.known[o.full] = Positions(j, inner.frame), Positions(j, outer.frame)

    def _group(self, item: ir.Group) -> None:
        keys = [self.data(c) for c in item.keys]
        frame = keys[0].frame
        value = self.data(item.input) if item.input else None
        if any(d.frame is not frame for d in [*keys, *([value] if value else [])]):
            raise UnsupportedOperation(f"item {item.id}: columns of different rows")
        g = Frame(lambda: None, keys=[k.expr for k in keys])

        def build() -> DataFrame:
            sums = [F.sum(frame.column(value.expr)).alias("sum")] if value else []
            firsts = [F.first(frame.column(e)).alias(f"first{n}") for n, e in enumerate(g.firsts)]
            return frame.df.groupBy(*[frame.column(k.expr).alias(f"key{n}") for n, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("size"), *sums, *firsts)

        g.build = build
        index, ext, clusters, *sums = item.outputs()
        by_keys = tuple((Expr("col", (f"key{n}",)), True) for n in range(len(keys)))
        self.known[ext.full] = Positions(g, frame, by_keys)
        self.known[index.full] = Positions(frame, frame, tuple((k.expr, True) for k in keys))
        self.known[clusters.full] = Data(g, Expr("col", ("size",)))
        for c in sums:
            self.known[c.full] = Data(g, Expr("col", ("sum",)))

    def result(self, item: ir.Result) -> DataFrame:
        cols = [self.data(c) for c in item.columns]
        frame = cols[0].frame
        if any(c.frame is not frame for c in cols):
            raise UnsupportedOperation(f"item {item.id}: result columns of different rows")
        names = item.header or tuple(c.name for c in item.columns)
        order = self.positions(item.index).order if item.index else ()
        order += tuple((Expr("col", (f"key{n}",)), True) for n in range(len(frame.keys)))  # groups come in key order
        df = frame.df
        if order:
            df = df.orderBy(*[frame.column(e).asc() if up else frame.column(e).desc() for e, up in order])
        return df.select(*[frame.column(c.expr).alias(n) for c, n in zip(cols, names, strict=True)])


def lower(plan: ir.Plan, resolve: Resolver, first_match: bool = False) -> DataFrame:
    """The result of the plan; ``resolve`` gives the frame of a base table. ``first_match``: of inner rows with equal keys the least joins."""
    require(plan)
    state = Lowering(resolve, first_match)
    for item in topological(plan):
        if isinstance(item, ir.Result):
            return state.result(item)
        if not isinstance(item, ir.Fetch):
            state.step(item)
    raise UnsupportedOperation("the plan has no result")


class Items:
    """Items run one by one, each on what those before it made; ``reset`` forgets all of it."""

    def __init__(self, resolve: Resolver):
        self.resolve = resolve
        self.reset()

    def reset(self) -> None:
        self.state = Lowering(self.resolve)

    def run(self, item: ir.Item) -> DataFrame | tuple[list[Any], list[Any]] | None:
        """A frame for a result, the ends of a column for a fetch; other items only declare what the next ones read."""
        if isinstance(item, ir.Result):
            return self.state.result(item)
        if isinstance(item, ir.Fetch):
            return ends_of(self.state, item, 5)
        self.state.step(item)
        return None


def ends_of(state: Lowering, item: ir.Fetch, ends: int) -> tuple[list[Any], list[Any]]:
    d = state.data(item.input)
    values = d.frame.df.select(d.frame.column(d.expr).alias("v"))
    return [r.v for r in values.head(ends)], [r.v for r in values.tail(ends)]


def fetch(plan: ir.Plan, resolve: Resolver, ends: int = 5) -> dict[int, tuple[list[Any], list[Any]]]:
    """For each fetch item, the first and last values of its column."""
    state, out = Lowering(resolve), {}
    for item in topological(plan):
        if isinstance(item, ir.Fetch):
            out[item.id] = ends_of(state, item, ends)
        elif not isinstance(item, ir.Result):
            state.step(item)
    return out
