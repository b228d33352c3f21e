"""Plans as data: a DAG of items that read and write named columns, and its JSON form."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from typing import Any


@dataclass(frozen=True)
class Col:
    table: str
    name: str
    base: bool = False

    @property
    def full(self) -> str:
        return f"{self.table}.{self.name}"


@dataclass(frozen=True, kw_only=True)
class Item:
    id: int
    depends: tuple[int, ...] = ()

    def inputs(self) -> list[Col]:
        return []

    def outputs(self) -> list[Col]:
        return []


@dataclass(frozen=True, kw_only=True)
class Filter(Item):
    """Positions of the rows for which the predicate holds."""

    input: Col
    output: Col
    kind: str
    values: tuple[Any, ...]

    def inputs(self) -> list[Col]:
        return [self.input]

    def outputs(self) -> list[Col]:
        return [self.output]


@dataclass(frozen=True, kw_only=True)
class SetOp(Item):
    """``intersect`` or ``union`` of two position lists of one table, or ``negate`` of the first."""

    kind: str
    left: Col
    right: Col | None
    output: Col

    def inputs(self) -> list[Col]:
        return [c for c in (self.left, self.right) if c]

    def outputs(self) -> list[Col]:
        return [self.output]


@dataclass(frozen=True, kw_only=True)
class Materialize(Item):
    """The values of ``source`` at the positions ``index``; the source may be positions itself."""

    index: Col
    source: Col
    output: Col

    def inputs(self) -> list[Col]:
        return [self.index, self.source]

    def outputs(self) -> list[Col]:
        return [self.output]


@dataclass(frozen=True, kw_only=True)
class Map(Item):
    """Arithmetic of a column with another, or with a scalar."""

    kind: str
    input: Col
    output: Col
    partner: Col | None = None
    scalar: int | float | None = None

    def inputs(self) -> list[Col]:
        return [c for c in (self.input, self.partner) if c]

    def outputs(self) -> list[Col]:
        return [self.output]


@dataclass(frozen=True, kw_only=True)
class Join(Item):
    """Equi-join; ``<output>_i`` and ``<output>_o`` are the positions of the matches in the inner and outer rows."""

    inner: Col
    outer: Col
    output: Col

    def inputs(self) -> list[Col]:
        return [self.inner, self.outer]

    def outputs(self) -> list[Col]:
        return [Col(self.output.table, self.output.name + s) for s in ("_i", "_o")]


@dataclass(frozen=True, kw_only=True)
class Aggregate(Item):
    kind: str
    input: Col
    output: Col

    def inputs(self) -> list[Col]:
        return [self.input]

    def outputs(self) -> list[Col]:
        return [self.output]


@dataclass(frozen=True, kw_only=True)
class Group(Item):
    """Groups by keys in ascending order: ``<index>_ext`` a row of each group, ``clusters`` group sizes, ``<result>_agg`` sums."""

    keys: tuple[Col, ...]
    index: Col
    clusters: Col
    input: Col | None = None
    result: Col | None = None

    def inputs(self) -> list[Col]:
        return [*self.keys, *([self.input] if self.input else [])]

    def outputs(self) -> list[Col]:
        out = [self.index, Col(self.index.table, self.index.name + "_ext"), self.clusters]
        return out + ([Col(self.result.table, self.result.name + "_agg")] if self.result else [])


@dataclass(frozen=True, kw_only=True)
class Sort(Item):
    columns: tuple[Col, ...]
    ascending: tuple[bool, ...]
    index: Col
    existing: Col | None = None

    def inputs(self) -> list[Col]:
        return [*self.columns, *([self.existing] if self.existing else [])]

    def outputs(self) -> list[Col]:
        return [self.index]


@dataclass(frozen=True, kw_only=True)
class Fetch(Item):
    input: Col

    def inputs(self) -> list[Col]:
        return [self.input]


@dataclass(frozen=True, kw_only=True)
class Result(Item):
    filename: str
    columns: tuple[Col, ...]
    header: tuple[str, ...] = ()
    index: Col | None = None

    def inputs(self) -> list[Col]:
        return [*self.columns, *([self.index] if self.index else [])]


KINDS = {c.__name__: c for c in (Filter, SetOp, Materialize, Map, Join, Aggregate, Group, Sort, Fetch, Result)}


@dataclass(frozen=True)
class Plan:
    id: int
    name: str
    items: tuple[Item, ...] = field(default_factory=tuple)

    def base_columns(self) -> dict[str, list[int]]:
        """Ids of the items that read each base column."""
        out: dict[str, list[int]] = {}
        for item in self.items:
            for c in item.inputs():
                if c.base:
                    out.setdefault(c.full, []).append(item.id)
        return out


def to_json(plan: Plan) -> str:
    return json.dumps({"id": plan.id, "name": plan.name, "items": [{"type": type(i).__name__} | asdict(i) for i in plan.items]})


def _revive(key: str, value: Any) -> Any:
    if isinstance(value, dict):
        return Col(**value)
    if isinstance(value, list):
        return tuple(_revive(key, v) for v in value)
    return value


def from_json(text: str) -> Plan:
    d = json.loads(text)
    return Plan(d["id"], d["name"], tuple(KINDS[i["type"]](**{k: _revive(k, v) for k, v in i.items() if k != "type"}) for i in d["items"]))


class Builder:
    """Writes plans by column names; each item depends on the items that made its inputs."""

    def __init__(self, plan_id: int, name: str):
        self.id, self.name, self.items = plan_id, name, []
        self._made: dict[str, int] = {}

    def col(self, name: str | Col) -> Col:
        if isinstance(name, Col):
            return name
        if "." in name:
            table, column = name.split(".")
            return Col(table, column, True)
        return Col(f"{self.id}_inter", name)

    def _add(self, item_class: type[Item], **fields: Any) -> None:
        item = item_class(id=len(self.items) + 1, **fields)
        depends = tuple(dict.fromkeys(self._made[c.full] for c in item.inputs() if c.full in self._made))
        item = item_class(id=item.id, depends=depends, **fields)
        self.items.append(item)
        for c in item.outputs():
            self._made[c.full] = item.id

    def filter(self, source: str, kind: str, *values: Any, to: str) -> str:
        self._add(Filter, input=self.col(source), output=self.col(to), kind=kind, values=values)
        return to

    def both(self, left: str, right: str, to: str) -> str:
        self._add(SetOp, kind="intersect", left=self.col(left), right=self.col(right), output=self.col(to))
        return to

    def either(self, left: str, right: str, to: str) -> str:
        self._add(SetOp, kind="union", left=self.col(left), right=self.col(right), output=self.col(to))
        return to

    def negate(self, left: str, to: str) -> str:
        self._add(SetOp, kind="negate", left=self.col(left), right=None, output=self.col(to))
        return to

    def take(self, index: str, source: str, to: str) -> str:
        self._add(Materialize, index=self.col(index), source=self.col(source), output=self.col(to))
        return to

    def map(self, kind: str, a: str, b: str | int | float, to: str) -> str:
        if isinstance(b, str):
            self._add(Map, kind=kind, input=self.col(a), partner=self.col(b), output=self.col(to))
        else:
            self._add(Map, kind=kind, input=self.col(a), scalar=b, output=self.col(to))
        return to

    def join(self, inner: str, outer: str, to: str) -> tuple[str, str]:
        self._add(Join, inner=self.col(inner), outer=self.col(outer), output=self.col(to))
        return f"{to}_i", f"{to}_o"

    def aggregate(self, kind: str, source: str, to: str) -> str:
        self._add(Aggregate, kind=kind, input=self.col(source), output=self.col(to))
        return to

    def group(self, keys: list[str], source: str | None, to: str) -> tuple[str, str, str]:
        """Names of the extents, the cluster sizes and the sums."""
        self._add(Group, keys=tuple(map(self.col, keys)), index=self.col(to), clusters=self.col(f"{to}_clusters"), input=self.col(source) if source else None, result=self.col(to) if source else None)
        return f"{to}_ext", f"{to}_clusters", f"{to}_agg"

    def sort(self, columns: list[str], ascending: list[bool], to: str, existing: str | None = None) -> str:
        self._add(Sort, columns=tuple(map(self.col, columns)), ascending=tuple(ascending), index=self.col(to), existing=self.col(existing) if existing else None)
        return to

    def fetch(self, source: str) -> None:
        self._add(Fetch, input=self.col(source))

    def result(self, columns: dict[str, str], index: str | None = None) -> Plan:
        """``columns``: header by column."""
        self._add(Result, filename=self.name, columns=tuple(map(self.col, columns)), header=tuple(columns.values()), index=self.col(index) if index else None)
        return self.plan()

    def plan(self) -> Plan:
        return Plan(self.id, self.name, tuple(self.items))
