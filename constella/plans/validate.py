"""Checks of a plan before it is lowered, and its graph: order, depths, Graphviz text."""

from __future__ import annotations

from dataclasses import dataclass, field

from constella.functions.expressions import AGGREGATES, ARITHMETIC, COMPARISONS
from constella.plans import ir


@dataclass
class Report:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.errors


class InvalidPlan(ValueError):
    def __init__(self, plan: ir.Plan, report: Report):
        super().__init__(f"plan {plan.name}: " + "; ".join(report.errors))
        self.report = report


def topological(plan: ir.Plan) -> list[ir.Item]:
    """Items after their dependencies, by id where there is a choice; items on a cycle are left out."""
    by_id = {i.id: i for i in plan.items}
    waits = {i.id: {d for d in i.depends if d in by_id} for i in plan.items}
    out: list[ir.Item] = []
    while ready := sorted(k for k, w in waits.items() if not w):
        for k in ready:
            out.append(by_id[k])
            del waits[k]
        for w in waits.values():
            w.difference_update(ready)
    return out


def depths(plan: ir.Plan) -> dict[int, int]:
    """The longest path from an item without dependencies to each item."""
    out: dict[int, int] = {}
    for item in topological(plan):
        out[item.id] = max((out[d] + 1 for d in item.depends if d in out), default=0)
    return out


def accesses(plan: ir.Plan) -> dict[str, list[int]]:
    """Depths at which each base column is read."""
    of = depths(plan)
    return {c: sorted(of[i] for i in ids) for c, ids in plan.base_columns().items()}


def _ancestors(plan: ir.Plan) -> dict[int, set[int]]:
    out: dict[int, set[int]] = {}
    for item in topological(plan):
        out[item.id] = set(item.depends).union(*(out.get(d, set()) for d in item.depends))
    return out


def check(plan: ir.Plan) -> Report:
    """Roots, cycles, paths to the result, producers of inputs, and operators that exist."""
    report, by_id = Report(), {}
    for item in plan.items:
        if item.id in by_id:
            report.errors.append(f"item {item.id} is defined twice")
        by_id[item.id] = item
    if not plan.items:
        report.errors.append("the plan is empty")
        return report
    for item in plan.items:
        report.errors += [f"item {item.id} depends on item {d}, which is missing" for d in item.depends if d not in by_id]
    ordered = topological(plan)
    if len(ordered) < len(by_id):
        report.errors.append(f"items {sorted(set(by_id) - {i.id for i in ordered})} lie on a cycle or behind one")
        return report
    if all(i.depends for i in plan.items):
        report.errors.append("no item is without dependencies")
    roots = [i for i in plan.items if isinstance(i, ir.Result)]
    if len(roots) > 1:
        report.warnings.append(f"several results; the first, item {roots[0].id}, counts")
    if not roots and not any(isinstance(i, ir.Fetch) for i in plan.items):
        report.errors.append("no result")
    above = _ancestors(plan)
    needed = set().union(*(above[r.id] | {r.id} for r in plan.items if isinstance(r, ir.Result | ir.Fetch)))
    if roots and (idle := sorted(set(by_id) - needed)):
        report.errors.append(f"items {idle} lie on no path to the result")
    for item in plan.items:
        made = {c.full for d in above[item.id] & set(by_id) for c in by_id[d].outputs()}
        report.errors += [f"item {item.id} reads {c.full}, which none of its dependencies makes" for c in item.inputs() if not c.base and c.full not in made]
        match item:
            case ir.Filter(kind=k) if k not in COMPARISONS:
                report.errors.append(f"item {item.id}: unsupported predicate {k}")
            case ir.Map(kind=k) if k not in ARITHMETIC:
                report.errors.append(f"item {item.id}: unsupported arithmetic {k}")
            case ir.Map(partner=None, scalar=None):
                report.errors.append(f"item {item.id} has no second operand")
            case ir.Aggregate(kind=k) if k not in AGGREGATES:
                report.errors.append(f"item {item.id}: unsupported aggregate {k}")
            case ir.SetOp(kind=k, right=r) if k not in ("intersect", "union", "negate") or (r is None) != (k == "negate"):
                report.errors.append(f"item {item.id}: unsupported set operation {k}")
            case ir.Result(columns=c, header=h) if h and len(h) != len(c):
                report.errors.append(f"item {item.id}: {len(h)} headers for {len(c)} columns")
    return report


def require(plan: ir.Plan) -> None:
    if not (report := check(plan)).ok:
        raise InvalidPlan(plan, report)


def dot(plan: ir.Plan) -> str:
    lines = [f'  i{i.id} [label="{i.id} {type(i).__name__}"];' for i in plan.items] + [f"  i{d} -> i{i.id};" for i in plan.items for d in i.depends]
    return "\n".join([f'digraph "{plan.name}" {{', *lines, "}"])
