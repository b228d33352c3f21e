"""Groups of plans by overlap of the base columns they read."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass


@dataclass
class Group:
    members: list[int]
    columns: set[str]
    largest: int


def merge_ratio(a: Group, b: Group) -> float:
    """Columns of the merged group by those of its largest member."""
    most = max(a.largest, b.largest)
    return len(a.columns | b.columns) / most if most else 1.0


def group_plans(column_sets: Sequence[set[str]], max_overhead: float = 2.0) -> list[Group]:
    """Plans with most columns first absorb those whose columns they include; then the pair of groups with the least merge
    ratio is merged as long as that is at most ``max_overhead``. Ties go by arrival."""
    left = sorted(range(len(column_sets)), key=lambda i: (-len(column_sets[i]), i))
    groups: list[Group] = []
    while left:
        own = set(column_sets[left[0]])
        members = [i for i in left if column_sets[i] <= own]
        groups.append(Group(members, own, len(own)))
        left = [i for i in left if i not in set(members)]
    while True:
        pairs = [(merge_ratio(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups[i + 1 :], i + 1)]
        if not pairs or (best := min(pairs))[0] > max_overhead:
            return groups
        _, i, j = best
        gone = groups.pop(j)
        groups[i] = Group(groups[i].members + gone.members, groups[i].columns | gone.columns, max(groups[i].largest, gone.largest))
