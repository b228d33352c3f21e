"""Which shared columns of a group to copy to the near tier (the Spark cache) before its plans run.

The system load at a depth is the bytes all groups read there. A column's far bandwidth at a depth shrinks by its share of the
load; the saving is the time its readers stall with and without a copy. Groups are visited by descending bytes demanded, and
each decision moves load.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from constella.multiquery.grouping import Group
from constella.plans.ir import Plan
from constella.plans.validate import accesses


@dataclass(frozen=True)
class Profile:
    """Bandwidths in GB/s (bytes a nanosecond), latencies and the setup in ns, sizes in bytes."""

    far_bandwidth: float = 52.5
    far_latency: float = 320.0
    near_bandwidth: float = 186.0
    near_latency: float = 120.0
    setup: float = 500.0
    chunk: int = 4 << 20
    least_accesses: int = 2
    least_saving: float = 5e6
    least_share: float = 0.20


#: The far tier is a Parquet scan with the joins of a view, the near tier the Spark cache. Bandwidths and the setup of a column
#: are medians for eight columns of 600,000 lines on local[8]: scan 0.51 s, scan into the cache 1.28 s, cache 0.07 s.
SPARK = Profile(far_bandwidth=0.075, far_latency=1e6, near_bandwidth=0.58, near_latency=1e5, setup=9.5e7, chunk=1 << 20)


@dataclass(frozen=True)
class Estimate:
    ratio: float
    without: float
    with_copy: float
    aggression: float

    @property
    def saving(self) -> float:
        return self.without - self.with_copy


def load_profile(plans: Sequence[Plan], sizes: Mapping[str, int]) -> dict[int, float]:
    load: dict[int, float] = {}
    for p in plans:
        for column, depths in accesses(p).items():
            for d in depths:
                load[d] = load.get(d, 0.0) + sizes[column]
    return load


def estimate(size: int, depths: Sequence[int], load: Mapping[int, float], profile: Profile = Profile()) -> Estimate:
    chunk = min(profile.chunk, size)
    total = lambda d: max(float(size), load.get(d, 0.0))
    bandwidth = lambda d: min(profile.far_bandwidth, max(0.001, profile.far_bandwidth * size / total(d)))
    distinct = sorted(set(depths))
    ratio = sum(max(1.0, total(d) / size) for d in distinct) / len(distinct)
    aggression = math.log2(ratio) if ratio > 1 else 0.0
    without = sum(chunk / bandwidth(d) + profile.far_latency for d in distinct)
    rest = 0.30 * math.exp(-1.2 * aggression) * (size - chunk) / bandwidth(0)
    near = sum(chunk / profile.near_bandwidth + profile.near_latency for _ in distinct)
    return Estimate(ratio, without, profile.setup + chunk / bandwidth(0) + profile.far_latency + rest + near, aggression)


def worthwhile(size: int, reads: int, e: Estimate, profile: Profile = Profile()) -> bool:
    ease = math.exp(-0.6 * e.aggression)
    return size >= profile.chunk and reads >= profile.least_accesses and e.saving >= profile.least_saving * ease and e.saving / e.without >= profile.least_share * ease


@dataclass(frozen=True)
class Decision:
    group: int
    column: str
    size: int
    reads: int
    estimate: Estimate
    selected: bool


def decide(groups: Sequence[Group], plans: Sequence[Plan], sizes: Mapping[str, int], profile: Profile = Profile()) -> list[Decision]:
    load, out = load_profile(plans, sizes), []
    reads: list[dict[str, list[int]]] = []
    for g in groups:
        own: dict[str, list[int]] = {}
        for i in g.members:
            for column, depths in accesses(plans[i]).items():
                own.setdefault(column, []).extend(depths)
        reads.append(own)
    weight = [sum(len(d) * sizes[c] for c, d in own.items()) for own in reads]
    for g in sorted(range(len(groups)), key=lambda i: (-weight[i], i)):
        chosen = []
        for column, depths in sorted(reads[g].items()):
            e = estimate(sizes[column], depths, load, profile)
            ok = worthwhile(sizes[column], len(depths), e, profile)
            out.append(Decision(g, column, sizes[column], len(depths), e, ok))
            if ok:
                chosen.append((column, depths))
        for column, depths in chosen:
            for d in depths:
                load[d] = max(0.0, load.get(d, 0.0) - sizes[column])
            load[0] = load.get(0, 0.0) + sizes[column]
    return out


#: Rows of the star schema's tables at scale factor 100; a column takes eight bytes a row.
ROWS_SF100 = {"lineorder": 600_038_145, "part": 1_400_000, "supplier": 200_000, "customer": 3_000_000, "date": 2_556}


def sizes_sf100(plans: Sequence[Plan]) -> dict[str, int]:
    return {c: 8 * ROWS_SF100[c.split(".")[0]] for p in plans for c in p.base_columns()}
