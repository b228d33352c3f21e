"""Runs plans one by one or in groups that share cached columns.

Plans that arrive inside a window make a batch. In ``grouped`` mode a batch is parted by overlap of base columns, the cost
model picks shared columns, and those of a table are kept as one projection in the Spark cache; all groups run side by side. In ``naive`` mode each plan reads its tables itself. Results are
the same.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark import InheritableThread, StorageLevel
from pyspark.sql import DataFrame, SparkSession

from constella.multiquery.costmodel import Decision, Profile, decide
from constella.multiquery.grouping import Group, group_plans
from constella.plans.ir import Item, Plan
from constella.plans.lower import Items, lower
from constella.plans.star import Star
from constella.plans.validate import require


@dataclass(frozen=True)
class EngineConfig:
    mode: str = "grouped"
    window_ms: int = 100
    max_overhead: float = 2.0
    least_accesses: int = 2
    concurrent: int = 8
    profile: Profile = field(default_factory=Profile)
    #: Bytes of projections that a batch may cache; tables come in order of their chosen columns' savings.
    cache_limit: int = 8 << 30


class Cancelled(Exception):
    """The plan was cancelled before or while it ran."""


@dataclass
class PlanResult:
    plan: Plan
    rows: list[Any] | None
    error: Exception | None
    started: float
    ended: float
    group: int | None = None

    @property
    def seconds(self) -> float:
        return self.ended - self.started


class Engine:
    """``run`` a batch at once, or ``submit`` plans that a window gathers."""

    def __init__(self, spark: SparkSession, star: Star, config: EngineConfig = EngineConfig(), sizes: dict[str, int] | None = None):
        self.spark, self.star, self.config = spark, star, config
        self._sizes = dict(sizes or {})
        self._pool = ThreadPoolExecutor(max_workers=config.concurrent)
        self.batcher = Batcher(self._seal, config.window_ms)
        self._lock = threading.Lock()
        self._status: dict[int, str] = {}
        self._mark = uuid.uuid4().hex
        self.items = Items(star.table)

    def close(self) -> None:
        self.batcher.flush()
        self._pool.shutdown(wait=True)

    def configure(self, **changes: Any) -> None:
        """Changes options; the open window is run under the old ones first. ``concurrent`` resizes the pool."""
        self.batcher.flush()
        self.config = replace(self.config, **changes)
        self.batcher.window_ms = self.config.window_ms
        if "concurrent" in changes:
            before, self._pool = self._pool, ThreadPoolExecutor(max_workers=self.config.concurrent)
            before.shutdown(wait=True)

    def reset(self) -> None:
        """Forgets sizes, schemas, the items run so far and the state of ended plans; the open window is run first."""
        self.batcher.flush()
        self._sizes.clear()
        self.star = Star(self.spark, self.star.folder)
        self.items = Items(self.star.table)
        with self._lock:
            self._status = {p: s for p, s in self._status.items() if s in ("waiting", "running")}

    def run_item(self, item: Item) -> Any:
        """Runs one item on what earlier ones made: the rows of a result, the ends of a column for a fetch, else None."""
        made = self.items.run(item)
        return made.collect() if isinstance(made, DataFrame) else made

    def submit(self, plan: Plan) -> Future:
        require(plan)
        self._set(plan.id, "waiting")
        return self.batcher.add(plan)

    def status(self, plan_id: int) -> str:
        """``unknown``, ``waiting``, ``running``, ``done``, ``failed`` or ``cancelled``; of plans with one id, the last to change."""
        with self._lock:
            return self._status.get(plan_id, "unknown")

    def cancel(self, plan_id: int) -> bool:
        """Stops the jobs of a plan, or keeps a waiting one from starting; False when there is nothing to stop."""
        with self._lock:
            if self._status.get(plan_id) not in ("waiting", "running"):
                return False
            self._status[plan_id] = "cancelled"
        self.spark.sparkContext.cancelJobsWithTag(self._tag(plan_id))
        return True

    def _tag(self, plan_id: int) -> str:
        return f"constella-{self._mark}-{plan_id}"

    def _set(self, plan_id: int, state: str) -> None:
        with self._lock:
            self._status[plan_id] = state

    def sizes(self, plans: Sequence[Plan]) -> dict[str, int]:
        """Bytes of each base column: rows of its table times the usual width of its type."""
        for p in plans:
            for c in p.base_columns():
                if c not in self._sizes:
                    table, column = c.split(".")
                    width = self.star.table(table, [column])._jdf.schema().defaultSize()
                    self._sizes[c] = max(1, self.star.rows(table) * width)
        return self._sizes

    def analyse(self, plans: Sequence[Plan]) -> tuple[list[Group], list[Decision]]:
        groups = group_plans([set(p.base_columns()) for p in plans], self.config.max_overhead)
        profile = replace(self.config.profile, least_accesses=self.config.least_accesses)
        return groups, decide(groups, plans, self.sizes(plans), profile)

    def run(self, plans: Sequence[Plan]) -> list[PlanResult]:
        for p in plans:
            self._set(p.id, "waiting")
        return self._run(plans)

    def _run(self, plans: Sequence[Plan]) -> list[PlanResult]:
        if self.config.mode == "naive":
            return self._run_all([(p, self.star.resolver(p), None) for p in plans])
        groups, decisions = self.analyse(plans)
        work: list[tuple[Plan, Callable[[str], DataFrame], int | None]] = [(p, self.star.resolver(p), None) for p in plans]
        room, copies = self.config.cache_limit, []
        try:
            for g, group in enumerate(groups):
                kept, room = self._copies(group, plans, [d for d in decisions if d.group == g and d.selected], room)
                copies += kept.values()
                for i in group.members:
                    work[i] = (plans[i], self._near(kept, work[i][1]), g)
            return self._run_all(work)
        finally:
            for df in copies:
                df.unpersist()

    @staticmethod
    def _near(kept: dict[str, DataFrame], plain: Callable[[str], DataFrame]) -> Callable[[str], DataFrame]:
        return lambda table: kept[table] if table in kept else plain(table)

    def _copies(self, group: Group, plans: Sequence[Plan], hot: list[Decision], room: int) -> tuple[dict[str, DataFrame], int]:
        """The cached projections of a group, and the bytes still free."""
        kept: dict[str, DataFrame] = {}
        saving: dict[str, float] = {}
        for d in hot:
            table = d.column.split(".")[0]
            saving[table] = saving.get(table, 0.0) + d.estimate.saving
        for table in sorted(saving, key=lambda t: (-saving[t], t)):
            # a plan that needs another column of the table reads the table itself, so the copy takes in all its readers
            columns = {c for i in group.members for c in plans[i].base_columns() if c.startswith(f"{table}.")}
            size = sum(self._sizes[c] for c in columns)
            if size <= room:
                room -= size
                kept[table] = self.star.table(table, [c.split(".")[1] for c in columns]).persist(StorageLevel.MEMORY_AND_DISK)
        return kept, room

    def _run_all(self, work: list[tuple[Plan, Callable[[str], DataFrame], int | None]]) -> list[PlanResult]:
        return list(self._pool.map(lambda w: self._run_one(*w), work))

    def _run_one(self, plan: Plan, resolve: Callable[[str], DataFrame], group: int | None) -> PlanResult:
        started, rows, error, context = time.time(), None, None, self.spark.sparkContext
        context.addJobTag(self._tag(plan.id))
        try:
            with self._lock:
                if self._status.get(plan.id) == "cancelled":
                    raise Cancelled(f"plan {plan.id}")
                self._status[plan.id] = "running"
            rows = lower(plan, resolve).collect()  # a report: its size is bounded by the groups of its keys
        except Exception as e:  # handed to the caller with the result
            error = e
        finally:
            context.removeJobTag(self._tag(plan.id))
        with self._lock:
            if self._status.get(plan.id) != "cancelled":
                self._status[plan.id] = "failed" if error else "done"
            elif error is not None and not isinstance(error, Cancelled):
                error = Cancelled(f"plan {plan.id}")
        return PlanResult(plan, rows, error, started, time.time(), group)

    def _seal(self, batch: list[tuple[Plan, Future]]) -> None:
        try:
            for (_, future), result in zip(batch, self._run([p for p, _ in batch]), strict=True):
                future.set_result(result)
        except Exception as e:
            for _, future in batch:
                if not future.done():
                    future.set_exception(e)


class Batcher:
    """The first plan opens a window; when it ends, all plans in it go on together, and the next plan opens another."""

    def __init__(self, seal: Callable[[list[tuple[Plan, Future]]], None], window_ms: int):
        self.seal, self.window_ms = seal, window_ms
        self._lock = threading.Lock()
        self._open: list[tuple[Plan, Future]] = []
        self._token = ""
        self._running: list[threading.Thread] = []

    def add(self, plan: Plan) -> Future:
        future: Future = Future()
        with self._lock:
            self._open.append((plan, future))
            if len(self._open) == 1:
                self._token = uuid.uuid4().hex
                timer = threading.Timer(self.window_ms / 1000, self._close, [self._token])
                timer.daemon = True
                timer.start()
        return future

    def _close(self, token: str) -> None:
        with self._lock:
            if token != self._token or not self._open:
                return
            batch, self._open, self._token = self._open, [], ""
            thread = InheritableThread(target=self.seal, args=(batch,))
            self._running = [t for t in self._running if t.is_alive()] + [thread]
        thread.start()

    def flush(self) -> None:
        """Seals the open window at once and waits for all batches."""
        self._close(self._token)
        for t in list(self._running):
            t.join()
