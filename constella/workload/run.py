"""Workloads: a weighted mix of queries, phases, or users with think time, against an engine; and comparison of runs."""

from __future__ import annotations

import json
import random
import re
import statistics
import threading
import time
from collections.abc import Callable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from constella.multiquery.engine import Engine
from constella.plans.star import QUERIES
from constella.workload.arrivals import Arrivals

RECORD = (
    "workload string, name string, flight int, sequence int, mode string, window_ms int, max_overhead double, scale_factor int, iteration int, workers int, phase string, user int, "
    "in_flight int, planned double, submitted double, started double, ended double, elapsed double, rows long, group int, ok boolean, error string"
)


@dataclass
class Phase:
    name: str
    seconds: float
    arrivals: Arrivals
    mix: dict[str, float] | None = None


@dataclass
class Workload:
    name: str
    mix: dict[str, float]
    pattern: str = "mix"
    count: int = 0
    phases: list[Phase] = field(default_factory=list)
    users: int = 0
    think: tuple[float, float] = (0.0, 0.0)
    queries_a_user: int = 1
    stagger: float = 0.0
    iterations: int = 1
    seed: int = 0
    #: Between the queries of a mix; None: all at once.
    arrivals: Arrivals | None = None
    #: Queries sent and not ended; further ones wait for a place. None: no limit.
    max_concurrent: int | None = None
    scale_factor: int | None = None
    workers: int | None = None
    output_file: str | None = None

    def __post_init__(self) -> None:
        if self.pattern not in ("mix", "phases", "virtual_users"):
            raise ValueError(f"unknown pattern {self.pattern}")
        if not self.mix or any(w < 0 for w in self.mix.values()) or sum(self.mix.values()) <= 0:
            raise ValueError("the query mix needs positive weights")
        for name, mix in [("the mix", self.mix), *((f"phase {p.name}", p.mix) for p in self.phases if p.mix)]:
            if missing := set(mix) - set(QUERIES):
                raise ValueError(f"unknown queries in {name}: {sorted(missing)}")
        total = sum(self.mix.values())
        self.mix = {q: w / total for q, w in self.mix.items()}


def load(config: dict[str, Any]) -> Workload:
    """A workload from a configuration as read from YAML or JSON; rates in queries a second."""
    d = dict(config)
    phases = [Phase(p["name"], p["seconds"], Arrivals(**p["arrivals"]), p.get("mix")) for p in d.pop("phases", [])]
    users = d.pop("virtual_users", {})
    mix = d.pop("query_mix")
    known = {k: d[k] for k in ("name", "pattern", "count", "iterations", "seed") if k in d}
    return Workload(mix=mix, phases=phases, users=users.get("count", 0), think=tuple(users.get("think", (0.0, 0.0))), queries_a_user=users.get("queries", 1), stagger=users.get("stagger", 0.0), **known)


def arrivals_of(raw: dict[str, Any], seed: int = 0) -> Arrivals:
    """Arrivals of a profile: ``poisson`` by rate, ``fixed_jitter`` in milliseconds, ``target_qps`` steady or from one rate to another."""
    match raw["model"]:
        case "poisson":
            return Arrivals("poisson", raw["rate"], seed=seed)
        case "fixed_jitter":
            return Arrivals("jitter", 1000 / raw["interval_ms"], jitter=raw.get("jitter_ms", 0) / 1000, seed=seed)
        case "target_qps":
            variance = raw.get("variance", 0.1)
            if raw.get("start_rate") is not None:
                return Arrivals("ramp", raw["start_rate"], raw.get("end_rate"), variance, "target", seed)
            return Arrivals("target", raw["rate"], jitter=variance, seed=seed)
        case other:
            raise ValueError(f"unknown arrivals {other}")


def profile(raw: dict[str, Any], seed: int = 0) -> Workload:
    """A workload from a profile with a ``pattern`` section of type ``mix``, ``phases`` or ``virtual_users``."""
    p = raw["pattern"]
    common = {"name": raw["name"], "mix": dict(raw["query_mix"]), "pattern": p["type"], "iterations": raw.get("iterations", 1), "seed": seed}
    common |= {k: raw.get(k) for k in ("scale_factor", "workers", "output_file")}
    match p["type"]:
        case "mix":
            return Workload(count=p["total_queries"], arrivals=arrivals_of(p["arrival"], seed), max_concurrent=p.get("max_concurrent", 32), **common)
        case "phases":
            phases = [Phase(x["name"], x["duration_s"], arrivals_of(x["arrival"], seed + n), x.get("query_mix")) for n, x in enumerate(p["phases"])]
            return Workload(phases=phases, max_concurrent=p.get("max_concurrent", 32), **common)
        case "virtual_users":
            think = (p.get("think_time_min_ms", 500) / 1000, p.get("think_time_max_ms", 3000) / 1000)
            return Workload(users=p["num_users"], queries_a_user=p["queries_per_user"], think=think, stagger=p.get("stagger_ms", 200) / 1000, **common)
        case other:
            raise ValueError(f"unknown pattern {other}")


def load_file(path: str, seed: int = 0) -> Workload:
    """A profile from a YAML file, or a JSON file where the YAML reader is missing; ``load``'s own layout has no ``pattern`` section."""
    with open(path) as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        raw = json.loads(text)
    else:
        raw = yaml.safe_load(text)
    return profile(raw, seed) if isinstance(raw.get("pattern"), dict) else load(raw)


def flight(name: str) -> int:
    """The flight of a query such as ``q_3_2``; 0 for other names."""
    found = re.fullmatch(r"(?:\d+_)?q_(\d+)_.*", name)
    return int(found[1]) if found else 0


def execute(workload: Workload, engine: Engine, wait: Callable[[float], None] = time.sleep) -> list[dict[str, Any]]:
    """Runs all iterations and returns a row for each query, as in ``RECORD``."""
    return [r for i in range(workload.iterations) for r in _iteration(workload, engine, wait, i + 1)]


def _iteration(workload: Workload, engine: Engine, wait: Callable[[float], None], iteration: int) -> list[dict[str, Any]]:
    rng, lock, sent, number = random.Random(workload.seed + iteration - 1), threading.Lock(), [], iter(range(1, 10**9))
    pool = ThreadPoolExecutor(workload.max_concurrent) if workload.max_concurrent else None
    flying = 0

    def landed(_: Future) -> None:
        nonlocal flying
        with lock:
            flying -= 1

    def send(phase: str, user: int | None, planned: float, mix: dict[str, float]) -> Future:
        nonlocal flying
        with lock:
            name, n = rng.choices(list(mix), list(mix.values()))[0], next(number)
            row = {"name": name, "flight": flight(name), "sequence": n, "phase": phase, "user": user, "in_flight": flying, "planned": planned, "submitted": time.time()}
            flying += 1
        plan = QUERIES[name](n)
        future = pool.submit(lambda: engine.submit(plan).result()) if pool else engine.submit(plan)
        future.add_done_callback(landed)
        with lock:
            sent.append((row, future))
        return future

    if workload.pattern == "mix":
        for i in range(workload.count):
            delay = workload.arrivals.delay() if workload.arrivals and i else 0.0
            if delay:
                wait(delay)
            send("mix", None, delay, workload.mix)
    elif workload.pattern == "phases":
        for p in workload.phases:
            begun = time.time()
            while (gone := time.time() - begun) < p.seconds:
                delay = p.arrivals.delay(gone / p.seconds)
                wait(min(delay, p.seconds - gone))
                if gone + delay < p.seconds:
                    send(p.name, None, delay, p.mix or workload.mix)
    else:
        def user(u: int) -> None:
            own = random.Random((workload.seed + iteration - 1) * 1000 + u)
            wait(u * workload.stagger)
            think = 0.0
            for i in range(workload.queries_a_user):
                if i:  # a user thinks between queries, about the last answer
                    wait(think := own.uniform(*workload.think))
                send("users", u, think, workload.mix).result()

        threads = [threading.Thread(target=user, args=(u,)) for u in range(workload.users)]
        [t.start() for t in threads]
        [t.join() for t in threads]
    if pool:
        pool.shutdown(wait=True)
    engine.batcher.flush()
    whole = {"workload": workload.name, "mode": engine.config.mode, "window_ms": engine.config.window_ms, "max_overhead": engine.config.max_overhead}
    whole |= {"scale_factor": workload.scale_factor, "iteration": iteration, "workers": workload.workers}
    out = []
    for row, future in sent:
        r = future.result()
        out.append(whole | row | {"started": r.started, "ended": r.ended, "elapsed": r.seconds, "rows": len(r.rows or []), "group": r.group, "ok": r.error is None, "error": str(r.error) if r.error else None})
    return out


def records(spark: SparkSession, rows: Sequence[dict[str, Any]]) -> DataFrame:
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in RECORD.split(", ")) for r in rows], RECORD)


def comparison(runs: DataFrame) -> DataFrame:
    """Mean and deviation of ``seconds`` by ``n`` and ``mode``, and the difference to naive in per cent."""
    by = runs.groupBy("n", "mode").agg(F.avg("seconds").alias("mean"), F.stddev("seconds").alias("std"))
    base = by.where("mode = 'naive'").select("n", F.col("mean").alias("base"))
    return by.join(base, "n", "left").select("n", "mode", "mean", "std", ((F.col("mean") / F.col("base") - 1) * 100).alias("delta_percent"))


def timed_batches(engine: Engine, names: Sequence[str], n: int, iterations: int) -> list[float]:
    """Seconds of whole batches of ``n`` plans, round robin over the names."""
    out = []
    for _ in range(iterations):
        begun = time.time()
        results = engine.run([QUERIES[names[i % len(names)]](i + 1) for i in range(n)])
        if failed := [r.error for r in results if r.error]:
            raise failed[0]
        out.append(time.time() - begun)
    return out


def describe(seconds: Sequence[float]) -> str:
    return json.dumps({"mean": statistics.mean(seconds), "std": statistics.stdev(seconds) if len(seconds) > 1 else 0.0})
