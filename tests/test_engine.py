import time

import pytest

from constella.multiquery.costmodel import Profile
from constella.multiquery.engine import Cancelled, Engine, EngineConfig
from constella.plans import ir, star
from constella.plans.lower import UnsupportedOperation
from constella.plans.validate import topological
from constella.streaming import requests
from constella.workload import run as workload
from constella.workload.arrivals import Arrivals

ALWAYS = Profile(chunk=1, least_saving=-1e18, least_share=-1e18)


@pytest.fixture
def engine(spark, small):
    made = []

    def make(**options):
        made.append(Engine(spark, star.Star(spark, small), EngineConfig(profile=ALWAYS, **options)))
        return made[-1]

    yield make
    for e in made:
        e.close()


def test_grouped_equals_naive_and_leaves_no_cache(spark, engine):
    plans = [star.QUERIES[q](i) for i, q in enumerate(star.REGISTERED, 1)]
    naive, grouped = engine(mode="naive").run(plans), engine(mode="grouped").run(plans)
    for a, b in zip(naive, grouped, strict=True):
        assert a.error is None and b.error is None
        assert sorted(a.rows) == sorted(b.rows), a.plan.name
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_sizes_are_rows_times_widths(spark, engine):
    e = engine()
    sizes = e.sizes([star.QUERIES["q_4_1"](1)])
    lines = e.star.read("lineitem").count()
    assert sizes["lineorder.lo_custkey"] == sizes["lineorder.lo_supplycost"] == 8 * lines
    assert sizes["date.d_datekey"] == 4 * e.star.table("date", ["d_datekey"]).count()


def test_copies_stay_within_the_limit(spark, engine):
    plans = [star.QUERIES[q](i) for i, q in enumerate(["q_1_1", "q_4_1"] * 4)]
    for limit in (0, 1 << 40):
        e = engine(cache_limit=limit)
        groups, decisions = e.analyse(plans)
        made = [e._copies(g, plans, [d for d in decisions if d.group == n and d.selected], limit) for n, g in enumerate(groups)]
        assert any(kept for kept, _ in made) == (limit > 0)
        assert all(0 <= room <= limit for _, room in made)
        for kept, _ in made:
            for df in kept.values():
                df.unpersist()


def test_a_group_reads_the_cache(spark, engine):
    e = engine()
    seen = []
    from constella.multiquery import engine as module

    plain = module.lower

    def spy(plan, resolve):
        df = plain(plan, resolve)
        seen.append(df._jdf.queryExecution().toString())
        return df

    module.lower = spy
    try:
        e.run([star.QUERIES["q_1_1"](1), star.QUERIES["q_1_2"](2)])
    finally:
        module.lower = plain
    assert all("InMemory" in s for s in seen)


def test_window_and_flush(engine):
    e = engine(window_ms=200)
    futures = [e.submit(star.QUERIES[q](i)) for i, q in enumerate(("q_1_1", "q_1_2"))]
    results = [f.result(timeout=60) for f in futures]
    assert [r.group for r in results] == [0, 0]
    e.configure(window_ms=100_000)
    late = e.submit(star.QUERIES["q_1_1"](3))
    time.sleep(0.1)
    assert not late.done()
    e.batcher.flush()
    assert late.result(timeout=60).rows == results[0].rows


def test_bad_plan_is_refused_and_failures_are_results(engine, spark, small):
    e = engine()
    with pytest.raises(ValueError):
        e.submit(ir.Plan(1, "none", ()))
    b = ir.Builder(1, "types")
    i, o = b.join("supplier.s_nation", "lineorder.lo_suppkey", to="j")
    b.take(o, "lineorder.lo_revenue", to="r")
    failed, fine = e.run([b.result({"r": "r"}), star.QUERIES["q_1_1"](2)])
    assert failed.error and fine.rows


def test_cancel_and_status(engine):
    e = engine(window_ms=100_000)
    plans = [star.QUERIES["q_1_1"](i) for i in (71, 72)]
    futures = [e.submit(p) for p in plans]
    assert e.status(71) == "waiting" and e.status(99) == "unknown" and not e.cancel(99)
    assert e.cancel(71) and not e.cancel(71)
    e.batcher.flush()
    first, second = (f.result(timeout=60) for f in futures)
    assert isinstance(first.error, Cancelled) and e.status(71) == "cancelled"
    assert second.rows and e.status(72) == "done" and not e.cancel(72)
    assert e.run([plans[0]])[0].rows == second.rows and e.status(71) == "done"


def test_cancel_stops_running_jobs(engine, spark):
    def sleepy(batches):
        import time

        for b in batches:
            time.sleep(60)
            yield b.assign(lo_revenue=b["lo_suppkey"])[["lo_suppkey", "lo_revenue"]]

    e = engine(mode="naive")
    slow = spark.range(0, 8, 1, 8).selectExpr("id AS lo_suppkey").mapInPandas(sleepy, "lo_suppkey long, lo_revenue long")
    e.star.table = lambda name, columns=None: slow
    b = ir.Builder(81, "slow")
    b.take(b.filter("lineorder.lo_suppkey", "ge", 0, to="f"), "lineorder.lo_revenue", to="r")
    plan, begun = b.result({"r": "r"}), time.time()
    future = e.submit(plan)
    while e.status(81) != "running":
        time.sleep(0.05)
    time.sleep(2)
    assert e.cancel(81)
    assert isinstance(future.result(timeout=60).error, Cancelled) and time.time() - begun < 50


def test_single_items_resize_and_reset(engine):
    e = engine()
    plan = star.QUERIES["q_1_1"](1)
    made = [e.run_item(i) for i in topological(plan)]
    assert [m for m in made if m is not None] == [e.run([plan])[0].rows]
    e.configure(concurrent=2)
    assert e._pool._max_workers == 2 and e.run([plan])[0].rows
    e.reset()
    assert e.status(1) == "unknown" and not e._sizes
    with pytest.raises(UnsupportedOperation):
        e.run_item(next(i for i in plan.items if isinstance(i, ir.Result)))


def test_streamed_requests(spark, engine, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(__import__("json").dumps({"plan": ir.to_json(star.QUERIES[q](i))}) for i, q in enumerate(("q_1_1", "q_2_1"))))
    got = []
    q = requests.serve(spark.readStream.schema("plan string").json(str(folder)), engine(), got.extend, str(tmp_path / "cp"), None)
    q.awaitTermination(120)
    assert sorted(r.plan.name for r in got) == ["q_1_1", "q_2_1"] and all(r.error is None for r in got)


def test_event_counts_stream(spark, small, tmp_path):
    batch = spark.read.parquet(f"{small}/events.parquet")
    time_column = next(f.name for f in batch.schema.fields if "timestamp" in f.dataType.simpleString())
    key = next(f.name for f in batch.schema.fields if f.dataType.simpleString() == "string")
    stamped = lambda df: df.withColumn("t", df[time_column].cast("timestamp"))
    folder = tmp_path / "events"
    batch.write.parquet(str(folder))
    stream = requests.event_counts(stamped(spark.readStream.schema(batch.schema).parquet(str(folder))), "t", key, "1 hour", "1 day")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    from constella.operators.core import windowed_events

    expected = windowed_events(stamped(batch), "t", "1 hour", key)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, expected.collect()))


def test_arrivals():
    mean = lambda a, n=4000: sum(a.delay() for _ in range(n)) / n
    assert abs(mean(Arrivals("poisson", 10)) - 0.1) < 0.01
    assert all(0.05 <= Arrivals("jitter", 10, jitter=0.05, seed=s).delay() <= 0.15 for s in range(50))
    assert abs(mean(Arrivals("target", 5, jitter=0.2)) - 0.2) < 0.01
    ramp = Arrivals("ramp", 1, end_rate=10, base="target")
    assert abs(ramp.delay(0) - 1) < 1e-9 and abs(ramp.delay(1) - 0.1) < 1e-9
    with pytest.raises(ValueError):
        Arrivals("never")


def test_workloads(spark, engine):
    for config in (
        {"name": "m", "query_mix": {"q_1_1": 3, "q_1_2": 1}, "count": 4},
        {"name": "u", "query_mix": {"q_1_1": 1}, "pattern": "virtual_users", "virtual_users": {"count": 2, "queries": 2}},
        {"name": "p", "query_mix": {"q_1_1": 1}, "pattern": "phases", "phases": [{"name": "a", "seconds": 0.5, "arrivals": {"kind": "target", "rate": 10}}]},
    ):
        rows = workload.execute(workload.load(config), engine(window_ms=50))
        assert rows and all(r["ok"] for r in rows)
        assert workload.records(spark, rows).count() == len(rows)
    with pytest.raises(ValueError):
        workload.load({"name": "x", "query_mix": {"q_9": 1}})


PROFILE = """
name: small
scale_factor: 1
workers: 4
iterations: 2
query_mix: {q_1_1: 3, q_2_1: 1}
pattern:
  type: phases
  max_concurrent: 2
  phases:
    - {name: a, duration_s: 0.4, arrival: {model: target_qps, rate: 10, variance: 0.05}}
    - {name: b, duration_s: 0.4, arrival: {model: target_qps, start_rate: 10, end_rate: 20}, query_mix: {q_1_2: 1}}
    - {name: c, duration_s: 0.3, arrival: {model: fixed_jitter, interval_ms: 50, jitter_ms: 10}}
"""


def test_profiles(spark, engine, tmp_path):
    (tmp_path / "p.yaml").write_text(PROFILE)
    w = workload.load_file(str(tmp_path / "p.yaml"))
    assert (w.scale_factor, w.workers, w.iterations, w.max_concurrent) == (1, 4, 2, 2)
    rows = workload.execute(w, engine(window_ms=20))
    assert {r["iteration"] for r in rows} == {1, 2} and all(r["ok"] for r in rows)
    assert {r["name"] for r in rows if r["phase"] == "b"} == {"q_1_2"}
    assert all(r["flight"] == int(r["name"][2]) and r["in_flight"] >= 0 and r["submitted"] <= r["started"] for r in rows)
    assert workload.records(spark, rows).count() == len(rows)
    users = workload.profile({"name": "u", "query_mix": {"q_1_1": 1}, "pattern": {"type": "virtual_users", "num_users": 2, "queries_per_user": 2, "think_time_min_ms": 10, "think_time_max_ms": 20, "stagger_ms": 5}})
    waits = []
    rows = workload.execute(users, engine(window_ms=20), waits.append)
    assert len(rows) == 4 and sorted(w for w in waits if w >= 0.01) == sorted(r["planned"] for r in rows if r["planned"])  # one pause a user
    mix = workload.profile({"name": "m", "query_mix": {"q_1_1": 1}, "pattern": {"type": "mix", "total_queries": 3, "arrival": {"model": "poisson", "rate": 100}}})
    assert len(workload.execute(mix, engine(window_ms=20))) == 3
    for bad in ({"type": "never"}, {"type": "phases", "phases": [{"name": "a", "duration_s": 1, "arrival": {"model": "poisson", "rate": 1}, "query_mix": {"q_9": 1}}]}):
        with pytest.raises(ValueError):
            workload.profile({"name": "x", "query_mix": {"q_1_1": 1}, "pattern": bad})


def test_comparison(spark):
    runs = spark.createDataFrame([(5, "naive", 2.0), (5, "naive", 4.0), (5, "grouped", 1.5)], "n int, mode string, seconds double")
    got = {r["mode"]: r for r in workload.comparison(runs).collect()}
    assert got["grouped"]["delta_percent"] == -50.0 and got["naive"]["mean"] == 3.0
