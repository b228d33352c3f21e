import pytest

from constella.functions.expressions import UnsupportedOperation, like_pattern
from constella.multiquery import costmodel, grouping
from constella.plans import ir, star, validate
from constella.plans.lower import fetch, lower

PLANS = {q: star.QUERIES[q](1) for q in star.QUERIES}


@pytest.mark.parametrize("name", star.QUERIES)
def test_plans_are_valid_and_survive_json(name):
    assert validate.check(PLANS[name]).ok
    assert ir.from_json(ir.to_json(PLANS[name])) == PLANS[name]
    assert "digraph" in validate.dot(PLANS[name])


def test_depths_of_base_columns():
    a = validate.accesses(PLANS["q_4_1"])
    assert a["customer.c_nation"] == [12] and a["lineorder.lo_custkey"] == [6] and a["date.d_datekey"] == [10]
    assert validate.accesses(PLANS["q_1_1"])["lineorder.lo_discount"] == [0, 2]


def test_cost_golden_values():
    def of(n, query, column):
        plans = [star.QUERIES[query](i) for i in range(n)]
        made = costmodel.decide(grouping.group_plans([set(p.base_columns()) for p in plans]), plans, costmodel.sizes_sf100(plans))
        return next(x.estimate for x in made if x.column == column)

    e = of(50, "q_1_1", "lineorder.lo_discount")
    assert (round(e.ratio), round(e.without / 1e6, 3), round(e.with_copy / 1e6, 3)) == (125, 19.974, 8.677)
    e = of(1, "q_1_1", "lineorder.lo_discount")
    assert round(e.saving / 1e6, 3) == -11.025


def _bad(*items):
    return validate.check(ir.Plan(1, "bad", items)).errors


def test_bad_plans():
    c = lambda n: ir.Col("1_inter", n)
    base = ir.Col("supplier", "s_suppkey", True)
    result = ir.Result(id=9, depends=(1,), filename="x", columns=(c("a"),))
    assert any("cycle" in e for e in _bad(ir.Filter(id=1, depends=(1,), input=base, output=c("a"), kind="eq", values=(1,)), result))
    assert any("missing" in e for e in _bad(ir.Filter(id=1, depends=(5,), input=base, output=c("a"), kind="eq", values=(1,)), result))
    assert any("no result" in e for e in _bad(ir.Filter(id=1, input=base, output=c("a"), kind="eq", values=(1,))))
    assert any("unsupported predicate" in e for e in _bad(ir.Filter(id=1, input=base, output=c("a"), kind="regex", values=(1,)), result))
    assert any("none of its dependencies makes" in e for e in _bad(ir.Filter(id=1, input=base, output=c("b"), kind="eq", values=(1,)), result))
    assert any("twice" in e for e in _bad(ir.Filter(id=1, input=base, output=c("a"), kind="eq", values=(1,)), ir.Filter(id=1, input=base, output=c("a"), kind="eq", values=(1,)), result))
    two = ir.Result(id=10, depends=(1,), filename="y", columns=(c("a"),))
    assert validate.check(ir.Plan(1, "two", (ir.Filter(id=1, input=base, output=c("a"), kind="eq", values=(1,)), result, two))).warnings
    with pytest.raises(validate.InvalidPlan):
        lower(ir.Plan(1, "empty", ()), lambda t: None)


def test_mixed_rows_raise(spark, small):
    b = ir.Builder(1, "mixed")
    b.take(b.filter("supplier.s_region", "eq", "ASIA", to="f"), "supplier.s_suppkey", to="a")
    b.take(b.filter("supplier.s_region", "eq", "EUROPE", to="g"), "supplier.s_suppkey", to="b")
    plan = b.result({"a": "a", "b": "b"})
    with pytest.raises(UnsupportedOperation):
        lower(plan, star.Star(spark, small).resolver(plan))


def test_join_types_must_agree(spark, small):
    b = ir.Builder(1, "types")
    i, o = b.join("supplier.s_nation", "lineorder.lo_suppkey", to="j")
    b.take(o, "lineorder.lo_revenue", to="r")
    plan = b.result({"r": "r"})
    with pytest.raises(UnsupportedOperation):
        lower(plan, star.Star(spark, small).resolver(plan)).collect()


def test_first_match(spark):
    inner = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k bigint, v string")
    outer = spark.createDataFrame([(1,), (1,), (3,)], "k bigint")
    b = ir.Builder(1, "dup")
    i, o = b.join("inner.k", "outer.k", to="j")
    b.take(o, "outer.k", to="k")
    assert len(lower(b.result({"k": "k"}), lambda t: {"inner": inner, "outer": outer}[t], first_match=True).collect()) == 2


def test_empty_filter_and_like(spark):
    t = spark.createDataFrame([("a_c",), ("abc",), ("a%c",), ("",), ("NULL",), ("a\\c",)], "s string")

    def rows(kind, *values):
        b = ir.Builder(1, "s")
        b.take(b.filter("t.s", kind, *values, to="f"), "t.s", to="s")
        return sorted(r.s for r in lower(b.result({"s": "s"}), lambda _: t).collect())

    assert rows("like", "a_c") == ["a_c"]
    assert rows("like", "a%c") == ["a%c", "a\\c", "a_c", "abc"]
    assert rows("like", "a\\c") == ["a\\c"]
    assert rows("eq", "nothing") == [] and len(rows("ne", "nothing")) == 6
    assert rows("in", "abc", "nothing") == ["abc"] and rows("in") == []
    assert like_pattern("a_b\\") == "a\\_b\\\\"


def test_truncating_division(spark):
    t = spark.createDataFrame([(-7, 2), (7, -2), (7, 2)], "a bigint, b bigint")
    b = ir.Builder(1, "d")
    b.map("div", "t.a", "t.b", to="q")
    b.map("mod", "t.a", "t.b", to="r")
    assert sorted(tuple(r) for r in lower(b.result({"q": "q", "r": "r"}), lambda _: t).collect()) == [(-3, -1), (-3, 1), (3, 1)]


def test_fetch(spark):
    t = spark.range(100).select("id").coalesce(1)
    b = ir.Builder(1, "f")
    b.fetch("t.id")
    assert fetch(b.plan(), lambda _: t) == {1: ([0, 1, 2, 3, 4], [95, 96, 97, 98, 99])}


def test_late_and_early_plans_read_the_same(spark, small):
    s = star.Star(spark, small)
    for name in ("q_4_2", "q_4_3"):
        early, late = PLANS[name], PLANS[f"{name}_vai"]
        assert sorted(map(tuple, lower(early, s.resolver(early)).collect())) == sorted(map(tuple, lower(late, s.resolver(late)).collect()))


def test_projection_and_filter_reach_the_scan(spark, small):
    plan = PLANS["q_1_1"]
    text = lower(plan, star.Star(spark, small).resolver(plan))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "part.parquet" not in text and "l_tax" not in text and "l_partkey" not in text
