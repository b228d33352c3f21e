"""Queries for the engine's own operators, each with SQL for an independent engine."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from constella.functions.expressions import predicate
from constella.multiquery import costmodel, grouping
from constella.multiquery.engine import Engine, EngineConfig
from constella.operators import core
from constella.plans import ir, star, validate
from constella.plans.lower import lower
from constella.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

STAR_SQL = """
ssb_date AS (SELECT d AS d_datekey, CAST(year(d) AS BIGINT) AS d_year, CAST(year(d) * 100 + month(d) AS BIGINT) AS d_yearmonthnum,
    strftime(d, '%b%Y') AS d_yearmonth, CAST((dayofyear(d) - 1) // 7 + 1 AS BIGINT) AS d_weeknuminyear
  FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)),
ssb_part AS (SELECT p_partkey, 'MFGR#' || (1 + p_partkey % 5) AS p_mfgr, 'MFGR#' || (1 + p_partkey % 5) || (1 + (p_partkey // 5) % 5) AS p_category,
    'MFGR#' || (1 + p_partkey % 5) || (1 + (p_partkey // 5) % 5) || (1 + (p_partkey // 25) % 40) AS p_brand FROM part),
ssb_supplier AS (SELECT s_suppkey, n_name AS s_nation, r_name AS s_region, n_name || '#' || (s_suppkey % 2) AS s_city
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
ssb_customer AS (SELECT c_custkey, n_name AS c_nation, r_name AS c_region, n_name || '#' || (c_custkey % 2) AS c_city
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
ssb_lineorder AS (SELECT l_orderkey AS lo_orderkey, o_custkey AS lo_custkey, l_partkey AS lo_partkey, l_suppkey AS lo_suppkey,
    CAST(o_orderdate AS DATE) AS lo_orderdate, CAST(l_quantity AS BIGINT) AS lo_quantity,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS lo_extendedprice, CAST(round(l_discount * 100) AS BIGINT) AS lo_discount,
    CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) // 100 AS lo_revenue,
    CAST(round(p_retailprice * 60) AS BIGINT) AS lo_supplycost
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

_CITIES = "('NATION_9#0', 'NATION_1#0')"
_Q1 = "SELECT CAST(sum(lo_extendedprice * lo_discount) AS BIGINT) AS revenue FROM ssb_lineorder JOIN ssb_date ON lo_orderdate = d_datekey WHERE "
_Q2 = "SELECT CAST(sum(lo_revenue) AS BIGINT) AS sum_revenue, d_year, p_brand FROM ssb_lineorder JOIN ssb_date ON lo_orderdate = d_datekey JOIN ssb_part ON lo_partkey = p_partkey JOIN ssb_supplier ON lo_suppkey = s_suppkey WHERE {} GROUP BY d_year, p_brand"
_Q3 = "SELECT c_{0}, s_{0}, d_year, CAST(sum(lo_revenue) AS BIGINT) AS revenue FROM ssb_lineorder JOIN ssb_date ON lo_orderdate = d_datekey JOIN ssb_customer ON lo_custkey = c_custkey JOIN ssb_supplier ON lo_suppkey = s_suppkey WHERE {1} GROUP BY c_{0}, s_{0}, d_year"
_Q4 = "SELECT {0}, CAST(sum(lo_revenue - lo_supplycost) AS BIGINT) AS profit FROM ssb_lineorder JOIN ssb_date ON lo_orderdate = d_datekey JOIN ssb_customer ON lo_custkey = c_custkey JOIN ssb_supplier ON lo_suppkey = s_suppkey JOIN ssb_part ON lo_partkey = p_partkey WHERE {1} GROUP BY {0}"
_42 = _Q4.format("d_year, s_nation, p_category", "c_region = 'AMERICA' AND s_region = 'AMERICA' AND p_mfgr IN ('MFGR#1', 'MFGR#2') AND d_year BETWEEN 1997 AND 1998")
_43 = _Q4.format("d_year, s_city, p_brand", "s_nation = 'NATION_1' AND p_category = 'MFGR#14' AND d_year BETWEEN 1997 AND 1998")
SSB_SQL = {
    "q_1_1": _Q1 + "d_year = 1996 AND lo_discount BETWEEN 1 AND 3 AND lo_quantity < 25",
    "q_1_2": _Q1 + "d_yearmonth = 'Jan1997' AND lo_discount BETWEEN 4 AND 6 AND lo_quantity BETWEEN 26 AND 35",
    "q_1_3": _Q1 + "d_weeknuminyear = 6 AND d_year = 1997 AND lo_discount BETWEEN 5 AND 7 AND lo_quantity BETWEEN 26 AND 35",
    "q_2_1": _Q2.format("p_category = 'MFGR#12' AND s_region = 'AMERICA'"),
    "q_2_2": _Q2.format("p_brand BETWEEN 'MFGR#2221' AND 'MFGR#2228' AND s_region = 'ASIA'"),
    "q_2_3": _Q2.format("p_brand = 'MFGR#2239' AND s_region = 'EUROPE'"),
    "q_3_1": _Q3.format("nation", "c_region = 'ASIA' AND s_region = 'ASIA' AND d_year BETWEEN 1995 AND 2000"),
    "q_3_2": _Q3.format("city", "c_nation = 'NATION_1' AND s_nation = 'NATION_1' AND d_year BETWEEN 1995 AND 2000"),
    "q_3_3": _Q3.format("city", f"c_city IN {_CITIES} AND s_city IN {_CITIES} AND d_year BETWEEN 1995 AND 2000"),
    "q_3_4": _Q3.format("city", f"c_city IN {_CITIES} AND s_city IN {_CITIES} AND d_yearmonth = 'Dec1997'"),
    "q_4_1": _Q4.format("d_year, c_nation", "c_region = 'AMERICA' AND s_region = 'AMERICA' AND p_mfgr IN ('MFGR#1', 'MFGR#2')"),
    "q_4_2": _42, "q_4_3": _43, "q_4_2_vai": _42, "q_4_3_vai": _43,
}


def plan_frame(spark: SparkSession, folder: str, name: str) -> DataFrame:
    plan = star.QUERIES[name](1)
    return lower(plan, star.Star(spark, folder).resolver(plan))


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


for _name, _sql in SSB_SQL.items():
    _add(_name, lambda s, d, n=_name: plan_frame(s, d, n), f"WITH {STAR_SQL} {_sql}")

# Filters: rows that pass, by key
_FILTERS: dict[str, tuple[str, str, str, tuple[Any, ...], str]] = {
    "filter_lt": ("lineitem", "l_quantity", "lt", (5,), "l_quantity < 5"),
    "filter_le": ("lineitem", "l_quantity", "le", (5,), "l_quantity <= 5"),
    "filter_eq": ("lineitem", "l_linenumber", "eq", (3,), "l_linenumber = 3"),
    "filter_ge": ("lineitem", "l_quantity", "ge", (45,), "l_quantity >= 45"),
    "filter_gt": ("lineitem", "l_quantity", "gt", (45,), "l_quantity > 45"),
    "filter_ne": ("lineitem", "l_linenumber", "ne", (1,), "l_linenumber <> 1"),
    "filter_between_int": ("lineitem", "l_suppkey", "between", (3, 7), "l_suppkey BETWEEN 3 AND 7"),
    "filter_float": ("lineitem", "l_discount", "between", (0.045, 0.065), "l_discount BETWEEN 0.045 AND 0.065"),
    "filter_in_int": ("lineitem", "l_suppkey", "in", (1, 4, 9), "l_suppkey IN (1, 4, 9)"),
    "filter_between_str": ("part", "p_brand", "between", ("Brand#2", "Brand#3"), "p_brand BETWEEN 'Brand#2' AND 'Brand#3'"),
    "filter_in_str": ("nation", "n_name", "in", ("NATION_3", "NATION_7"), "n_name IN ('NATION_3', 'NATION_7')"),
    "filter_in_missing": ("nation", "n_name", "in", ("NATION_3", "ATLANTIS"), "n_name IN ('NATION_3', 'ATLANTIS')"),
    "filter_eq_str": ("nation", "n_name", "eq", ("NATION_3",), "n_name = 'NATION_3'"),
    "filter_eq_missing": ("nation", "n_name", "eq", ("ATLANTIS",), "n_name = 'ATLANTIS'"),
    "filter_ne_str": ("nation", "n_name", "ne", ("NATION_3",), "n_name <> 'NATION_3'"),
    "filter_ne_missing": ("nation", "n_name", "ne", ("ATLANTIS",), "n_name <> 'ATLANTIS'"),
    "filter_like_prefix": ("nation", "n_name", "like", ("NATION_1%",), r"n_name LIKE 'NATION\_1%' ESCAPE '\'"),
    "filter_like_infix": ("nation", "n_name", "like", ("%ION%2%",), "n_name LIKE '%ION%2%'"),
    "filter_like_underscore_literal": ("nation", "n_name", "like", ("N_TION%",), r"n_name LIKE 'N\_TION%' ESCAPE '\'"),
}
for _name, (_t, _c, _kind, _values, _where) in _FILTERS.items():
    _add(_name, lambda s, d, t=_t, c=_c, k=_kind, v=_values: core.select_rows(_table(s, d, t), c, k, *v).groupBy(c).agg(F.count("*").alias("n")), f"SELECT {_c}, count(*) AS n FROM {_t} WHERE {_where} GROUP BY {_c}")
_add("filter_date", lambda s, d: core.select_rows(star.Star(s, d).table("date", ["d_datekey"]), "d_datekey", "lt", F.to_date(F.lit("1995-03-01"))), f"WITH {STAR_SQL} SELECT d_datekey FROM ssb_date WHERE d_datekey < DATE '1995-03-01'")
_add("filter_positions", lambda s, d: core.select_rows(core.ranked(_table(s, d, "nation"), F.col("n_nationkey")).withColumn("pos", F.col("place") - 1), "pos", "ge", 20).select("pos", "n_name"), "SELECT n_nationkey AS pos, n_name FROM nation WHERE n_nationkey >= 20")

# Combination of predicates
_A, _B = "l_discount >= 0.05", "l_quantity < 10"
for _name, _op, _where in (("and_intersect", core.intersect, f"{_A} AND {_B}"), ("or_union", core.union, f"{_A} OR {_B}"), ("mask_and", core.intersect, f"{_A} AND {_B}"), ("mask_or", core.union, f"{_A} OR {_B}")):
    _mask = _name.startswith("mask")

    def _combined(s: SparkSession, d: str, op: Callable = _op, mask: bool = _mask) -> DataFrame:
        df = _table(s, d, "lineitem")
        a, b = predicate(F.col("l_discount"), "ge", (0.05,)), predicate(F.col("l_quantity"), "lt", (10,))
        if mask:
            df = df.withColumns({"m1": a, "m2": b})
            a, b = F.col("m1"), F.col("m2")
        return op(df, a, b).groupBy("l_linenumber").agg(F.count("*").alias("n"))

    _add(_name, _combined, f"SELECT l_linenumber, count(*) AS n FROM lineitem WHERE {_where} GROUP BY l_linenumber")
_add("not_negate", lambda s, d: core.negate(_table(s, d, "lineitem"), predicate(F.col("l_quantity"), "lt", (10,))).groupBy("l_linenumber").agg(F.count("*").alias("n")), "SELECT l_linenumber, count(*) AS n FROM lineitem WHERE NOT l_quantity < 10 GROUP BY l_linenumber")


# Materialisation, through the plan front end
def _plan(write: Callable[[ir.Builder], ir.Plan], name: str) -> Query:
    def query(s: SparkSession, d: str) -> DataFrame:
        plan = write(ir.Builder(1, name))
        return lower(plan, star.Star(s, d).resolver(plan))

    return query


def _materialize(b: ir.Builder) -> ir.Plan:
    b.take(b.filter("supplier.s_region", "eq", "ASIA", to="f"), "supplier.s_city", to="city")
    b.take("f", "supplier.s_suppkey", to="key")
    return b.result({"key": "s_suppkey", "city": "s_city"})


def _compose(b: ir.Builder) -> ir.Plan:
    b.filter("supplier.s_region", "eq", "ASIA", to="f")
    b.take("f", "supplier.s_suppkey", to="key")
    i, o = b.join("key", "lineorder.lo_suppkey", to="j")
    b.take(i, "f", to="suppliers")
    b.take("suppliers", "supplier.s_nation", to="nation")
    b.take(o, "lineorder.lo_revenue", to="revenue")
    ext, clusters, total = b.group(["nation"], "revenue", to="g")
    b.take(ext, "nation", to="s_nation")
    return b.result({"s_nation": "s_nation", clusters: "n", total: "revenue"})


def _masked(b: ir.Builder) -> ir.Plan:
    b.filter("supplier.s_region", "eq", "ASIA", to="f1")
    b.filter("supplier.s_suppkey", "lt", 50, to="f2")
    b.negate(b.either("f1", "f2", to="f3"), to="f")
    b.take("f", "supplier.s_suppkey", to="key")
    return b.result({"key": "s_suppkey"})


_add("materialize_filter", _plan(_materialize, "materialize_filter"), f"WITH {STAR_SQL} SELECT s_suppkey, s_city FROM ssb_supplier WHERE s_region = 'ASIA'")
_add("materialize_mask", _plan(_masked, "materialize_mask"), f"WITH {STAR_SQL} SELECT s_suppkey FROM ssb_supplier WHERE NOT (s_region = 'ASIA' OR s_suppkey < 50)")
_add("materialize_compose", _plan(_compose, "materialize_compose"), f"WITH {STAR_SQL} SELECT s_nation, count(*) AS n, CAST(sum(lo_revenue) AS BIGINT) AS revenue FROM ssb_lineorder JOIN ssb_supplier ON lo_suppkey = s_suppkey WHERE s_region = 'ASIA' GROUP BY s_nation")

# Arithmetic, with negative operands
_SIGN = {"add": "+", "sub": "-", "mul": "*", "div": "//", "mod": "%"}
for _kind, _sign in _SIGN.items():
    _add(f"map_{_kind}_cols", lambda s, d, k=_kind: core.mapped(_table(s, d, "lineitem").select((F.col("l_partkey") - 100).alias("a"), F.col("l_linenumber").cast("bigint").alias("b")), k, "a", "b", "c").groupBy("c").agg(F.count("*").alias("n")), f"SELECT (l_partkey - 100) {_sign} CAST(l_linenumber AS BIGINT) AS c, count(*) AS n FROM lineitem GROUP BY 1")
    _add(f"map_{_kind}_scalar", lambda s, d, k=_kind: core.mapped(_table(s, d, "lineitem").select((F.col("l_partkey") - 100).alias("a")), k, "a", 7, "c").groupBy("c").agg(F.count("*").alias("n")), f"SELECT (l_partkey - 100) {_sign} 7 AS c, count(*) AS n FROM lineitem GROUP BY 1")

# Joins
_add("join_hash_pkfk", lambda s, d: core.lookup(_table(s, d, "orders").select("o_orderkey", "o_custkey"), _table(s, d, "customer").select("c_custkey", "c_nationkey"), "o_custkey", "c_custkey").groupBy("c_nationkey").agg(F.count("*").alias("n")), "SELECT c_nationkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey")
_add("join_hash_string", lambda s, d: core.lookup(star.Star(s, d).table("customer", ["c_nation"]), _table(s, d, "nation").select("n_name", "n_regionkey"), "c_nation", "n_name").groupBy("n_regionkey").agg(F.count("*").alias("n")), f"WITH {STAR_SQL} SELECT n_regionkey, count(*) AS n FROM ssb_customer JOIN nation ON c_nation = n_name GROUP BY n_regionkey")
_add("join_merge", lambda s, d: core.lookup(_table(s, d, "lineitem").select("l_orderkey", "l_quantity"), _table(s, d, "orders").select("o_orderkey", "o_custkey"), "l_orderkey", "o_orderkey", "merge").groupBy("o_custkey").agg(F.count("*").alias("n")), "SELECT o_custkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey")
_add("join_nested_loop_theta", lambda s, d: core.theta(_table(s, d, "nation").select("n_nationkey"), _table(s, d, "region").select("r_regionkey"), F.col("n_nationkey") < F.col("r_regionkey")), "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_nationkey < r_regionkey")
_add("join_first_match", lambda s, d: core.first_match(_table(s, d, "customer").select(F.col("c_custkey").alias("k")), _table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("pos"), F.col("o_orderkey").alias("first_order")), "k", "pos"), "SELECT c_custkey AS k, min(o_orderkey) AS first_order FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
_add("join_star", lambda s, d: plan_frame(s, d, "q_4_1"), SQL["q_4_1"])

# Aggregates
for _kind in ("count", "sum", "min", "max", "avg"):
    _int = {"count": "count(*)", "sum": "CAST(sum(l_suppkey) AS BIGINT)"}.get(_kind, f"{_kind}(l_suppkey)")
    _add(f"agg_{_kind}", lambda s, d, k=_kind: core.summarise(_table(s, d, "lineitem"), v=(k, "l_suppkey")), f"SELECT {_int} AS v FROM lineitem")
for _kind in ("min", "max"):
    _add(f"agg_{_kind}_double", lambda s, d, k=_kind: core.summarise(_table(s, d, "lineitem"), v=(k, "l_extendedprice")), f"SELECT {_kind}(l_extendedprice) AS v FROM lineitem")
for _kind in ("sum", "avg"):
    _add(f"agg_{_kind}_double", lambda s, d, k=_kind: core.summarise(_table(s, d, "lineitem"), v=(k, "l_extendedprice")).select(F.round("v", 2).alias("v")), f"SELECT round({_kind}(l_extendedprice), 2) AS v FROM lineitem")
_add("agg_empty", lambda s, d: core.summarise(_table(s, d, "lineitem").where("l_quantity < 0"), n=("count", "l_suppkey"), v=("sum", "l_suppkey")), "SELECT count(*) AS n, CAST(sum(l_suppkey) AS BIGINT) AS v FROM lineitem WHERE l_quantity < 0")

# Groups
_add("group_single", lambda s, d: core.grouped(_table(s, d, "lineitem"), ["l_suppkey"], n=("count", "l_suppkey")), "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey")
_add("group_multi", lambda s, d: core.grouped(_table(s, d, "lineitem"), ["l_suppkey", "l_linenumber"], n=("count", "l_suppkey")), "SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL")
_add("group_sum", lambda s, d: core.grouped(_table(s, d, "lineitem"), ["l_linenumber"], v=("sum", "l_partkey")), "SELECT l_linenumber, CAST(sum(l_partkey) AS BIGINT) AS v FROM lineitem GROUP BY l_linenumber")
_add("group_clusters", lambda s, d: core.grouped(_table(s, d, "orders"), ["o_custkey"], cluster=("count", "o_custkey")), "SELECT o_custkey, count(*) AS cluster FROM orders GROUP BY o_custkey")
_add("group_extents", lambda s, d: core.grouped(_table(s, d, "orders"), ["o_custkey"], first_row=("min", "o_orderkey")), "SELECT o_custkey, min(o_orderkey) AS first_row FROM orders GROUP BY o_custkey")
_add("group_string_key", lambda s, d: core.grouped(star.Star(s, d).table("customer", ["c_city"]), ["c_city"], n=("count", "c_city")), f"WITH {STAR_SQL} SELECT c_city, count(*) AS n FROM ssb_customer GROUP BY c_city")
_add("group_date_key", lambda s, d: core.grouped(star.Star(s, d).table("lineorder", ["lo_orderdate", "lo_revenue"]), ["lo_orderdate"], v=("sum", "lo_revenue")), f"WITH {STAR_SQL} SELECT lo_orderdate, CAST(sum(lo_revenue) AS BIGINT) AS v FROM ssb_lineorder GROUP BY lo_orderdate")

# Sorts: the place of each row makes the order visible
for _name, _spark_order, _sql_order in (
    ("sort_asc", lambda: [F.col("n_name").asc()], "n_name"),
    ("sort_desc", lambda: [F.col("n_nationkey").desc()], "n_nationkey DESC"),
    ("sort_mixed", lambda: [F.col("n_regionkey").asc(), F.col("n_name").desc()], "n_regionkey, n_name DESC"),
    ("sort_string", lambda: [F.col("n_name").desc()], "n_name DESC"),
    ("sort_chain_index", lambda: [F.col("n_regionkey").desc(), F.col("n_nationkey").asc()], "n_regionkey DESC, n_nationkey"),
):
    _add(_name, lambda s, d, o=_spark_order: core.ranked(_table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), *o()), f"SELECT n_nationkey, n_name, n_regionkey, CAST(row_number() OVER (ORDER BY {_sql_order}) AS INTEGER) AS place FROM nation")

# Sources and sinks
_add("result_headers", lambda s, d: plan_frame(s, d, "q_2_3"), SQL["q_2_3"])


def _folder(name: str) -> str:
    return os.path.join(tempfile.mkdtemp(prefix="constella-"), name)


def _tbl_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Writes orders as ``|``-text and reads it back; the folder is the session's shared one where it has one."""
    shared = s.conf.get("spark.checkpoint.dir", None)
    path = f"{shared}/{os.path.basename(tempfile.mktemp(prefix='tbl-'))}" if shared else _folder("orders.tbl")
    o = _table(s, d, "orders")
    day = F.col("o_orderdate").cast("date")
    o.select(F.concat_ws("|", F.col("o_orderkey"), F.col("o_custkey"), F.date_format(day, "yyyyMMdd"), F.lit("")).alias("value")).write.text(path)
    return files.read_tbl(s, path, files.parse_schema("orders:o_orderkey(int),o_custkey(int),o_orderdate(date),dummy(str);")["orders"])


_add("load_tbl_roundtrip", _tbl_roundtrip, "SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders")
_add("fetch_first_last", lambda s, d: core.ranked(_table(s, d, "nation").select("n_nationkey"), F.col("n_nationkey")).where("place <= 5 or place > 20"), "SELECT n_nationkey, CAST(n_nationkey + 1 AS INTEGER) AS place FROM nation WHERE n_nationkey < 5 OR n_nationkey >= 20")
_add("random_column", lambda s, d: files.random_column(s, 1000, "int", 7).agg(F.count("*").alias("n"), (F.min("value") >= -(2**31)).alias("ok")), "SELECT 1000 AS n, true AS ok")


# Beyond the plan items: negation's relatives among joins and sets, top rows
_add("join_semi", lambda s, d: _table(s, d, "customer").join(_table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
_add("join_anti", lambda s, d: _table(s, d, "customer").join(_table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
_add("join_left_outer", lambda s, d: _table(s, d, "customer").select("c_custkey").join(_table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")), "c_custkey", "left"), "SELECT c_custkey, n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
_add("set_except", lambda s, d: _table(s, d, "lineitem").select("l_suppkey").exceptAll(_table(s, d, "lineitem").where("l_quantity < 25").select("l_suppkey")).groupBy("l_suppkey").agg(F.count("*").alias("n")), "SELECT l_suppkey, count(*) AS n FROM (SELECT l_suppkey FROM lineitem EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_quantity < 25) GROUP BY l_suppkey")
_add("limit_topk", lambda s, d: _table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "o_custkey").limit(10), "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10")


_add("set_union_all", lambda s, d: _table(s, d, "customer").select(F.col("c_nationkey").alias("k")).unionAll(_table(s, d, "supplier").select(F.col("s_nationkey").alias("k"))).groupBy("k").agg(F.count("*").alias("n")), "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k")
_add("join_full_outer", lambda s, d: _table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n")).where("k % 2 = 0").join(_table(s, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("k"), "s_nationkey"), "k", "full"), "SELECT coalesce(l_suppkey, s_suppkey) AS k, n, s_nationkey FROM (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY l_suppkey) FULL JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey")
_add("join_multi_key", lambda s, d: _table(s, d, "customer").select(F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 5).alias("part")).join(_table(s, d, "supplier").select(F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 5).alias("part")), ["nation", "part"]).groupBy("nation", "part").agg(F.count("*").alias("n")), "SELECT c_nationkey AS nation, c_custkey % 5 AS part, count(*) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey % 5 = s_suppkey % 5 GROUP BY ALL")
_add("join_range", lambda s, d: core.in_range(_table(s, d, "orders").select("o_orderkey"), _table(s, d, "customer").select((F.col("c_custkey") * 7).alias("low"), (F.col("c_custkey") * 7 + F.col("c_nationkey")).alias("high"), "c_nationkey"), "o_orderkey", "low", "high", 16).groupBy("c_nationkey").agg(F.count("*").alias("n")), "SELECT c_nationkey, count(*) AS n FROM orders JOIN customer ON o_orderkey BETWEEN c_custkey * 7 AND c_custkey * 7 + c_nationkey GROUP BY c_nationkey")
_add("join_as_of", lambda s, d: core.as_of(_table(s, d, "events").where("event_type = 'click'").select("event_id", "user_id", "ts"), _table(s, d, "events").where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("viewed")), ["user_id"], "ts", "viewed").select("event_id", "viewed"), "SELECT c.event_id, v.viewed FROM (SELECT * FROM events WHERE event_type = 'click') AS c ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS viewed FROM events WHERE event_type = 'view' GROUP BY user_id, ts) AS v ON c.user_id = v.user_id AND c.ts >= v.ts")
_add("group_rollup", lambda s, d: core.rolled_up(_table(s, d, "lineitem"), ["l_returnflag", "l_linenumber"], n=("count", "l_suppkey")), "SELECT l_returnflag, l_linenumber, grouping_id(l_returnflag, l_linenumber) AS level, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linenumber)")
_add("group_cube", lambda s, d: core.cubed(_table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], v=("sum", "l_partkey")), "SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) AS level, CAST(sum(l_partkey) AS BIGINT) AS v FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
_add("group_sets", lambda s, d: core.grouping_sets(_table(s, d, "lineitem"), [["l_returnflag"], ["l_linenumber"], []], ["l_returnflag", "l_linenumber"], n=("count", "l_suppkey")), "SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linenumber), ())")
_add("group_having", lambda s, d: core.grouped(_table(s, d, "orders"), ["o_custkey"], n=("count", "o_custkey")).where("n >= 12"), "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12")
_add("group_distinct", lambda s, d: _table(s, d, "lineitem").groupBy("l_linenumber").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_partkey").alias("parts")), "SELECT l_linenumber, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_linenumber")
_add("sort_large", lambda s, d: core.ranked_by(_table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], F.col("o_orderdate").desc(), F.col("o_orderkey")), "SELECT o_custkey, o_orderkey, o_orderdate, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS place FROM orders")


# Event windows
_HOUR = 3_600_000_000
_add("windows_tumbling", lambda s, d: core.windowed_events(_table(s, d, "events"), "ts", "1 hour", "event_type").select(F.unix_micros(F.col("start").cast("timestamp")).alias("start"), "event_type", "n"), f"SELECT epoch_us(ts) // {_HOUR} * {_HOUR} AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
_add("windows_sliding", lambda s, d: core.windowed_events(_table(s, d, "events"), "ts", "2 hours", "event_type", "1 hour").select(F.unix_micros(F.col("start").cast("timestamp")).alias("start"), "event_type", "n"), f"SELECT (epoch_us(ts) // {_HOUR} - back) * {_HOUR} AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) AS b(back) GROUP BY ALL")
_add("windows_session", lambda s, d: core.sessions(_table(s, d, "events"), "ts", "30 minutes", "user_id").select(F.unix_micros(F.col("start").cast("timestamp")).alias("start"), "user_id", "n"), "SELECT epoch_us(min(ts)) AS start, user_id, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS part FROM (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, part")


def _shared(s: SparkSession, name: str) -> str:
    """A fresh folder below the session's shared one, or a local one where it has none."""
    shared = s.conf.get("spark.checkpoint.dir", None)
    return f"{shared.rstrip('/')}/constella-{uuid.uuid4().hex}/{name}" if shared else "file://" + _folder(name)


def _binary_dict(s: SparkSession, d: str) -> DataFrame:
    """Writes ``nation`` as binary columns with a dictionary, beside its schema, and loads it."""
    folder, text = _shared(s, "bin"), "nation:n_nationkey(int),n_name(str),n_regionkey(int);"
    rows = _table(s, d, "nation").orderBy("n_nationkey").collect()  # the smallest dimension
    files.put(s, f"{folder}/schema.txt", text.encode())
    schema = files.parse_schema(text)["nation"]
    files.write_binary_table(s, folder, "nation", {c: [r[c] for r in rows] for c in schema.names}, schema)
    return files.load_tables(s, folder, "bin")["nation"]


_add("load_binary_dict", _binary_dict, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")


# Plans that run together
def _grouped(name: str) -> Query:
    def query(s: SparkSession, d: str) -> DataFrame:
        plan, other = star.QUERIES[name](1), star.QUERIES[name](2)
        engine = Engine(s, star.Star(s, d), EngineConfig(profile=costmodel.Profile(chunk=1, least_saving=-1e18, least_share=-1e18)))
        try:
            result = engine.run([plan, other])[0]
        finally:
            engine.close()
        if result.error:
            raise result.error
        return s.createDataFrame(result.rows, lower(plan, star.Star(s, d).resolver(plan)).schema)

    return query


for _name in star.REGISTERED:
    _add(f"grouped_{_name}", _grouped(_name), SQL[_name])

#: Groups of the thirteen queries by the greatest merge ratio, as (ratio, members, columns).
GROUPS = [(1.0, "4_2", 16), (1.0, "4_1", 15), (1.0, "4_3", 15), (1.0, "3_1", 12), (1.0, "3_2 3_3", 12), (1.0, "2_1 2_2 2_3", 11), (1.0, "3_4", 11), (1.0, "1_1 1_3", 7), (1.0, "1_2", 6), (1.25, "2_1 2_2 2_3 3_1 4_1 4_2 4_3", 19), (1.25, "3_2 3_3 3_4", 13), (1.25, "1_1 1_2 1_3", 8), (1.5, "2_1 2_2 2_3 3_1 3_2 3_3 3_4 4_1 4_2 4_3", 21), (1.5, "1_1 1_2 1_3", 8), (2.0, "1_1 1_2 1_3 2_1 2_2 2_3 3_1 3_2 3_3 3_4 4_1 4_2 4_3", 25)]
#: Columns copied for so many equal plans at scale factor 100.
COPIES = [(50, "q_1_1", "lineorder.lo_discount"), (50, "q_1_1", "lineorder.lo_extendedprice"), (50, "q_1_1", "lineorder.lo_orderdate"), (100, "q_1_1", "lineorder.lo_discount"), (100, "q_1_1", "lineorder.lo_extendedprice"), (100, "q_1_1", "lineorder.lo_orderdate"), (10, "q_2_1", "lineorder.lo_orderdate"), (10, "q_2_1", "lineorder.lo_revenue"), (10, "q_2_1", "lineorder.lo_suppkey"), (10, "q_2_1", "part.p_brand"), (10, "q_2_1", "part.p_partkey")]


def _values(rows: list[tuple], names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(repr(v) for v in r) + ')' for r in rows)}) AS t({names})"


def _grouping_table(s: SparkSession, d: str) -> DataFrame:
    sets = [set(star.QUERIES[q](1).base_columns()) for q in star.REGISTERED]
    rows = [(t, " ".join(sorted(star.REGISTERED[i][2:] for i in g.members)), len(g.columns)) for t in (1.0, 1.25, 1.5, 2.0) for g in grouping.group_plans(sets, t)]
    return s.createDataFrame(rows, "ratio double, members string, columns int")


def _decisions(s: SparkSession, d: str) -> DataFrame:
    rows = []
    for n, q in ((1, "q_1_1"), (10, "q_1_1"), (50, "q_1_1"), (100, "q_1_1"), (10, "q_2_1")):
        plans = [star.QUERIES[q](i) for i in range(n)]
        made = costmodel.decide(grouping.group_plans([set(p.base_columns()) for p in plans]), plans, costmodel.sizes_sf100(plans))
        rows += [(n, q, x.column) for x in made if x.selected]
    return s.createDataFrame(rows, "n int, query string, column_name string")


def _validation(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(q, len(p.items), max(validate.depths(p).values()), validate.check(p).ok) for q, p in ((q, star.QUERIES[q](1)) for q in star.REGISTERED)], "query string, items int, depth int, valid boolean")


_add("grouping_table", _grouping_table, "SELECT CAST(ratio AS DOUBLE) AS ratio, members, CAST(columns AS INTEGER) AS columns FROM (" + _values(GROUPS, "ratio, members, columns") + ")")
_add("transfer_decisions", _decisions, _values(COPIES, "n, query, column_name"))
#: Items and depth of each plan.
SHAPES = [("q_1_1", 14, 7), ("q_1_2", 14, 7), ("q_1_3", 16, 7), ("q_2_1", 23, 11), ("q_2_2", 22, 10), ("q_2_3", 21, 10), ("q_3_1", 30, 11), ("q_3_2", 30, 11), ("q_3_3", 30, 11), ("q_3_4", 30, 11), ("q_4_1", 27, 16), ("q_4_2", 42, 13), ("q_4_3", 40, 13)]
_add("plan_validation_report", _validation, "SELECT query, items, depth, true AS valid FROM (" + _values(SHAPES, "query, items, depth") + ")")


def entry(spark: SparkSession, folder: str) -> DataFrame:
    return plan_frame(spark, folder, "q_3_1")
