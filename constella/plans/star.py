"""The star schema as lazy views over the driver's tables, and the thirteen benchmark queries on it as plans.

A view joins only what the asked columns need: each line has one order and one part, so a join whose columns nobody reads
changes nothing and is left out. Filters and projections reach the Parquet scans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from constella.plans.ir import Builder, Plan

BRAND_PARTS, CITY_PARTS, BRANDS = 5, 2, 40


def _cents(c: str, times: int = 100) -> Column:
    return F.round(F.col(c) * times).cast("bigint")


class Star:
    """``table(name, columns)``: lineorder, date, part, supplier or customer."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._schemas: dict[str, StructType] = {}
        self._rows: dict[str, int] = {}

    def read(self, name: str) -> DataFrame:
        """A table's scan; the schema is taken from the files once."""
        path = f"{self.folder}/{name}.parquet"
        if name not in self._schemas:
            self._schemas[name] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self._schemas[name]).parquet(path)

    def rows(self, name: str) -> int:
        """Rows of a view, counted once: its joins look up one row each, so Parquet footers tell all but the days."""
        if name not in self._rows:
            self._rows[name] = (self._date(None) if name == "date" else self.read("lineitem" if name == "lineorder" else name)).count()
        return self._rows[name]

    def table(self, name: str, columns: Iterable[str] | None = None) -> DataFrame:
        wanted = set(columns) if columns is not None else None
        df = getattr(self, f"_{name}")(wanted)
        return df if wanted is None else df.select(*[c for c in df.columns if c in wanted])

    def resolver(self, plan: Plan) -> Callable[[str], DataFrame]:
        columns = [c.split(".") for c in plan.base_columns()]
        return lambda table: self.table(table, [c for t, c in columns if t == table])

    def _lineorder(self, wanted: set[str] | None) -> DataFrame:
        needs = lambda *names: wanted is None or bool(wanted & set(names))
        df = self.read("lineitem")
        extended, discount = _cents("l_extendedprice"), _cents("l_discount")
        columns = {
            "lo_orderkey": F.col("l_orderkey"), "lo_linenumber": F.col("l_linenumber"), "lo_partkey": F.col("l_partkey"), "lo_suppkey": F.col("l_suppkey"),
            "lo_quantity": F.col("l_quantity").cast("bigint"), "lo_extendedprice": extended, "lo_discount": discount, "lo_tax": _cents("l_tax"),
            "lo_revenue": F.call_function("div", extended * (F.lit(100) - discount), F.lit(100)),
        }
        if needs("lo_custkey", "lo_orderdate", "lo_orderpriority"):
            df = df.join(self.read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            columns |= {"lo_custkey": F.col("o_custkey"), "lo_orderdate": F.col("o_orderdate").cast("date"), "lo_orderpriority": F.col("o_orderpriority")}
        if needs("lo_supplycost"):
            df = df.join(self.read("part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
            columns["lo_supplycost"] = _cents("p_retailprice", 60)
        return df.select(*[e.alias(c) for c, e in columns.items() if needs(c)])

    def _date(self, wanted: set[str] | None) -> DataFrame:
        d = F.col("d_datekey")
        days = self.read("orders").select(F.col("o_orderdate").cast("date").alias("d_datekey")).distinct()
        return days.select(
            d,
            F.year(d).cast("bigint").alias("d_year"),
            (F.year(d) * 100 + F.month(d)).cast("bigint").alias("d_yearmonthnum"),
            F.date_format(d, "MMMyyyy").alias("d_yearmonth"),
            (F.call_function("div", F.dayofyear(d) - 1, F.lit(7)) + 1).cast("bigint").alias("d_weeknuminyear"),
        )

    def _part(self, wanted: set[str] | None) -> DataFrame:
        k = F.col("p_partkey")
        mfgr = F.concat(F.lit("MFGR#"), (1 + k % BRAND_PARTS).cast("string"))
        category = F.concat(mfgr, (1 + F.call_function("div", k, F.lit(BRAND_PARTS)) % BRAND_PARTS).cast("string"))
        brand = F.concat(category, (1 + F.call_function("div", k, F.lit(BRAND_PARTS**2)) % BRANDS).cast("string"))
        return self.read("part").select(k, mfgr.alias("p_mfgr"), category.alias("p_category"), brand.alias("p_brand"))

    def _place(self, table: str, key: str, nation: str, prefix: str) -> DataFrame:
        places = self.read("nation").join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
        df = self.read(table).select(key, nation).join(places, F.col(nation) == F.col("n_nationkey"))
        city = F.concat("n_name", F.lit("#"), (F.col(key) % CITY_PARTS).cast("string"))
        return df.select(key, F.col("n_name").alias(f"{prefix}_nation"), F.col("r_name").alias(f"{prefix}_region"), city.alias(f"{prefix}_city"))

    def _supplier(self, wanted: set[str] | None) -> DataFrame:
        return self._place("supplier", "s_suppkey", "s_nationkey", "s")

    def _customer(self, wanted: set[str] | None) -> DataFrame:
        return self._place("customer", "c_custkey", "c_nationkey", "c")


CITIES = ("NATION_9#0", "NATION_1#0")


def _discounted(name: str, number: int, day: Callable[[Builder], str], discount: tuple[int, int], quantity: tuple) -> Plan:
    """Flight 1: revenue from discounts in a period."""
    b = Builder(number, name)
    days = day(b)
    b.filter("lineorder.lo_discount", "between", *discount, to="f_discount")
    b.filter("lineorder.lo_quantity", *quantity, to="f_quantity")
    lines = b.both("f_discount", "f_quantity", to="f_lines")
    b.take(days, "date.d_datekey", to="days")
    for c in ("orderdate", "discount", "extendedprice"):
        b.take(lines, f"lineorder.lo_{c}", to=c)
    _, o = b.join("days", "orderdate", to="j")
    b.take(o, "discount", to="discount2")
    b.take(o, "extendedprice", to="price2")
    b.map("mul", "price2", "discount2", to="product")
    b.aggregate("sum", "product", to="revenue")
    return b.result({"revenue": "revenue"})


def _brands(name: str, number: int, part: tuple, region: str, supplier_first: bool = False, sort: bool = False) -> Plan:
    """Flight 2: revenue by year and brand."""
    b = Builder(number, name)
    parts = b.filter(f"part.{part[0]}", *part[1:], to="f_part")
    b.take(parts, "part.p_partkey", to="partkey")
    b.take(parts, "part.p_brand", to="brand0")
    suppliers = b.filter("supplier.s_region", "eq", region, to="f_supplier")
    b.take(suppliers, "supplier.s_suppkey", to="suppkey")
    first, second = ("supp", "part") if supplier_first else ("part", "supp")
    i, o = b.join(f"{first}key", f"lineorder.lo_{first}key", to="j1")
    for c in (f"{second}key", "orderdate", "revenue"):
        b.take(o, f"lineorder.lo_{c}", to=f"{c}1")
    if not supplier_first:
        b.take(i, "brand0", to="brand1")
    i, o = b.join(f"{second}key", f"{second}key1", to="j2")
    for c in ("orderdate", "revenue"):
        b.take(o, f"{c}1", to=f"{c}2")
    b.take(*((i, "brand0") if supplier_first else (o, "brand1")), to="brand2")
    i, o = b.join("date.d_datekey", "orderdate2", to="j3")
    b.take(i, "date.d_year", to="year3")
    b.take(o, "revenue2", to="revenue3")
    b.take(o, "brand2", to="brand3")
    ext, _, total = b.group(["year3", "brand3"], "revenue3", to="g")
    b.take(ext, "year3", to="d_year")
    b.take(ext, "brand3", to="p_brand")
    index = b.sort(["p_brand"], [True], to="by_brand") if sort else None
    return b.result({total: "sum_revenue", "d_year": "d_year", "p_brand": "p_brand"}, index)


def _places(name: str, number: int, level: str, of: tuple, period: tuple, shown: str) -> Plan:
    """Flight 3: revenue by places of customer and supplier and by year."""
    b = Builder(number, name)
    b.filter(f"customer.c_{level}", *of, to="f_customer")
    b.filter(f"supplier.s_{level}", *of, to="f_supplier")
    days = b.filter(f"date.{period[0]}", *period[1:], to="f_day")
    b.take("f_customer", "customer.c_custkey", to="custkey")
    b.take("f_customer", f"customer.c_{shown}", to="c0")
    b.take("f_supplier", "supplier.s_suppkey", to="suppkey")
    b.take("f_supplier", f"supplier.s_{shown}", to="s0")
    b.take(days, "date.d_datekey", to="datekey")
    b.take(days, "date.d_year", to="year0")
    i, o = b.join("custkey", "lineorder.lo_custkey", to="j1")
    for c in ("suppkey", "orderdate", "revenue"):
        b.take(o, f"lineorder.lo_{c}", to=f"{c}1")
    b.take(i, "c0", to="c1")
    i, o = b.join("suppkey", "suppkey1", to="j2")
    for c in ("orderdate", "revenue", "c"):
        b.take(o, f"{c}1", to=f"{c}2")
    b.take(i, "s0", to="s2")
    i, o = b.join("datekey", "orderdate2", to="j3")
    for c in ("revenue", "c", "s"):
        b.take(o, f"{c}2", to=f"{c}3")
    b.take(i, "year0", to="year3")
    ext, _, total = b.group(["c3", "s3", "year3"], "revenue3", to="g")
    b.take(ext, "c3", to=f"c_{shown}")
    b.take(ext, "s3", to=f"s_{shown}")
    b.take(ext, "year3", to="d_year")
    index = b.sort(["d_year", total], [True, False], to="by_year")
    return b.result({f"c_{shown}": f"c_{shown}", f"s_{shown}": f"s_{shown}", "d_year": "d_year", total: "revenue"}, index)


def _profit_by_nation(name: str, number: int) -> Plan:
    """Query 4.1, with positions carried along and values taken at the end."""
    b = Builder(number, name)
    b.filter("supplier.s_region", "eq", "AMERICA", to="f_supplier")
    b.take("f_supplier", "supplier.s_suppkey", to="suppkey")
    b.filter("part.p_mfgr", "in", "MFGR#1", "MFGR#2", to="f_part")
    b.take("f_part", "part.p_partkey", to="partkey")
    b.filter("customer.c_region", "eq", "AMERICA", to="f_customer")
    b.take("f_customer", "customer.c_custkey", to="custkey")
    _, lines = b.join("suppkey", "lineorder.lo_suppkey", to="j1")
    b.take(lines, "lineorder.lo_partkey", to="partkey1")
    _, o = b.join("partkey", "partkey1", to="j2")
    lines = b.take(o, lines, to="lines2")
    b.take(lines, "lineorder.lo_custkey", to="custkey2")
    i, o = b.join("custkey", "custkey2", to="j3")
    lines = b.take(o, lines, to="lines3")
    customers = b.take(i, "f_customer", to="customers3")
    b.take(lines, "lineorder.lo_orderdate", to="orderdate3")
    i, o = b.join("date.d_datekey", "orderdate3", to="j4")
    b.take(i, "date.d_year", to="year4")
    lines = b.take(o, lines, to="lines4")
    customers = b.take(o, customers, to="customers4")
    b.take(lines, "lineorder.lo_revenue", to="revenue4")
    b.take(lines, "lineorder.lo_supplycost", to="cost4")
    b.take(customers, "customer.c_nation", to="nation4")
    b.map("sub", "revenue4", "cost4", to="profit4")
    ext, _, total = b.group(["year4", "nation4"], "profit4", to="g")
    b.take(ext, "year4", to="d_year")
    b.take(ext, "nation4", to="c_nation")
    return b.result({"d_year": "d_year", "c_nation": "c_nation", total: "profit"})


def _profit(name: str, number: int, supplier: tuple[str, str], part: tuple, customers: str | None, shown: tuple[str, str], late: bool = False) -> Plan:
    """Queries 4.2 and 4.3; ``late`` carries positions instead of values."""
    b = Builder(number, name)
    place, kind = shown
    if customers:
        b.filter("customer.c_region", "eq", customers, to="f_customer")
    b.filter("date.d_year", "between", 1997, 1998, to="f_day")
    b.filter(f"part.{part[0]}", *part[1:], to="f_part")
    b.filter(f"supplier.{supplier[0]}", "eq", supplier[1], to="f_supplier")
    if customers:
        b.take("f_customer", "customer.c_custkey", to="custkey")
    b.take("f_day", "date.d_datekey", to="datekey")
    b.take("f_part", "part.p_partkey", to="partkey")
    b.take("f_supplier", "supplier.s_suppkey", to="suppkey")
    inner = {"custkey": "custkey" if customers else "customer.c_custkey", "partkey": "partkey", "orderdate": "datekey"}
    if late:
        i, lines = b.join("suppkey", "lineorder.lo_suppkey", to="j1")
        held = {"s": b.take(i, "f_supplier", to="s1")}
        for n, key in enumerate(inner, 2):
            b.take(lines, f"lineorder.lo_{key}", to=f"{key}{n}")
            i, o = b.join(inner[key], f"{key}{n}", to=f"j{n}")
            lines = b.take(o, lines, to=f"lines{n}")
            held = {k: b.take(o, v, to=f"{k}{n}") for k, v in held.items()}
            if key != "custkey":
                source = {"partkey": ("p", "f_part"), "orderdate": ("d", "f_day")}[key]
                held[source[0]] = b.take(i, source[1], to=f"{source[0]}{n}")
        b.take(lines, "lineorder.lo_revenue", to="revenue4")
        b.take(lines, "lineorder.lo_supplycost", to="cost4")
        b.take(held["s"], f"supplier.{place}", to="place4")
        b.take(held["p"], f"part.{kind}", to="kind4")
        b.take(held["d"], "date.d_year", to="year4")
    else:
        b.take("f_day", "date.d_year", to="year0")
        b.take("f_part", f"part.{kind}", to="kind0")
        b.take("f_supplier", f"supplier.{place}", to="place0")
        i, o = b.join("suppkey", "lineorder.lo_suppkey", to="j1")
        for c in ("custkey", "partkey", "orderdate", "revenue", "supplycost"):
            b.take(o, f"lineorder.lo_{c}", to=f"{c}1")
        b.take(i, "place0", to="place1")
        carried = ["partkey", "orderdate", "revenue", "supplycost", "place"]
        for n, (key, new) in enumerate((("custkey", None), ("partkey", "kind"), ("orderdate", "year")), 2):
            i, o = b.join(inner[key], f"{key}{n - 1}", to=f"j{n}")
            carried = [c for c in carried if c != key]
            for c in carried:
                b.take(o, f"{c}{n - 1}", to=f"{c}{n}")
            if new:
                b.take(i, f"{new}0", to=f"{new}{n}")
                carried.append(new)
    b.map("sub", "revenue4", "cost4" if late else "supplycost4", to="profit4")
    ext, _, total = b.group(["year4", "place4", "kind4"], "profit4", to="g")
    for source, to in (("year4", "d_year"), ("place4", place), ("kind4", kind)):
        b.take(ext, source, to=to)
    return b.result({"d_year": "d_year", place: place, kind: kind, total: "profit"})


def _two_day_filters(b: Builder) -> str:
    b.filter("date.d_weeknuminyear", "eq", 6, to="f_week")
    b.filter("date.d_year", "eq", 1997, to="f_year")
    return b.both("f_week", "f_year", to="f_day")


YEARS = ("d_year", "between", 1995, 2000)
_42 = (("s_region", "AMERICA"), ("p_mfgr", "in", "MFGR#1", "MFGR#2"), "AMERICA", ("s_nation", "p_category"))
_43 = (("s_nation", "NATION_1"), ("p_category", "eq", "MFGR#14"), None, ("s_city", "p_brand"))
QUERIES: dict[str, Callable[[int], Plan]] = {
    "q_1_1": lambda n: _discounted("q_1_1", n, lambda b: b.filter("date.d_year", "eq", 1996, to="f_day"), (1, 3), ("lt", 25)),
    "q_1_2": lambda n: _discounted("q_1_2", n, lambda b: b.filter("date.d_yearmonth", "eq", "Jan1997", to="f_day"), (4, 6), ("between", 26, 35)),
    "q_1_3": lambda n: _discounted("q_1_3", n, _two_day_filters, (5, 7), ("between", 26, 35)),
    "q_2_1": lambda n: _brands("q_2_1", n, ("p_category", "eq", "MFGR#12"), "AMERICA", sort=True),
    "q_2_2": lambda n: _brands("q_2_2", n, ("p_brand", "between", "MFGR#2221", "MFGR#2228"), "ASIA"),
    "q_2_3": lambda n: _brands("q_2_3", n, ("p_brand", "eq", "MFGR#2239"), "EUROPE", supplier_first=True),
    "q_3_1": lambda n: _places("q_3_1", n, "region", ("eq", "ASIA"), YEARS, "nation"),
    "q_3_2": lambda n: _places("q_3_2", n, "nation", ("eq", "NATION_1"), YEARS, "city"),
    "q_3_3": lambda n: _places("q_3_3", n, "city", ("in", *CITIES), YEARS, "city"),
    "q_3_4": lambda n: _places("q_3_4", n, "city", ("in", *CITIES), ("d_yearmonth", "eq", "Dec1997"), "city"),
    "q_4_1": lambda n: _profit_by_nation("q_4_1", n),
    "q_4_2": lambda n: _profit("q_4_2", n, *_42),
    "q_4_3": lambda n: _profit("q_4_3", n, *_43),
    "q_4_2_vai": lambda n: _profit("q_4_2_vai", n, *_42, late=True),
    "q_4_3_vai": lambda n: _profit("q_4_3_vai", n, *_43, late=True),
}
REGISTERED = [q for q in QUERIES if not q.endswith("_vai")]
