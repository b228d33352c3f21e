import glob
import os

import duckdb
import pytest
from pyspark.sql import SparkSession

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def oracle(small):
    c = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")

    def rows(sql: str):
        r = c.sql(sql)
        order = sorted(range(len(r.columns)), key=lambda i: r.columns[i])
        return [r.columns[i] for i in order], _normal([tuple(x[i] for i in order) for x in r.fetchall()])

    return rows


def _normal(rows):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.fixture(scope="session")
def answer():
    def rows(df):
        columns = sorted(df.columns)
        return columns, _normal([tuple(r) for r in df.select(*columns).collect()])

    return rows
